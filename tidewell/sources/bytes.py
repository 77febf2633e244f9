"""Byte ranges of files in tasks: what was appended since a state, and files that are written back whole."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes at each end of a read prefix whose hashes tell whether it is still the same.
WINDOW = 4096
STATE = "rel string, consumed long, head string, tail string"


def place(path: str):
    """pyarrow's file system and path of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def fingerprint(read, end: int) -> tuple[str, str]:
    """Hashes of the first and last bytes of a prefix. read: (start, end) -> bytes."""
    digest = lambda a, b: hashlib.sha256(read(a, b)).hexdigest()
    return digest(0, min(WINDOW, end)), digest(max(0, end - WINDOW), end)


def appended(files: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that files got since a state, and the new state.

    files: rel, path; state: as STATE. Only the bytes after the state's offset are read if the prefix before it is the same;
    a file that shrank or changed is read from its start (`anew`). A last line without its newline is parsed (`ended` is
    false) but not consumed: it comes again when it is whole. Lines: rel, start (its byte), raw, ended, anew. A file that is
    gone gives nothing."""
    held = files.select("rel", "path").join(state.select("rel", "consumed", "head", "tail"), "rel", "left")

    def one(rel, path, consumed, head, tail):
        fs, name = place(path)
        with fs.open_input_file(name) as f:
            size = f.size()

            def read(a, b):
                f.seek(a)
                return f.read(b - a)

            start = int(consumed) if consumed is not None and consumed == consumed else 0
            same = start <= size and (start == 0 or fingerprint(read, start) == (head, tail))
            start = start if same else 0
            raw = read(start, size)
            whole = raw.rfind(b"\n") + 1
            parts = raw.split(b"\n")
            at, rows = start, []
            for k, p in enumerate(parts):
                if k < len(parts) - 1 or p:
                    rows.append((rel, at, p, k < len(parts) - 1, not same))
                at += len(p) + 1
            return rows, (rel, start + whole, *fingerprint(read, start + whole))

    def lines(batches):
        for t in batches:
            for r in t.itertuples(index=False):
                try:
                    rows, new = one(*r)
                except FileNotFoundError:
                    continue
                yield pd.DataFrame([(*x, None, None, None) for x in rows] + [(r.rel, None, None, None, None, *new[1:])], columns=["rel", "start", "raw", "ended", "anew", "consumed", "head", "tail"]).astype({"start": "Int64", "consumed": "Int64"})

    from .scratch import written

    both = written(held.select("rel", "path", "consumed", "head", "tail").repartition("rel").mapInPandas(lines, "rel string, start long, raw binary, ended boolean, anew boolean, consumed long, head string, tail string"), "appended")
    return both.where("raw IS NOT NULL").select("rel", "start", "raw", "ended", "anew"), both.where("raw IS NULL").select("rel", "consumed", "head", "tail")


def write_back(lines: DataFrame, files: DataFrame, root: str, stamp: str) -> DataFrame:
    """Write files of a tree anew: rel, status (written, new, changed), backup.

    lines: rel, line_no, raw, ended (false for a last line without its newline); files: rel, size, mtime (microseconds) as they were when the lines were read; a file that isn't
    in it must not be there. A file is written beside its place and renamed, after a copy of the old one was kept as
    `<rel>.<stamp>.bak`; one that was touched since the listing is left alone (`changed`)."""
    known = files.select("rel", "size", "mtime")
    rows = lines.select("rel", "line_no", "raw", "ended").join(known, "rel", "left")

    def run(batches):
        from pyarrow import fs as pafs

        def state(fs, name):
            info = fs.get_file_info(name)
            return None if info.type == pafs.FileType.NotFound else (info.size, info.mtime_ns // 1000)

        def put(rel, seen, parts):
            fs, base = place(root)
            name = f"{base.rstrip('/')}/{rel}"
            if state(fs, name) != seen:
                return rel, "changed", None
            fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            backup = None
            if seen is not None:
                backup = f"{rel}.{stamp}.bak"
                fs.copy_file(name, f"{base.rstrip('/')}/{backup}")
            with fs.open_output_stream(f"{name}.{stamp}.tmp") as f:
                for p in parts:
                    f.write(p)
            if state(fs, name) != seen:
                fs.delete_file(f"{name}.{stamp}.tmp")
                return rel, "changed", backup
            fs.move(f"{name}.{stamp}.tmp", name)
            return rel, "written" if seen else "new", backup

        now, seen, parts, out = None, None, [], []
        for t in batches:
            for r in t.itertuples(index=False):
                if r.rel != now:
                    if now is not None:
                        out.append(put(now, seen, parts))
                    now, parts = r.rel, []
                    seen = None if pd.isna(r.size_) else (int(r.size_), int(r.mtime))
                parts.append(bytes(r.raw) + (b"\n" if r.ended else b""))
        if now is not None:
            out.append(put(now, seen, parts))
        yield pd.DataFrame(out, columns=["rel", "status", "backup"])

    dealt = rows.withColumnRenamed("size", "size_").repartition("rel").sortWithinPartitions("rel", "line_no")
    return written_once(dealt.mapInPandas(run, "rel string, status string, backup string"))


def written_once(df: DataFrame) -> DataFrame:
    """Run the writing tasks now, and only once."""
    from .scratch import written

    return written(df, "written")
