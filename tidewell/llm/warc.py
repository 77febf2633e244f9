"""WARC derivative builder: metadata and plain-text conversion records for response records.

A response record holds an HTTP response. From each come two linked records of WARC 1.1:
- `metadata`, application/warc-fields: title, language, character set, outlinks, and what the response said of itself;
- `conversion`, text/plain: the page's text.
Both name the response in WARC-Refers-To, repeat its target and date, carry its payload digest as the source digest,
have a block digest of their own, and name each other in WARC-Concurrent-To. Ids are version-5 UUIDs of the source's
id, so that a task that runs again makes the same records.

Response records come from .warc and .warc.gz files (`responses`, then `derived`), or are made up for pages that were kept
without one (`derivatives`). Names of headers are found whatever their case; transfer and content codings are undone.

Defined results: null html is an empty page, with an empty conversion; a null url gives a target of `urn:page:<id>`; rows
are handled one by one, repeated or not; an empty table gives no records; other columns aren't read; damaged markup is
read as far as it goes: an open comment or script ends with the page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, small_batches

CRLF = b"\r\n"
#: Bytes of blocks that a reading task gathers before it hands them on.
BATCH_BYTES = 8_000_000
#: Date of records whose source states none.
NO_DATE = "1970-01-01T00:00:00Z"
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([a-zA-Z:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
# Elements of HTML whose content isn't text, and those that begin a new line.
_HIDDEN = {"script", "style", "noscript", "template", "iframe", "svg"}
_CLOSING = {name: re.compile(f"</{name}", re.I | re.A) for name in _HIDDEN}
_BLOCK = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def read_page(page: str) -> tuple[str, dict[str, str], list[str]]:
    """Text, what the head says (title, lang, charset, description), links."""
    out, links, said, at, title = [], [], {}, 0, None
    while True:
        lt = page.find("<", at)
        if lt < 0:
            out.append(page[at:])
            break
        out.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                break
            at = end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            if end < 0:
                break
            at = end + 1
            continue
        tag = _TAG.match(page, lt)
        if not tag:
            out.append("<")
            at = lt + 1
            continue
        at, name = tag.end(), tag[2].lower()
        if name in _BLOCK:
            out.append("\n")
        if tag[1]:
            if name == "title" and title is not None:
                said.setdefault("title", _tidy("".join(out[title:])))
                del out[title:]
                title = None
            continue
        if name in _HIDDEN:
            end = _CLOSING[name].search(page, at)  # on the page itself: a lower-cased one may be longer
            if not end:
                break
            at = end.start()
            continue
        if name == "title":
            title = len(out)
        elif name in ("a", "html", "meta", "link", "area"):
            attrs = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTR.findall(tag[3])}
            if name == "html" and "lang" in attrs:
                said.setdefault("lang", attrs["lang"])
            elif name == "meta" and "charset" in attrs:
                said.setdefault("charset", attrs["charset"])
            elif name == "meta" and attrs.get("name", "").lower() == "description":
                said.setdefault("description", attrs.get("content", ""))
            elif "href" in attrs and name != "meta":
                links.append(attrs["href"])
    return _tidy("".join(out)), said, links


def _tidy(text: str) -> str:
    return _LINES.sub("\n", _SPACE.sub(" ", entities.unescape(text))).strip()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}".encode("utf-8", "surrogatepass") + CRLF for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1" + CRLF + head + CRLF + block + CRLF + CRLF


def records(stream) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Records of an uncompressed WARC stream, one at a time. Header lines that go on are joined; a file that breaks off
    ends with its last whole record; a record without a length, or something else in its place, raises ValueError."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers: list[tuple[str, str]] = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "surrogatepass" if _is_utf8(line) else "replace").rstrip("\r\n")
            if text[:1] in " \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                headers.append((name.strip(), value.strip()))
        size = named(headers, "Content-Length")
        if size is None or not size.isdecimal():
            raise ValueError("a record has no length")
        block = stream.read(int(size))
        if len(block) < int(size):
            return
        yield headers, block


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8", "surrogatepass")
        return True
    except UnicodeDecodeError:
        return False


def named(headers: list[tuple[str, str]], name: str, other: str | None = None) -> str | None:
    """First value of a header, whatever the case of its name."""
    return next((v for k, v in headers if k.lower() == name.lower()), other)


def opened(data: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def parse(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """Records of a WARC file, gzipped or not."""
    return list(records(opened(data)))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files at a path that Spark reads (a file, a folder or a pattern): file, record_id,
    headers (array of name and value), block. Other records are passed over.

    A file is one task's, as Spark's reader gives it (2 GB of compressed bytes at most); its records are unpacked one by one."""
    import pyarrow as pa

    small_batches(spark)
    target = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())])

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for headers, block in records(opened(content.as_py())):
                    if named(headers, "WARC-Type", "").lower() == "response":
                        held.append({"file": file, "record_id": named(headers, "WARC-Record-ID"), "headers": [{"name": k, "value": v} for k, v in headers], "block": block})
                        size += len(block)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=target)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=target)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, record_id string, headers array<struct<name:string,value:string>>, block binary")


def response(page_id, url: str | None, page: str | None, date: str = NO_DATE) -> tuple[list[tuple[str, str]], bytes]:
    """A response record for a page that was kept without one."""
    body = (page or "").encode("utf-8", "surrogatepass")
    target = url or f"urn:page:{page_id}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), target)), ("WARC-Target-URI", target), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))], block


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response record."""
    http, _, body = block.partition(CRLF + CRLF)
    status, *lines = http.decode("latin-1").split("\r\n")
    fields = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines) if colon]
    payload = _plain(body, fields)
    charset = re.search(r"charset=[\"']?([\w-]+)", named(fields, "Content-Type", ""), re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:  # a character set that nobody knows
        page = payload.decode("utf-8", "replace")
    text, said, links = read_page(page)
    own = named(headers, "WARC-Record-ID") or record_id("response", digest(block))
    target, date = named(headers, "WARC-Target-URI", ""), named(headers, "WARC-Date", NO_DATE)
    ids = {k: record_id(k, own) for k in ("metadata", "conversion")}
    lines = [("http-status", status), *((f"http-{k.lower()}", v) for k, v in sorted(fields)), *sorted((k, " ".join(v.split())) for k, v in said.items())]
    for link in dict.fromkeys(links):
        try:
            lines.append(("outlink", "".join(urljoin(target, link.strip()).split())))
        except ValueError:  # not a URL
            lines.append(("outlink", "".join(link.split())))
    out = []
    for kind, other, media, made in (
        ("metadata", "conversion", "application/warc-fields", b"".join(f"{k}: {v}".encode("utf-8", "surrogatepass") + CRLF for k, v in lines)),
        ("conversion", "metadata", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass")),
    ):
        out.append((
            [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", ids[other]), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Source-Payload-Digest", named(headers, "WARC-Payload-Digest") or digest(body)), ("Content-Type", media), ("WARC-Block-Digest", digest(made))],
            made,
        ))
    return out


def _plain(body: bytes, fields: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content codings; a coding that can't be undone is left as it is."""
    if "chunked" in named(fields, "Transfer-Encoding", "").lower():
        out, stream = [], io.BytesIO(body)
        while size := re.match(rb"[0-9a-fA-F]+", stream.readline()):
            if not int(size[0], 16):
                break
            out.append(stream.read(int(size[0], 16)))
            stream.readline()
        body = b"".join(out) or body
    coding = named(fields, "Content-Encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if coding == "deflate":
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


_FIELDS = "kind string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, source_digest string, block_digest string, n_bytes long, content string, record binary"


def _row(headers: list[tuple[str, str]], block: bytes, whole: bool) -> tuple:
    """The columns of _FIELDS of a derived record."""
    d = dict(headers)
    return (d["WARC-Type"], d["WARC-Record-ID"], d["WARC-Refers-To"], d["WARC-Concurrent-To"], d["WARC-Target-URI"], d["WARC-Date"], d["Content-Type"], d["WARC-Source-Payload-Digest"], d["WARC-Block-Digest"], len(block), block.decode("utf-8", "replace"), gzip.compress(record(headers, block), 6, mtime=0) if whole else None)


def derived(found: DataFrame, whole: bool = True) -> DataFrame:
    """Two rows for each response record, as `responses` returns them: file, and the columns of `derivatives` from kind on.
    A record without a block is an empty one; rows that repeat a record give their two rows each."""

    def run(batch):
        names = ["file", *(f.split(" ")[0] for f in _FIELDS.split(", "))]
        out = {k: [] for k in names}
        for file, headers, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for derived_headers, made in derive([(h["name"], h["value"] or "") for h in headers or () if h and h["name"]], block or b""):
                for k, v in zip(names, (file, *_row(derived_headers, made, whole)), strict=True):
                    out[k].append(v)
        yield out

    return map_rows(found.select("file", "headers", "block"), run, f"file string, {_FIELDS}", rows=100)


def derivatives(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str = NO_DATE, whole: bool = True) -> DataFrame:
    """Two rows a page: page_id, kind, record_id, refers_to, concurrent_to, target_uri, date, content_type, source_digest,
    block_digest, n_bytes, content (the block as text), record (the whole record, a gzip member of its own; null unless `whole`)."""

    def run(batch):
        names = ["page_id", *(f.split(" ")[0] for f in _FIELDS.split(", "))]
        out = {k: [] for k in names}
        for p, u, h in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for headers, block in derive(*response(p, u, h, date)):
                for k, v in zip(names, (p, *_row(headers, block, whole)), strict=True):
                    out[k].append(v)
        yield out

    return map_rows(pages.select(F.col(page_id).cast("long"), url, page), run, f"page_id long, {_FIELDS}")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write the `record` column as one .warc.gz for each partition in a folder that all executors share (a URI that
    pyarrow knows, or a path). Returns file and records. A task that runs again replaces its own file."""
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        place, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        place.create_dir(root, recursive=True)
        context, n = TaskContext.get(), 0
        name = f"{root}/derived-{context.partitionId():06d}.warc.gz"
        held = f"{name}.{context.taskAttemptId()}"
        with place.open_output_stream(held, compression=None) as out:
            for batch in batches:
                for r in batch.column(0):
                    out.write(r.as_py())
                    n += 1
        place.move(held, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return records.select("record").mapInArrow(run, "file string, records long")


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return derivatives(table(spark, sf_dir, "pages"), whole=False).drop("record").withColumn("content_sha256", F.sha2("content", 256))
