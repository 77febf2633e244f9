"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Tokens are hashed to 64 bits. Tasks count pairs (token before, token) and pack their counts into one binary row for each
bucket of preceding tokens, so that a shuffle carries about ten bytes for a distinct pair of a task. A bucket's task adds
the counts up and writes sorted hash arrays to the shared folder: pairs with counts; preceding tokens with their totals
and their numbers of followers seen once, twice and more. Token counts and continuation counts are gathered the same way
by bucket of tokens. Workers memory-map the arrays and look tokens up by binary search.

With discounts D1, D2, D3+ from the counts of counts,
    P(w | v) = (c(v, w) - D) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3(v)) / c(v) * P(w)
    P(w)     = (n(. w) - D') / n(. .) + (D1' N1 + D2' N2 + D3' N3) / n(. .) / (V + 1)
where n(. w) is the number of distinct tokens before w, and the last term also serves unknown tokens.

A bucket holds the followers of its preceding tokens: those of one very frequent token are in one bucket, of which a task
holds the distinct pairs, ten bytes each, however often they occur.

Defined results: a null text is empty and is scored for its end alone; nothing to learn from gives every token
probability 1 / (V + 1) = 1; rows are handled one by one, repeated or not; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import os
import tempfile
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Hashes, by_group, held_out, map_rows, shared_path, stored, utf8

#: Characters of training text for one bucket; distinct pairs a task holds before it hands them on; tokens scored at once.
BUCKET_CHARS, HELD_PAIRS, AT_ONCE = 24_000_000, 2_000_000, 200_000
_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PAIR = np.dtype([("v", "<u8"), ("w", "<u8"), ("c", "<u8")])
_WORD = np.dtype([("w", "<u8"), ("c", "<u8"), ("n", "<u8")])


@cache
def _hashes() -> Hashes:
    return Hashes()


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens and its end."""
    found = utf8(text).translate(_TABLE).split()
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hashes().__getitem__, found), np.uint64, len(found))
    out[-1] = END
    return out


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token before, token, and where each text ends."""
    parts = [token_hashes(t) for t in texts]
    w = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[0] = START
    v[ends[:-1]] = START
    return v, w, ends


def key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a pair."""
    h = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal shares of the hash range."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def summed(columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the columns, sorted by the first, and the sums of their counts."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, counts
    first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
    return [c[first] for c in columns], [np.add.reduceat(c[order], first) for c in counts]


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 8
    n = int.from_bytes(raw[:8], "little")
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _blobs(bucket: np.ndarray, buckets: int, *arrays: np.ndarray):
    """A packed row for each bucket; the first array is stored as differences. Rows are sorted by bucket already."""
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        part = [a[cuts[b] : cuts[b + 1]] for a in arrays]
        yield int(b), _pack(np.diff(part[0], prepend=np.uint64(0)), *part[1:])


def _pairs(buckets: int):
    """Batches of texts -> rows (bucket, blob) of pair counts."""
    import pyarrow as pa

    def run(batches):
        vs, ws, cs, n = [], [], [], 0

        def flush():
            (v, w), (c,) = summed([np.concatenate(vs), np.concatenate(ws)], [np.concatenate(cs)])
            rows = list(_blobs(bucket_of(v, buckets), buckets, v, w, c.astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 500):
                v, w, _ = tokens(texts[a : a + 500])
                (v, w), (c,) = summed([v, w], [np.ones(len(v), np.int64)])
                vs.append(v), ws.append(w), cs.append(c)
                n += len(v)
                if n > 2 * HELD_PAIRS:
                    (v, w), (c,) = summed([np.concatenate(vs), np.concatenate(ws)], [np.concatenate(cs)])
                    vs, ws, cs, n = [v], [w], [c], len(v)
                    if n > HELD_PAIRS:
                        yield flush()
                        vs, ws, cs, n = [], [], [], 0
        if n:
            yield flush()

    return run


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """One .npy file for each array; a task that runs again replaces its own files."""
    import io
    import uuid

    place, root = _place(folder)
    place.create_dir(root, recursive=True)
    for k, a in arrays.items():
        out = io.BytesIO()
        np.save(out, a)
        held = f"{root}/.{name}-{k}-{uuid.uuid4().hex}"
        with place.open_output_stream(held, compression=None) as f:
            f.write(out.getbuffer())
        place.move(held, f"{root}/{name}-{k}.npy")


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


class Store:
    """The model's arrays, memory-mapped. Of a folder of another file system, the arrays that are asked for are copied to a
    temporary folder of the worker, where its executor's own temporary files are."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.place, self.root = _place(folder)
        self.own = None if isinstance(self.place, fs.LocalFileSystem) else tempfile.mkdtemp(prefix="arrays-")
        self.open: dict[str, np.ndarray | None] = {}

    def get(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = f"{self.root}/{name}.npy"
            if self.own is not None:
                path = self._fetched(path)
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def _fetched(self, path: str) -> str:
        from pyarrow import fs

        here = f"{self.own}/{os.path.basename(path)}"
        if self.place.get_file_info(path).type != fs.FileType.NotFound:
            fs.copy_files(path, here, source_filesystem=self.place, destination_filesystem=fs.LocalFileSystem())
        return here

    def look_up(self, kind: str, hashes: np.ndarray, where: np.ndarray, buckets: int, *values: str) -> list[np.ndarray]:
        """Values of each hash, 0 where it isn't there. where: bucket of each."""
        out = [np.zeros(len(hashes), np.float64) for _ in values]
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[b] : cuts[b + 1]]
            held = self.get(f"{b}-{kind}")
            if held is None:
                continue
            at = np.minimum(np.searchsorted(held, hashes[rows]), len(held) - 1)
            hit = held[at] == hashes[rows]
            for o, v in zip(out, values, strict=True):
                o[rows[hit]] = self.get(f"{b}-{v}")[at[hit]]
        return out


@cache
def _store(folder: str) -> Store:
    return Store(folder)


def _discounts(n: list[float]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of counts 1 to 4."""
    if not all(n[:2]):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k - 0.5 for k in (1, 2, 3)]
    return tuple(min(max(x, 0.01), k - 0.01) for k, x in zip((1, 2, 3), d, strict=True))


def train(docs: DataFrame, text: str = "text") -> dict:
    """Count, write the arrays, and return the model's few numbers and its folder."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = int(chars // BUCKET_CHARS) + 8
    folder = shared_path(spark, "lm")

    def counts(x: np.ndarray) -> list[int]:
        return [int((x == k).sum()) for k in (1, 2, 3, 4)] + [int((x >= 3).sum())]

    def add_pairs(t):
        b = t["bucket"][0].as_py()
        got = [_unpack(x, "<u8", "<u8", "<u4") for x in t["blob"].to_pylist()]
        v, w, c = (np.concatenate(x) for x in zip(*[(np.cumsum(v, dtype=np.uint64), w, c) for v, w, c in got], strict=True))
        (v, w), (c,) = summed([v, w], [c.astype(np.int64)])
        k = key(v, w)
        order = np.argsort(k)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        per = lambda x: np.add.reduceat(x, first)
        _save(folder, str(b), pairs=k[order], count=c[order].astype(np.uint32), before=v[first], total=per(c), once=per((c == 1).astype(np.int64)), twice=per((c == 2).astype(np.int64)), more=per((c > 2).astype(np.int64)))
        (word,), (c2, n) = summed([w], [c, np.ones(len(c), np.int64)])
        rows = list(_blobs(bucket_of(word, buckets), buckets, word, c2, n.astype(np.uint32)))
        return {"kind": [0] + [1] * len(rows), "bucket": [b] + [x for x, _ in rows], "blob": [None] + [x for _, x in rows], "n": [counts(c)] + [None] * len(rows)}

    def add_words(t):
        b = t["bucket"][0].as_py()
        got = [_unpack(x, "<u8", "<i8", "<u4") for x in t["blob"].to_pylist()]
        w, c, n = (np.concatenate(x) for x in zip(*[(np.cumsum(w, dtype=np.uint64), c, n) for w, c, n in got], strict=True))
        (w,), (c, n) = summed([w], [c, n.astype(np.int64)])
        _save(folder, str(b), words=w, seen=c, kinds=n)
        return {"n": [counts(n) + [int(c.sum()), len(w), int(n.sum())]]}

    packed = docs.select(text).mapInArrow(_pairs(buckets), "bucket long, blob binary")
    added = stored(by_group(packed, ["bucket"], add_pairs, "kind int, bucket long, blob binary, n array<long>"), "lm-words")
    total = lambda df, k: [float(x or 0) for x in df.agg(*[F.sum(F.get("n", F.lit(i))) for i in range(k)]).first()]
    pair_counts = total(added.where("kind = 0"), 5)
    word_counts = total(stored(by_group(added.where("kind = 1").select("bucket", "blob"), ["bucket"], add_words, "n array<long>"), "lm-totals"), 8)
    n, v, kinds = word_counts[5:]
    once, twice, more = word_counts[0], word_counts[1], word_counts[4]
    low = _discounts(word_counts[:4])
    return {"folder": folder, "buckets": buckets, "n": int(n), "v": int(v), "kinds": kinds, "discounts": _discounts(pair_counts[:4]), "low": low, "rest": (low[0] * once + low[1] * twice + low[2] * more) / kinds if kinds else 1.0}


def probabilities(model: dict, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(w | v), count of w) for each token."""
    store, buckets = _store(model["folder"]), model["buckets"]
    seen, kinds = store.look_up("words", w, bucket_of(w, buckets), buckets, "seen", "kinds")
    cut = lambda c, d: np.where(c >= 3, d[2], np.where(c >= 2, d[1], np.where(c >= 1, d[0], 0.0)))
    p = model["rest"] / (model["v"] + 1)
    if model["kinds"]:
        p = p + (kinds - cut(kinds, model["low"])) / model["kinds"]
    where = bucket_of(v, buckets)
    total, once, twice, more = store.look_up("before", v, where, buckets, "total", "once", "twice", "more")
    (c,) = store.look_up("pairs", key(v, w), where, buckets, "count")
    d = model["discounts"]
    known = np.maximum(total, 1)
    return np.where(total > 0, (c - cut(c, d)) / known + (d[0] * once + d[1] * twice + d[2] * more) / known * p, p), seen


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score (log10), perplexity."""

    def run(batch):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "perplexity")}
        floor = np.log10(model["n"] + 0.5 * (model["v"] + 1))
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < AT_ONCE):
                size += len(texts[end] or "") // 5 + 1
                end += 1
            v, w, ends = tokens(texts[at:end])
            starts = np.concatenate([[0], ends[:-1]])
            p, seen = np.empty(len(w)), np.empty(len(w))
            for a in range(0, len(w), AT_ONCE):
                p[a : a + AT_ONCE], seen[a : a + AT_ONCE] = probabilities(model, v[a : a + AT_ONCE], w[a : a + AT_ONCE])
            n = ends - starts
            log = np.add.reduceat(np.log10(p), starts)
            out["n_tokens"] += n.tolist()
            out["n_known"] += np.add.reduceat((seen > 0).astype(np.int64), starts).tolist()
            out["base_score"] += np.add.reduceat(np.log10(seen + 0.5) - floor, starts).tolist()
            out["score"] += log.tolist()
            out["perplexity"] += (10 ** np.minimum(-log / n, 300)).tolist()
            at = end
        yield {"doc_id": ids} | out

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text), run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(5, 1)).select("text"))
    out = score(docs, model)
    return out.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
