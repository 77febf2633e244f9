"""Removal of byte strings that an earlier document holds, exact to the byte, with suffixes sorted by external induction.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller id. What has to
be suffix-sorted is first cut down, without losing a match:

1. Texts are cut where their content says so. A cut piece, with the LENGTH - 1 bytes after it, that a smaller document
   holds as well is covered as a whole; its copies need no sorting. The smallest document with a string holds it in a
   piece of its own, so the pieces that are left still hold every match.
2. In the pieces that are left, each string of LENGTH bytes has an anchor: the GRAM bytes in it whose hash is least.
   Equal strings have equal anchors, so only strings whose anchor two documents have in such pieces can match.
3. Strings around such anchors are dealt to shards by anchor, and stream in sorted by anchor and hash: equal strings come
   one after the other, and all but the first are covered. A shard's suffixes are then sorted on disk (`suffix_sort`);
   neighbours that share LENGTH bytes are one string, and all its documents but the smallest are covered there.

No step holds a shard in memory: its text, what is known of its strings, the sorter's queues and orders, and the groups
of equal strings are files, read in chunks. Covered runs are sorted arrays in the shared folder that tasks look up, so
that no text is shuffled to meet them.

Defined results: a null text is empty; matches never cross documents; rows that repeat a doc_id are judged one by one and
don't cover each other; a null doc_id covers nothing and isn't covered; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, map_rows, shared_path, small_batches, stored
from .suffix_sort import HELD, Queues, narrow, read, suffixes

#: Bytes of a match; of an anchor; mean bytes of a piece (a power of two); of the window that decides a cut.
LENGTH, GRAM, PIECE, CUT = 50, 20, 256, 16
#: Characters of input for one shard: shards grow in number with the input.
SHARD_CHARS = 8_000_000
#: Shards of strings for each shard of anchors; documents whose strings a task holds before it sends them on; strings of
#: one anchor that wait for a second document; characters that a shard holds before it writes its files.
SPLIT, SLICE, WAITING, BUFFER = 8, 1_000, 2_000, 1 << 18


# ---------------------------------------------------------------- equal strings of a shard


def alike(t: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """For each suffix but the first: whether it shares `length` characters with the one before it."""
    a, b = rows[:-1], rows[1:]
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    for k in range(length - 1, -1, -1):  # from the far end, where unequal neighbours differ soonest
        fail = t[a[live] + k] != t[b[live] + k]
        same[live[fail]] = False
        live = live[~fail]
    return same


class Shard:
    """Strings of a shard in files, and the runs of their starts that a smaller document covers."""

    def __init__(self, held: int, length: int):
        self.held, self.length, self.strings, self.size, self.buffer, self.room = held, length, 0, 0, [], BUFFER
        self.folder = tempfile.mkdtemp(prefix="suffixes-")  # the worker's own disk: gone when the shard is done
        self.files = {k: open(os.path.join(self.folder, k), "wb") for k in ("text", "fits", "start", "doc", "r1", "r2", "at")}

    def add(self, strings: list[tuple[bytes, int, int, int, int]]) -> None:
        """Strings with their document, their row's key, and where in the row each begins. Most anchors bring a few
        strings, so those of many are written together."""
        self.buffer += strings
        self.strings += len(strings)
        self.room -= sum(len(s[0]) for s in strings)
        if self.room < 0:
            self.write()

    def write(self) -> None:
        if not self.buffer:
            return
        texts, *others = zip(*self.buffer, strict=True)
        self.buffer, self.room = [], BUFFER
        (np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 2).tofile(self.files["text"])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = self.size + np.cumsum(size + 1)
        starts = np.maximum(size - self.length + 1, 0)  # those of a whole string, then the rest
        np.repeat(np.tile(np.array([1, 0], np.uint8), len(texts)), np.stack([starts, size + 1 - starts], 1).ravel()).tofile(self.files["fits"])
        for k, v in zip(("start", "doc", "r1", "r2", "at"), (ends - size - 1, *others), strict=True):
            np.asarray(v, np.int64).tofile(self.files[k])
        self.size = int(ends[-1])

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        shutil.rmtree(self.folder, ignore_errors=True)

    def covered(self) -> Iterator[dict[str, np.ndarray]]:
        """r1, r2, start, end of covered runs."""
        if not self.strings:
            return
        self.write()
        self.files["text"].write(b"\0\0")
        for f in self.files.values():
            f.flush()
        held = lambda k, kind: np.asarray(np.memmap(os.path.join(self.folder, k), kind, "r"))
        t, fits, (start, doc, r1, r2, at) = held("text", np.uint16), held("fits", np.bool_), (held(k, np.int64) for k in ("start", "doc", "r1", "r2", "at"))
        owner = lambda rows: np.searchsorted(start, rows, "right") - 1
        chunk = max(1, self.held // 8)
        # Suffixes in order, their groups of equal strings, and the least document of each group.
        paths = [os.path.join(self.folder, k) for k in ("order", "group", "least", "owner")]
        count, last, low = 0, np.zeros(0, np.int64), None
        with open(paths[0], "wb") as order, open(paths[1], "wb") as group, open(paths[2], "wb") as least, open(paths[3], "wb") as owners:
            for rows in suffixes(t, self.folder, self.held):
                rows = np.ascontiguousarray(rows)
                rows = rows[rows < self.size]
                rows = rows[fits[rows]]
                if not len(rows):
                    continue
                of = owner(rows)
                new = np.ones(len(rows), bool)
                both = np.concatenate([last, rows])
                new[len(rows) - len(both) + 1 :] = ~alike(t, both, self.length)
                number = count + np.cumsum(new) - 1
                rows.tofile(order)
                number.tofile(group)
                d = doc[of]
                d.tofile(owners)
                if low is not None and not new[0]:
                    d = np.append(low, d)
                    new = np.append(True, new)
                    new[1] = False
                elif low is not None:
                    np.array([low]).tofile(least)
                lows = np.minimum.reduceat(d, np.flatnonzero(new))
                lows[:-1].tofile(least)
                low, last, count = lows[-1], rows[-1:], int(number[-1]) + 1
            if low is not None:
                np.array([low]).tofile(least)
        if not count:
            return
        lows = np.memmap(paths[2], np.int64, "r")
        hits = Queues(self.folder, self.held // 8)
        for rows, number, d in zip(*[read(paths[k], chunk) for k in (0, 1, 3)], strict=True):
            rows = rows[lows[number] < d]
            for k in np.unique(rows // chunk):
                hits.put(int(k), rows[rows // chunk == k])
        for k in range(-(-self.size // chunk)):
            rows = np.sort(hits.all(k))
            if len(rows):
                of = owner(rows)
                first = np.flatnonzero(np.concatenate([[True], (np.diff(rows) != 1) | (of[1:] != of[:-1])]))
                end = np.append(first[1:], len(rows)) - 1
                base = (at[of[first]] - start[of[first]])
                yield {"r1": r1[of[first]], "r2": r2[of[first]], "start": rows[first] + base, "end": rows[end] + base + 1}


# ---------------------------------------------------------------- hashes


@cache
def _table() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * 2 + 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    r = 0x9E3779B97F4A7C15
    inverse = pow(r, -1, 1 << 64)
    out = []
    for base in (r, inverse):
        p = np.ones(n, np.uint64)
        p[1:] = np.uint64(base)
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return tuple(out)


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place."""
    n = len(x)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(16, (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    terms = _table().take(x)
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    h = np.subtract(sums[k:], sums[:-k], out=terms[: n - k + 1])
    h *= down[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def pieces(x: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where the pieces of a text begin, and the end of its last start, as places 0 ... len - length + 1."""
    last = len(x) - length + 1
    if last <= 0:
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(rolling(x, CUT) & np.uint64(PIECE - 1) == 0) + CUT
    return np.concatenate([[0], cut[cut < last], [last]])


def turns(h: np.ndarray) -> np.ndarray:
    """Where a value begins that differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


def anchors(x: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Anchor hash of each start."""
    h = rolling(x, GRAM)
    return window_min(h, length - GRAM + 1) if len(x) >= length else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- the operator


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, int.from_bytes(raw[:8], "little"), at))
        at += out[-1].nbytes
    return out


def _columns(rows: list[tuple], n: int) -> list:
    return list(zip(*rows, strict=True)) if rows else [()] * n


def _bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, as Arrow holds them. A null is empty."""
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    return [x or b"" for x in raw.to_pylist()]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """r1, r2, doc and bytes of each row of a batch."""
    return zip(*[batch.column(k).to_pylist() for k in range(3)], _bytes(batch.column(3)), strict=True)


def cut_pieces(docs: DataFrame) -> DataFrame:
    """r1, r2, doc, start, end and 128-bit key of each piece. docs: r1, r2, doc, text."""
    import xxhash

    def run(batch):
        names, rows, keys = ("r1", "r2", "doc", "start", "end", "k1", "k2"), [], []
        for r1, r2, doc, raw in _rows(batch):
            cuts = pieces(np.frombuffer(raw, np.uint8)).tolist()
            rows += [(r1, r2, doc, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            keys += [xxhash.xxh3_128_digest(raw[a : b + LENGTH - 1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield dict(zip(names, (*_columns(rows, 5), pa.array(both[:, 0]), pa.array(both[:, 1])), strict=True))

    return map_rows(docs, run, "r1 long, r2 long, doc long, start int, end int, k1 long, k2 long")


class Runs:
    """Covered runs by row, as sorted arrays that tasks map and look up."""

    def __init__(self, runs: DataFrame, shards: int):
        """runs: r1, r2, start, end. A row's runs are of one text, a shard's of the rows of its share of the keys."""
        from .lm import _save

        self.folder, self.shards = shared_path(runs.sparkSession, "runs"), shards
        folder = self.folder

        def add(t):
            r1, r2, a, b = (t[c].to_numpy() for c in ("r1", "r2", "start", "end"))
            order = np.lexsort((a, r2, r1))
            shard = t["shard"][0].as_py()
            _save(folder, str(shard), r1=r1[order], r2=r2[order], start=a[order].astype(np.int32), end=b[order].astype(np.int32))
            return {"n": [len(order)]}

        by_group(runs.withColumn("shard", F.pmod("r1", F.lit(shards))), ["shard"], add, "n long").agg(F.sum("n")).collect()

    def of(self, r1: int, r2: int) -> np.ndarray:
        """(start, end) of each run of a row, by start."""
        from .lm import _store

        store, shard = _store(self.folder), r1 % self.shards
        keys = store.get(f"{shard}-r1")
        if keys is None:
            return np.zeros((0, 2), np.int64)
        a, b = np.searchsorted(keys, r1, "left"), np.searchsorted(keys, r1, "right")
        mine = slice(a, b)
        runs = np.stack([store.get(f"{shard}-start")[mine], store.get(f"{shard}-end")[mine]], 1)
        return runs[store.get(f"{shard}-r2")[mine] == r2]


def open_starts(raw: bytes, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of each start, and whether the start lies outside the covered runs. A text without such starts isn't hashed."""
    left = np.ones(max(0, len(raw) - LENGTH + 1), bool)
    for a, b in runs:
        left[a:b] = False
    return anchors(np.frombuffer(raw, np.uint8)) if left.any() else np.zeros(len(left), np.uint64), left


def repeated_anchors(docs: DataFrame, shards: int, runs: Runs) -> str:
    """Folder of sorted arrays, one for each shard of the hash range: anchors that two documents or more have in the
    pieces that are left. docs: r1, r2, doc, text; runs: pieces that are covered.

    A task packs each anchor of a batch once, with one document and whether the batch has another, so that an anchor of
    any number of documents is few rows."""
    from .lm import _save

    def pack(batch):
        hashes, owners = [], []
        for r1, r2, doc, raw in _rows(batch):
            h, left = open_starts(raw, runs.of(r1, r2))
            h = h[left]
            if len(h):
                hashes.append(h[turns(h)])
                owners.append(np.full(len(hashes[-1]), doc, np.int64))
        out = {"shard": [], "blob": []}
        if hashes:
            h, d = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h)
            h, d = h[order], d[order]
            new = turns(h)
            low, many = np.minimum.reduceat(d, new), np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)
            h = h[new]
            of = narrow(shard_of(h, shards))
            order = np.argsort(of, kind="stable")  # by hash within a shard
            h, low, many = h[order], low[order], many[order]
            cuts = np.searchsorted(of[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[s], cuts[s + 1])
                out["shard"].append(int(s))
                out["blob"].append(_pack(np.diff(h[part], prepend=np.uint64(0)), low[part], many[part]))
        yield out

    folder = shared_path(docs.sparkSession, "anchors")

    def add(t):
        got = [_unpack(x, "<u8", "<i8", "?") for x in t["blob"].to_pylist()]
        h, d, many = (np.concatenate(x) for x in zip(*[(np.cumsum(h, dtype=np.uint64), d, m) for h, d, m in got], strict=True))
        order = np.argsort(h)
        h, d, many = h[order], d[order], many[order]
        new = turns(h)
        again = np.maximum.reduceat(many, new) | (np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new))
        shard = t["shard"][0].as_py()
        _save(folder, str(shard), anchors=h[new][again])
        return {"shard": [shard], "anchors": [int(again.sum())]}

    by_group(map_rows(docs, pack, "shard long, blob binary", rows=2_500), ["shard"], add, "shard long, anchors long").agg(F.sum("anchors")).collect()
    return folder


#: Anchors are the least hashes of their neighbours: they are mixed again before their high bits say where they go.
_MIX = 0x9E3779B97F4A7C15


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h * np.uint64(_MIX) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def candidates(docs: DataFrame, folder: str, shards: int, runs: Runs) -> DataFrame:
    """Strings around repeated anchors in the pieces that are left. docs: r1, r2, doc, text; runs: pieces
    that are covered.

    Returns kind, r1, r2, doc, start, end, shard, anchor, hash, text. Of equal strings in a slice of a batch only the
    smallest document's go on (kind 1); those of the others are covered already (kind 0: starts from start to end)."""
    from .lm import _store

    def run(batch):
        store, texts = _store(folder), []
        for r1, r2, doc, raw in _rows(batch):
            h, left = open_starts(raw, runs.of(r1, r2))
            at = np.flatnonzero(left)
            if len(at):
                # Runs of starts with one anchor.
                new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (h[at[1:]] != h[at[:-1]])]))
                texts.append((doc, r1, r2, raw, at[new], at[np.append(new[1:], len(at)) - 1] + 1, h[at[new]]))
        mine = np.concatenate([x[-1] for x in texts]) if texts else np.zeros(0, np.uint64)
        of, hit = narrow(shard_of(mine, shards)), np.zeros(len(mine), bool)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            held = store.get(f"{s}-anchors")
            if held is not None and len(held):
                some = order[cuts[s] : cuts[s + 1]]
                hit[some] = held[np.minimum(np.searchsorted(held, mine[some]), len(held) - 1)] == mine[some]
        on, strings, n, done = np.flatnonzero(hit), [], [], 0
        for _, _, _, raw, first, last, h in texts:
            some = hit[done : done + len(h)]
            done += len(h)
            strings += [raw[a:b] for a, b in zip(first[some].tolist(), (last[some] + LENGTH - 1).tolist(), strict=True)]
            n.append(int(some.sum()))
        doc, r1, r2 = (np.repeat(np.array([x[k] for x in texts], np.int64), n) for k in range(3))
        start, end = (np.concatenate([x[k] for x in texts])[on] if texts else on for k in (4, 5))
        # Equal strings have equal anchors. Those of a larger document than another's go no further.
        seen, covered, same = {}, np.zeros(len(on), bool), {}
        for i, string in enumerate(strings):
            if (first := seen.setdefault(string, i)) != i:
                same.setdefault(first, [first]).append(i)
        for group in same.values():
            covered[group] = doc[group] > doc[group].min()
        anchor = mine[on]
        digests = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings)) >> np.uint64(1)
        yield {
            "kind": 1 - covered.astype(np.int32), "r1": r1, "r2": r2, "doc": doc, "start": start, "end": end,
            "shard": pa.array(shard_of(anchor, SPLIT * shards), mask=covered),
            "anchor": anchor.view(np.int64),
            "hash": pa.array(digests.view(np.int64), mask=covered),
            "text": [None if c else string for string, c in zip(strings, covered.tolist(), strict=True)],
        }

    import xxhash

    return map_rows(docs, run, "kind int, r1 long, r2 long, doc long, start int, end int, shard long, anchor long, hash long, text binary", rows=SLICE)


def sorted_shards(strings: DataFrame, held: int | None = None) -> DataFrame:
    """Covered runs of the shards' strings: r1, r2, start, end. strings: shard, anchor, hash, doc, r1, r2, start, text.

    A shard streams in, by anchor, hash and document. Of equal strings the first one's document is the smallest: the
    others are covered, but for those of the same document. An anchor's other strings wait until a second document has one: alone, a document matches nothing."""
    target = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def packed(columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    def run(batches):
        now, shard, first, waiting, docs = (None, None), None, (None, None), [], set()

        def flushed():
            nonlocal waiting
            if len(docs) > 1:
                shard.add(waiting)
            waiting = []

        try:
            for batch in batches:
                rows = []
                numbers = [batch.column(i).to_numpy().tolist() for i in (0, 1, 3, 4, 5, 6)]
                for s, anchor, doc, r1, r2, at, text in zip(*numbers, batch.column(7).to_pylist(), strict=True):
                    if (s, anchor) != now:
                        if shard is not None:
                            flushed()
                        if s != now[0]:
                            if shard is not None:
                                yield from map(packed, shard.covered())
                                shard.close()
                            shard = Shard(held or HELD, LENGTH)
                        now, first, docs = (s, anchor), (None, None), set()
                    if text == first[0] and doc != first[1]:
                        rows.append((r1, r2, at, at + len(text) - LENGTH + 1))
                        continue
                    if text != first[0]:
                        first = (text, doc)
                    docs.add(doc)
                    waiting.append((text, doc, r1, r2, at))
                    if len(waiting) >= WAITING and len(docs) > 1:
                        flushed()
                yield packed(dict(zip(target.names, _columns(rows, 4), strict=True)))
            if shard is not None:
                flushed()
                yield from map(packed, shard.covered())
        finally:
            if shard is not None:
                shard.close()

    small_batches(strings.sparkSession)
    order = ("shard", "anchor", "hash", "doc")
    return strings.select(*order, "r1", "r2", "start", "text").repartition("shard").sortWithinPartitions(*order).mapInArrow(run, "r1 long, r2 long, start int, end int")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, spans (maximal removed runs of bytes), kept_sha256, kept (if `whole`)."""
    every = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # A row's key of 128 bits, from its doc_id and text: rows that are equal in both are judged alike.
    every = every.withColumn("r1", F.xxhash64("doc_id", "text")).withColumn("r2", F.xxhash64(F.lit(1), "text", "doc_id")).withColumn("doc", F.col("doc_id").cast("long"))
    able = every.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH)).select("r1", "r2", "doc", "text")
    shards = int((able.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS) + 4
    cut = stored(cut_pieces(able), "cut")
    more = cut.groupBy("k1", "k2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), "least")
    settled = stored(cut.join(more, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2"))).where("least < doc").select("r1", "r2", "start", "end"), "pieces")
    whole_pieces = Runs(settled, shards)
    rest = stored(candidates(able, repeated_anchors(able, shards, whole_pieces), shards, whole_pieces), "strings")
    found = settled.unionByName(rest.where("kind = 0").select("r1", "r2", "start", "end")).unionByName(sorted_shards(rest.where("kind = 1")))
    runs = Runs(found, shards)

    def run(batch):
        rows = []
        for raw, r1, r2 in zip(_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            spans: list[list[int]] = []
            for a, b in runs.of(r1, r2).tolist():
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b + LENGTH - 1)
                else:
                    spans.append([a, b + LENGTH - 1])
            edges = [0, *[x for s in spans for x in s], len(raw)]
            kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if spans else raw
            rows.append((len(raw), len(raw) - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept if whole else None))
        yield {"doc_id": batch.column(0)} | dict(zip(("n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"), _columns(rows, 6), strict=True))

    kind = every.schema["doc_id"].dataType.simpleString()
    return map_rows(every.select("doc_id", "text", "r1", "r2"), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"), whole=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
