"""Best-fit packing of tokenised documents by patterns whose repeat counts come from non-negative least squares.

A document is its token ids and a closing id 0; one longer than the capacity is cut into full pieces and a rest. Pieces
are packed by length alone, so the planning needs only the histogram of lengths, which never has more than `capacity`
entries whatever the corpus holds:

1. enumerate patterns: multisets of up to three lengths that fill a sequence exactly, or nearly;
2. fit non-negative repeat counts so that the patterns use up the histogram, least squares over the lengths;
3. round the counts down to what the histogram still has;
4. pack the residual lengths by best fit decreasing, on counts, and let a few leftovers join patterns with room.

The plan is a list of (lengths of a sequence, repeats). Pieces of one length are numbered across the cluster (salted
groups, one prefix sum of group sizes), and number r of a length takes slot r of that length in the plan.

Defined results: a null text is empty and still gives its closing id; rows are packed one by one, repeated or not;
an empty table gives no piece; other columns aren't read; a null doc_id keeps its null.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored, utf8

#: Distinct chunks whose ids a worker keeps; the store is emptied when it is full.
CACHE = 1_000_000
#: Pieces of one length are numbered in groups of about this many, or of the square root of their count if that is more.
SALT_ROWS = 256
_CLOSE = np.array([0], "<u4").tobytes()


def _chunk_table() -> bytes:
    table = bytearray(range(256))
    for i in range(ord("A"), ord("Z") + 1):
        table[i] = i + 32
    for i in b"\n\t\r":
        table[i] = 32
    return bytes(table)


_TABLE = _chunk_table()
def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: 256 + k for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
#: ASCII punctuation but for the apostrophe, which starts contractions.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


class Encoder(dict):
    """Token ids as little-endian unsigned 32-bit bytes, by chunk.

    Chunks between white space are encoded apart and kept, which this vocabulary allows: it drops white space and case,
    and neither its normaliser nor its word rule looks across white space. A chunk of Latin letters is one word to the
    pre-tokenizer, and a run of ASCII punctuation after it is another, so these go to the model directly; all else goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({b"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def _ids(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "surrogatepass")
        word = text.rstrip(_MARKS)
        if (word.isalpha() and max(word) < "\u0250" and "\u0130" not in word) or not word:
            parts = (word.lower().encode().decode("latin-1").translate(_LETTERS), text[len(word) :])
            ids = self._ids([t.id for x in parts if x for t in self.model.tokenize(x)])
        else:
            ids = self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, utf8(text).translate(_TABLE).split(b" ")))


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker: what it has learned serves the worker's later tasks too."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batch):
        encode = encoder(tokenizer)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(t) + _CLOSE
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for name, v in zip(out, (d, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(v)
        yield out

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(hist: np.ndarray, most: int = 4000) -> list[tuple[int, ...]]:
    """Few-document patterns that fill a sequence: one, two or three lengths that the histogram has."""
    cap = len(hist) - 1
    have = np.flatnonzero(hist)
    out = [(cap,)] if hist[cap] else []
    out += [(a, cap - a) for a in range(cap - 1, (cap - 1) // 2, -1) if hist[a] and hist[cap - a]]
    if len(have) < 3:
        return out
    # Three lengths: the middle one is spread evenly over what is left, so that each length is in a few patterns.
    per = max(1, most // len(have))
    for a in have[::-1]:
        rest = cap - int(a)
        mids = have[(have <= min(int(a), rest - 1)) & (have >= (rest + 1) // 2)]
        for b in mids[np.linspace(0, len(mids) - 1, min(per, len(mids))).astype(int)] if len(mids) else ():
            if (c := rest - int(b)) > 0 and hist[c]:
                out.append((int(a), int(b), c))
    return list(dict.fromkeys(out))


def nnls(rows: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Counts x >= 0 that minimise |A x - hist|², column p of A holding how often pattern p has each length.
    Cyclic coordinate descent: the columns have three entries at most."""
    x, left = np.zeros(len(rows)), hist.astype(float).copy()
    cols = [(list(c := Counter(p)), [c[k] for k in c], sum(v * v for v in c.values())) for p in rows]
    for _ in range(rounds):
        moved = 0.0
        for j, (ks, vs, norm) in enumerate(cols):
            step = max(-x[j], sum(left[k] * v for k, v in zip(ks, vs, strict=True)) / norm)
            if step:
                x[j] += step
                for k, v in zip(ks, vs, strict=True):
                    left[k] -= step * v
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def best_fit(left: np.ndarray, open_: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts. open_: patterns with room and their repeats, which may take more."""
    cap = len(left) - 1
    room: dict[int, Counter] = defaultdict(Counter)
    for p, k in open_:
        room[cap - sum(p)][p] += k
    free = np.zeros(cap + 1, np.int64)
    for r, c in room.items():
        free[r] = sum(c.values())
    for length in range(cap, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(free[length:])
            if not len(fits):  # new sequences, as full of this length as they get
                per = cap // length
                full, rest = divmod(n, per)
                for times, k in ((full, per), (1 if rest else 0, rest)):
                    if times:
                        room[cap - k * length][(length,) * k] += times
                        free[cap - k * length] += times
                break
            r = length + int(fits[0])
            p, have = next(iter(room[r].items()))
            k = min(n, have)
            room[r][p] -= k
            if not room[r][p]:
                del room[r][p]
            free[r] -= k
            room[r - length][(*p, length)] += k
            free[r - length] += k
            n -= k
    return [(p, k) for c in room.values() for p, k in c.items() if k]


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """hist[n]: pieces of length n, up to the capacity. Returns (lengths in order, repeats)."""
    left, done = hist.astype(np.int64).copy(), []
    done.append(((len(hist) - 1,), int(left[-1])))
    left[-1] = 0
    rows = patterns(left)
    x = nnls(rows, left)
    for j in np.argsort(-x, kind="stable"):
        c = Counter(rows[j])
        k = min(int(x[j] + 0.5), *(int(left[n]) // v for n, v in c.items()), 1 << 60)
        if k > 0:
            done.append((rows[j], k))
            for n, v in c.items():
                left[n] -= k * v
    return [(p, k) for p, k in best_fit(left, [d for d in done if d[1]]) if k]


def slots(packed: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first number of each run of slots, the run's first sequence, its offset in the sequence."""
    out: dict[int, list] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for p, k in packed:
        at = 0
        for n in p:
            out[n].append((used[n], sequence, at))
            used[n] += k
            at += n
        sequence += k
    return {n: tuple(np.array(v, np.int64) for v in zip(*rows, strict=True)) for n, rows in out.items()}


def number(cut: DataFrame, hist: np.ndarray) -> DataFrame:
    """Adds r: the number of a piece among those of its length, from 0. A length with many pieces is numbered in salted groups."""
    parts = F.array(*[F.lit(int(max(1, h // max(SALT_ROWS, int(h**0.5))))) for h in hist])
    spread = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.element_at(parts, (F.col("length") + 1).cast("int"))))
    sizes = spread.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    return spread.join(base, ["length", "salt"]).withColumn("r", F.col("base") + F.row_number().over(inside) - 1).drop("salt", "base")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer, capacity, doc_id, text), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for n, k in cut.groupBy("length").count().collect():  # at most `capacity` rows
        hist[n] = k
    where = slots(plan(hist), capacity) if hist.any() else {}
    import pyarrow as pa

    def run(batch):
        t = pa.Table.from_batches([batch])
        length, r = t["length"].to_numpy(), t["r"].to_numpy()
        seq, off = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for n in np.unique(length):
            mine = length == n
            first, sequence, at = where[int(n)]
            k = np.searchsorted(first, r[mine], "right") - 1
            seq[mine], off[mine] = sequence[k] + r[mine] - first[k], at[k]
        yield {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(seq), "offset": pa.array(off)}

    return map_rows(number(cut, hist), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
