"""N-gram Jaccard self-join with Bayesian pruning of candidates.

A document is the set of its runs of five words. Documents with equal sets are one class, and one representative stands
for the class from there on. Candidates come from MinHash bands (BANDS of ROWS values: a pair at similarity 0.8 shares
no band with probability 1.3e-7). Candidates' MinHash values are then compared a few at a time; with m of n values
equal, the posterior probability that the similarity reaches the threshold (uniform prior) is known, and a pair is
dropped as soon as it falls below TOLERANCE. Pairs that are left are verified with the sets themselves.

No pair is ever a row. Within a bucket of candidates, pairs that survive only join documents to components, which
reads each bucket's members against those not yet joined. A component's documents are then compared with each other,
in blocks of BLOCK documents and pairs of blocks, so that a group of any size is spread over tasks of bounded size;
each block pair returns one row for a document: how many links it found, and one linked document to hold on to.

Defined results: a null or empty text has no set, and like a null doc_id no class but its own and no links; a text of
one to four words has itself as its only run; rows that repeat a doc_id are documents each; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, among, by_group, map_rows, stored, words
from .graph import components

#: Words of a run; similarity of a link; bands, values of a band; values compared one by one, and at a time.
RUN, THRESHOLD, BANDS, ROWS, COMPARED, STEP = 5, 0.8, 40, 5, 128, 16
TOLERANCE = 1e-9
#: Documents of a block.
BLOCK = 512
#: Rows of (id, hash, number) up to which such a table is broadcast rather than shuffled: 64 bytes each, 32 MB.
BROADCAST_ROWS = 500_000


@cache
def _worker() -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    n = BANDS * ROWS
    return Hashes(), rng.integers(1, 1 << 63, 64, np.uint64) * 2 + 1, rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 1 << 31, n, np.uint32) * 2 + 1


def shingles(text: str | None, run: int = RUN) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    hashes, odd, _, _ = _worker()
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    run = min(run, len(w))
    out = w[: len(w) - run + 1] * odd[0]
    for j in range(1, run):
        out += w[j : len(w) - run + 1 + j] * odd[j]
    out ^= out >> np.uint64(31)
    return np.unique(out)


def minhash(runs: np.ndarray) -> np.ndarray:
    _, _, flip, odd = _worker()
    low = (runs ^ (runs >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 1024):
        np.minimum(least, ((low[a : a + 1024, None] ^ flip) * odd).min(0), out=least)
    return least


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, tag, size of the set, digest of the set, compared values (one byte each), band keys. docs: doc_id, tag, text."""
    import xxhash

    def run(batch):
        out = {k: [] for k in ("size", "digest", "sig", "bands")}
        for t in batch.column(2).to_pylist():
            s = shingles(t)
            m = minhash(s)
            out["size"].append(len(s))
            out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()))
            out["sig"].append(((m[:COMPARED] * np.uint32(2654435769)) >> np.uint32(24)).astype(np.uint8).tobytes())
            rows = m.reshape(BANDS, ROWS)
            out["bands"].append([xxhash.xxh3_64_intdigest(rows[b].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)])
        yield {"doc_id": batch.column(0), "tag": batch.column(1)} | out

    return map_rows(docs, run, "doc_id long, tag long, size long, digest binary, sig binary, bands array<long>")


@cache
def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Values compared -> equal values that a pair must have to stay."""
    j = (np.arange(4000) + 0.5) / 4000
    c = j + (1 - j) / 256  # two different values agree in their byte once in 256
    out = {}
    for n in range(STEP, COMPARED + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(c) + (n - m) * np.log1p(-c)
            p = np.exp(log - log.max())
            if p[j >= threshold].sum() / p.sum() >= tolerance:
                out[n] = m
                break
    return out


def alive(sig: np.ndarray, p: int, others: np.ndarray) -> np.ndarray:
    """Those of `others` whose posterior with p stays above the tolerance."""
    agree = np.zeros(len(others), np.int64)
    for n, least in needed().items():
        agree += (sig[others, n - STEP : n] == sig[p, n - STEP : n]).sum(1)
        keep = agree >= least
        if not keep.all():
            others, agree = others[keep], agree[keep]
        if not len(others):
            break
    return others


def joined(ids: np.ndarray, sig: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join a bucket's documents to components by pairs that survive: one for each two components that become
    one. With two sides, only those that join across them, since each side meets by itself as well. Least ids come first,
    so that buckets that share documents give the same links."""
    order = np.argsort(ids)
    ids, sig, side = ids[order], sig[order], side[order]
    label, out, cross = np.arange(len(ids)), [], side.min() != side.max()
    for across in (False, True) if cross else (False,):
        for p in range(len(ids) - 1):
            others = np.flatnonzero((label[p + 1 :] != label[p]) & ((side[p + 1 :] != side[p]) == across)) + p + 1
            if len(others) and len(left := alive(sig, p, others)):
                if across == cross:
                    out += [(int(ids[p]), int(ids[x])) for x in left[np.unique(label[left], return_index=True)[1]]]
                label[np.isin(label, label[left])] = label[p]
    return out


def verified(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (by place) whose sets are similar enough. side: a pair counts across sides, or at all if there is one side."""
    sizes = np.array([len(s) for s in sets])
    columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    flags, cross, out = np.zeros(columns.max() + 1, np.int32), side.min() != side.max(), []
    for p in range(len(sets) - 1):
        others = np.arange(p + 1, len(sets))
        if cross:
            others = others[side[others] != side[p]]
        others = others[np.minimum(sizes[others], sizes[p]) >= threshold * np.maximum(sizes[others], sizes[p]) - 1e-9]
        others = alive(sig, p, others) if len(others) else others
        if not len(others):
            continue
        mine = columns[starts[p] : ends[p]]
        flags[mine] = 1
        both = np.array([flags[columns[starts[x] : ends[x]]].sum() for x in others])
        flags[mine] = 0
        out += [(p, int(x)) for x in others[both >= threshold * (sizes[p] + sizes[others] - both) - 1e-9]]
    return out


def in_blocks(df: DataFrame, count: str, doc: str) -> DataFrame:
    """Adds i and j: a group of `count` rows is cut into blocks of about BLOCK, and each pair of blocks meets once."""
    n = F.ceil(F.col(count) / BLOCK).cast("long")
    df = df.withColumn("own", F.pmod(F.xxhash64(doc), n))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return df.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def tagged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag, text. The tag, a hash of the text, tells rows apart that repeat a doc_id."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))


def join(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, tag, class_id, class_size, n_links (other documents at or above the threshold), group_id (the
    least doc_id that it is linked with, directly or through others), group_tag (of that document), able (has a set)."""
    named = tagged(docs, doc_id, text)
    every = stored(prints(named), "prints")
    able = every.where("size > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("digest").agg(F.min(F.struct("doc_id", "tag")).alias("least"), F.count("*").alias("class_size"), F.min("sig").alias("sig"), F.min("bands").alias("bands"))
    classes = stored(classes.select("digest", F.col("least.doc_id").alias("class_id"), F.col("least.tag").alias("class_tag"), "class_size", "sig", "bands", F.monotonically_increasing_id().alias("node")), "classes")
    # Buckets with more than one class.
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").count().where("count > 1")
    held = keys.join(shared, "key").join(classes.select("node", "sig"), "node")

    def bucket(t):
        ids, sig = t["node"].to_numpy(), np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(t), COMPARED)
        found = joined(ids, sig, t["own"].to_numpy())
        return {"a": [a for a, _ in found], "b": [b for _, b in found]}

    near = by_group(in_blocks(held, "count", "node").select("key", "i", "j", "own", "node", "sig"), ["key", "i", "j"], bucket, "a long, b long")
    likely = components(near)
    members = stored(likely.join(likely.groupBy("component").count(), "component").join(classes.select("node", "class_id", "class_tag", "class_size", "sig"), F.col("id") == F.col("node")).drop("id"), "members")

    def sets(batch):
        yield {"of": batch.column(0), "runs": [shingles(x).tobytes() for x in batch.column(1).to_pylist()]}

    # Texts meet their numbers alone. Beyond what may be broadcast, a Bloom filter keeps most other texts out of the shuffle.
    wanted = members.select(F.col("node").alias("of"), "class_id", "class_tag")
    if wanted.count() <= BROADCAST_ROWS:
        wanted, texts = F.broadcast(wanted), named
    else:
        texts = named.where(among(F.xxhash64("doc_id", "tag"), wanted.select(F.xxhash64("class_id", "class_tag").alias("h"))))
    one = texts.join(wanted, (F.col("doc_id") == F.col("class_id")) & (F.col("tag") == F.col("class_tag"))).select("of", "text")
    one = map_rows(one, sets, "of long, runs binary").dropDuplicates(["of"])
    one = stored(one.join(members, F.col("of") == F.col("node")).select("component", "count", "node", "class_size", "sig", "runs"), "sets")

    def block(t):
        t = t.sort_by("node")
        ids, weight, own = t["node"].to_pylist(), t["class_size"].to_pylist(), t["own"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(t), COMPARED)
        links, root = [0] * len(ids), list(range(len(ids)))

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        if t["i"][0] == t["j"][0] or len(set(own.tolist())) == 2:
            for a, b in verified([np.frombuffer(s, np.uint64) for s in t["runs"].to_pylist()], sig, own, threshold):
                links[a] += weight[b]
                links[b] += weight[a]
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        return {"node": ids, "links": links, "root": [ids[top(x)] for x in range(len(ids))]}

    found = stored(by_group(in_blocks(one, "count", "node"), ["component", "i", "j"], block, "node long, links long, root long"), "found")
    links = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    groups = components(found.where("node <> root"), "node", "root").select(F.col("id").alias("grouped"), F.col("component").alias("group"))
    first = groups.join(classes.select("node", "class_id", "class_tag"), F.col("grouped") == F.col("node")).groupBy("group").agg(F.min(F.struct("class_id", "class_tag")).alias("first"))
    known = classes.select(F.col("digest").alias("of"), "class_id", "class_tag", "class_size", "node").join(links, F.col("node") == F.col("linked"), "left").join(groups.join(first, "group"), F.col("node") == F.col("grouped"), "left")
    known = known.select("of", "class_id", "class_size", "links", F.coalesce("first.class_id", "class_id").alias("group_id"), F.coalesce("first.class_tag", "class_tag").alias("group_tag"))
    is_able = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    out = every.select("doc_id", "tag", is_able.alias("able"), F.when(is_able, F.col("digest")).alias("digest")).join(known, F.col("digest") == F.col("of"), "left")
    return out.select(
        "doc_id", "tag", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("class_size", F.lit(1)) - 1).alias("n_links"), F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_tag", "tag").alias("group_tag"), "able",
    )


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "group_id")
