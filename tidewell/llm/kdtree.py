"""Exact top-k search by inner product, with a KD-tree in every shard.

Vectors are dealt to shards of bounded size by a hash. A shard's tree splits at the median of its widest dimension, and
each node keeps the tight bounding box of its vectors. For a query q no vector in a box scores more than
sum(max(q_i * low_i, q_i * high_i)); the traversal opens the node with the highest bound first and ends when no bound
reaches the kth score so far. That score is passed on: a query first searches the shard that holds its own vector, and
the other shards start from the kth score found there.

Queries are a set that is stated beforehand, never broadcast. A shard is one task: its vectors come first and make the
tree, once for each of the two rounds; then the queries stream past it, a batch at a time.

Defined results: a vector that is null, or holds a null or a component that isn't finite, takes no part; only vectors
of one length are compared; rows are numbered, so that rows that repeat a vec_id are queries and candidates each, with a
list of their own, and a row is no candidate of itself alone; ties go to the smaller vec_id; an empty table gives no rows;
other columns aren't read. Components are integers: scores below 2**53 are exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a leaf and of a shard; queries whose bounds are worked out at once.
LEAF, SHARD, AT_ONCE = 256, 16_384, 512


class Tree:
    """Nodes in arrays: box, children or the run of rows. x: integer-valued float64 rows, ids ascending in each leaf."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.kids, self.run = [], [], [], []
        order = np.arange(len(x))
        todo = [(0, len(x), None)]
        while todo:
            a, b, parent = todo.pop()
            mine = order[a:b]
            node = len(self.kids)
            low, high = x[mine].min(0), x[mine].max(0)
            self.low.append(low)
            self.high.append(high)
            self.kids.append([])
            self.run.append((a, b))
            if parent is not None:
                self.kids[parent].append(node)
            if b - a > leaf and (high > low).any():
                wide, half = int((high - low).argmax()), (b - a) // 2
                order[a:b] = mine[np.argpartition(x[mine, wide], half)]
                todo += [(a, a + half, node), (a + half, b, node)]
        for (a, b), kids in zip(self.run, self.kids, strict=True):
            if not kids:
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        self.x, self.ids, self.rows = x[order], ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Highest score that each node's box allows, for each query."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, q: np.ndarray, own: int, k: int, bounds: np.ndarray, floor: float) -> list[tuple[float, int, int]]:
        """Best (score, id, row), at most k, of those that reach floor, without the row `own`. Ties to smaller ids."""
        best: list[tuple[float, int, int]] = []  # heap of (score, -id, -row): the worst first
        queue = [(-bounds[0], 0)] if bounds[0] >= floor else []
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            if self.kids[node]:
                for c in self.kids[node]:
                    if bounds[c] >= floor:
                        heapq.heappush(queue, (-bounds[c], c))
                continue
            a, b = self.run[node]
            scores = self.x[a:b] @ q
            for i in np.flatnonzero(scores >= floor):
                row = int(self.rows[a + i])
                if row == own:
                    continue
                item = (float(scores[i]), -int(self.ids[a + i]), -row)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -v, -r) for s, v, r in best]


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as double; only rows that take part."""
    x = F.col(embedding)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    fine = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    return vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, queries, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score. queries: condition on vec_id that states the query set."""
    rows = stored(integers(vectors, vec_id, embedding, scale).select("vec_id", "v", F.size("v").alias("size"), F.monotonically_increasing_id().alias("row")), "vectors")
    shards = max(1, -(-rows.count() // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    asked = rows.where(queries)
    fields = ("shard", "size", "kind", "row", "vec_id", "floor", "v")
    target = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        held, tree, now = [], None, None
        for batch in batches:
            shard, size, kind, row, ids, floor = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (size[1:] != size[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):
                if a == b:
                    continue
                if (shard[a], size[a]) != now:
                    now, held, tree = (shard[a], size[a]), [], None
                x = batch.column(6).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(size[a]))
                if kind[a] == 0:
                    held.append((x, ids[a:b], row[a:b]))
                    continue
                if tree is None:
                    if not held:  # no vector of that length here
                        continue
                    tree, held = Tree(*map(np.concatenate, zip(*held, strict=True))), []
                for c in range(0, b - a, AT_ONCE):
                    bounds = tree.bounds(x[c : c + AT_ONCE])
                    out = [(row[a + c + i], ids[a + c + i], v, s) for i in range(len(bounds)) for s, v, _ in tree.search(x[c + i], row[a + c + i], k, bounds[i], floor[a + c + i])]
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(target)], schema=target)

    def search(sent: DataFrame) -> DataFrame:
        """sent: queries with shard and floor."""
        held = rows.withColumn("kind", F.lit(0)).withColumn("floor", F.lit(0.0))
        both = held.select(*fields).unionByName(sent.withColumn("kind", F.lit(1)).select(*fields))
        return both.repartition("shard", "size").sortWithinPartitions("shard", "size", "kind").mapInArrow(run, "query long, query_id long, vec_id long, score double")

    found = stored(search(asked.withColumn("floor", F.lit(float("-inf")))), "home")
    if shards > 1:
        kth = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        known = asked.join(kth, F.col("row") == F.col("query"), "left").withColumn("floor", F.when(F.col("n") >= k, F.col("low")).otherwise(float("-inf")))
        others = known.withColumnRenamed("shard", "home").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).where("shard <> home")
        found = found.unionByName(search(others))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
