"""Usage as a stream: each batch of immutable delta files is merged, and winners may be revised by later lines.

No watermark: a late line counts like any other, so that the rollups always equal those of a batch build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import usage as U
from ..plans.tables import VersionedTables
from ..sources.scratch import written


def latest(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The last write of each uuid: a batch's rows replace those of earlier ones."""
    fresh = U.latest_by_uuid(batch, F.col("line_no"))
    return old.join(fresh.select("uuid"), "uuid", "left_anti").unionByName(fresh)


def winners(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The winner of each message among those before and the batch."""
    return U.winner_per_message(old.unionByName(batch))


def blocks(events: DataFrame) -> DataFrame:
    """Five-hour tumbling windows from the epoch: block start, events, tokens. events: ts (timestamp), total_tokens."""
    return events.groupBy(F.window("ts", "5 hours").alias("w")).agg(F.count("*").alias("events"), F.sum("total_tokens").alias("total_tokens")).select(F.col("w.start").alias("start"), "events", "total_tokens")


class Merged(VersionedTables):
    """A table that a stream's batches are merged into, dealt to buckets by a key: a batch writes the buckets that it
    touches. The state holds the batch that was merged last, so that one that runs again changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        super().__init__(spark, folder)
        self.keys = {"rows": key}

    def rows(self) -> DataFrame:
        return self.table("rows")

    def merge(self, batch: DataFrame, number: int, combine) -> None:
        if self.state().get("batch", -1) >= number:
            return
        batch = written(batch, "batch")
        if not self.exists("rows"):
            self.commit({"rows": combine(batch.limit(0), batch)}, batch=number)
            return
        touched = [r["b"] for r in batch.select(self.bucket("rows").alias("b")).distinct().collect()]  # at most `buckets`
        self.commit({"rows": combine(self.table("rows", touched), batch)}, {"rows": touched}, batch=number)


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str = "uuid", combine=latest) -> StreamingQuery:
    """Merge a stream into the table at `path` (`Merged(...).rows()`). Batches are bounded by the reader's maxFilesPerTrigger."""
    def merge(batch: DataFrame, number: int) -> None:
        Merged(batch.sparkSession, path, key).merge(batch, number, combine)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_lines(stream: DataFrame) -> DataFrame:
    """First arrival of each uuid, exactly once."""
    return stream.dropDuplicates(["uuid"])
