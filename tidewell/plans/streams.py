"""Streaming versions of two catalogue queries: the stream runs to its end and its final table is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage as U
from ..sources.scratch import shared_folder
from ..streaming import usage as S
from .catalogue import _USAGE, query, usage


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a file stream. Only the file's folder and name differ from the batch input."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")


class _Stream:
    """Gives `usage` a reader whose tables are streams."""

    def __init__(self, df: DataFrame):
        self.read, self.df = self, df

    def parquet(self, path: str) -> DataFrame:
        return self.df


def _folders(spark: SparkSession) -> tuple[str, str]:
    """Of a new table and of its stream's checkpoint, in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{folder}/table", f"{folder}/checkpoint"


def _last(df: DataFrame) -> DataFrame:
    """The table that a complete-mode aggregate ends with."""
    table, checkpoint = _folders(df.sparkSession)
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/{number}")
        done.append(number)

    df.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{table}/{done[-1]}") if done else df.sparkSession.createDataFrame([], df.schema)


@query("stream_dedup_daily", f"WITH {_USAGE} SELECT date, count(*) AS events, count(DISTINCT session_id) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM dedup GROUP BY date")
def dedup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners kept by merging batches into buckets of sessions."""
    table, checkpoint = _folders(spark)
    S.upsert(usage(_Stream(_source(spark, sf_dir)), sf_dir), table, checkpoint, "session_id", S.winners).awaitTermination()
    return S.Merged(spark, table, "session_id").rows().groupBy("date").agg(U.measure("events"), U.measure("sessions"), U.measure("total_tokens"))


@query("stream_blocks_5h", f"WITH {_USAGE} SELECT ts_epoch // 18000 AS block, count(*) AS events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM usage GROUP BY ts_epoch // 18000")
def blocks_5h(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(_Stream(_source(spark, sf_dir)), sf_dir).select(F.timestamp_seconds("ts_epoch").alias("ts"), "total_tokens")
    return _last(S.blocks(rows)).select(F.floor(F.unix_seconds("start") / 18000).alias("block"), "events", "total_tokens")
