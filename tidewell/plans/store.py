"""The usage store: Parquet tables in one folder, kept up by full builds and incremental syncs.

`events` holds the last write of every uuid, `dedup` the winner of every message, `rollup` sums by session, date and
model, `manifest` what each source looked like when it was read, `pricing` the editable rates. A version of the tables
is put in force by one rename, so that a failed run changes nothing. Events, winners and sums are dealt to buckets by
session. A sync reads changed sources only, recomputes only the messages and sessions that they touch, and writes only
the buckets of those sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import as_date, hour_bucket, week_label
from ..functions.schemas import PRICING, USAGE_EVENTS
from ..operators import usage as U
from ..operators.lines import unchanged
from ..sources import sinks, transcripts
from ..sources.scratch import written
from .tables import VersionedTables, single_writer

TABLES = ("events", "dedup", "rollup", "manifest", "pricing")
EXPORTS = ("daily", "monthly", "by_model", "daily_by_model", "by_session", "by_project", "hourly_ts", "hourly_ts_by_model", "weekly", "weekly_by_model", "monthly_by_model", "sessions_timeline", "blocks_5h")
_BARRED = ("Command", "Insert", "CreateTable", "Drop", "Alter", "Cache", "SetCatalog", "Truncate", "Delete", "Update", "Merge")


class NotReadOnly(ValueError):
    pass


class UsageStore(VersionedTables):
    keys = {"events": "session_id", "dedup": "session_id", "rollup": "session_id"}

    def __init__(self, spark: SparkSession, folder: str, archive: str, live: str, prices: list[tuple] | None = None):
        super().__init__(spark, folder)
        self.archive, self.live, self.prices = archive, live, prices or []

    def _commit(self, tables: dict[str, DataFrame], only: dict | None = None) -> str:
        columns = lambda n, df: USAGE_EVENTS.names if n in ("events", "dedup") else sorted(df.columns) if n == "rollup" else df.columns
        return self.commit({n: df.select(*columns(n, df)) for n, df in tables.items()}, only)

    # ---- ingest

    def _read(self, chosen: DataFrame) -> DataFrame:
        """Usage rows of sources, archived copies first."""
        def of(tree: str, root: str) -> DataFrame:
            files = chosen.where(F.col("tree") == tree)
            lines = transcripts.raw_lines(self.spark, root, files.select("path", F.concat_ws("\x00", "source").alias("rel")))
            rows = transcripts.usage_rows(lines.withColumnRenamed("rel", "source"))
            return rows.where("NOT bad").drop("bad").withColumn("tree_rank", F.lit(int(tree == "live")))

        return of("archive", self.archive).unionByName(of("live", self.live))

    def _listing(self) -> DataFrame:
        rows = transcripts.sources(self.spark, self.archive, self.live)
        times = transcripts.listing(self.spark, self.archive, skip=None).select("path", "mtime").unionByName(transcripts.listing(self.spark, self.live).select("path", "mtime"))
        return rows.join(times, "path")

    def _pricing(self) -> DataFrame:
        return self.table("pricing") if self.exists("pricing") else self.spark.createDataFrame(self.prices, PRICING)

    @single_writer
    def build(self) -> str:
        """Everything anew from the sources; rows of sources that are gone stay, as does an edited price list."""
        listing = self._listing()
        rows = self._read(listing)
        if self.exists("events"):
            rows = self.table("events").withColumn("line_no", F.lit(0).cast("long")).withColumn("tree_rank", F.lit(-1)).unionByName(rows)
        return self._commit(self._derived(rows, listing))

    def _derived(self, rows: DataFrame, listing: DataFrame) -> dict[str, DataFrame]:
        events = U.latest_by_uuid(rows, F.col("tree_rank"), F.col("source_file"), F.col("line_no")).select(*USAGE_EVENTS.names)
        dedup = U.winner_per_message(events)
        return {"events": events, "dedup": dedup, "rollup": U.view("usage_rollup", dedup), "manifest": listing.select("source", "size", "mtime"), "pricing": self._pricing()}

    def sync_session(self, session: str) -> str | None:
        """One session's files (`folder/session`), with the same rules as a sync."""
        return self.sync(prefix=session)

    def sync(self, prefix: str | None = None) -> str | None:
        """Files of which a copy changed, alone; all copies of those, so that the copy that wins is the same as in a build."""
        return self._sync(prefix) if self.exists("events") else self.build()

    @single_writer
    def _sync(self, prefix: str | None) -> str | None:
        listing = self._listing()
        if prefix:
            listing = listing.where((F.col("rel") == f"{prefix}.jsonl") | F.col("rel").startswith(f"{prefix}/subagents/"))
        named = lambda df: df.select(F.col("source").alias("rel"), "size", "mtime")
        changed = unchanged(named(listing), named(self.table("manifest"))).select(F.col("rel").alias("source"))
        if changed.isEmpty():
            return None
        files = changed.select(F.regexp_replace("source", r"\|live$", "").alias("rel")).distinct()
        changed = listing.join(files, "rel", "left_semi")
        fresh = written(U.latest_by_uuid(self._read(changed), F.col("tree_rank"), F.col("source_file"), F.col("line_no")).select(*USAGE_EVENTS.names), "fresh")
        ids = fresh.select(F.col("uuid").alias("uuid_"))
        # Sessions that new rows are in, and those that held a row with the same uuid: their buckets alone are written.
        key = ["session_id", "message_id"]
        dirty = written(fresh.select(*key).unionByName(self.table("events").join(ids, F.col("uuid") == F.col("uuid_"), "left_semi").select(*key)).distinct(), "dirty")
        touched = [r["b"] for r in dirty.select(self.bucket("events").alias("b")).distinct().collect()]  # at most `buckets`
        events, dedup, rollup = (self.table(n, touched) for n in ("events", "dedup", "rollup"))
        merged = written(events.join(ids, F.col("uuid") == F.col("uuid_"), "left_anti").unionByName(fresh), "merged")
        won = U.winner_per_message(merged.join(dirty, key, "left_semi"))
        kept = written(dedup.join(dirty, key, "left_anti").unionByName(won), "kept")
        sessions = dirty.select("session_id").distinct()
        sums = rollup.join(sessions, "session_id", "left_anti").unionByName(U.view("usage_rollup", kept.join(sessions, "session_id", "left_semi")))
        return self._commit({"events": merged, "dedup": kept, "rollup": sums, "manifest": self._manifest(listing)}, dict.fromkeys(("events", "dedup", "rollup"), touched))

    def _manifest(self, listing: DataFrame) -> DataFrame:
        """The listing's state, and the earlier state of sources that it doesn't hold."""
        new = listing.select("source", "size", "mtime")
        return self.table("manifest").join(new.select("source"), "source", "left_anti").select("source", "size", "mtime").unionByName(new)

    @single_writer
    def set_pricing(self, rows: list[tuple]) -> str:
        return self._commit({"pricing": self.spark.createDataFrame(rows, PRICING)})

    # ---- reading

    def costed(self) -> DataFrame:
        rows = U.costed(self.table("dedup"), self.table("pricing"))
        return rows.withColumn("hour_bucket", hour_bucket(F.col("ts_iso"))).withColumn("week", week_label(as_date(F.col("date")))).withColumn("block", F.expr("ts_epoch div 18000"))

    def view(self, name: str) -> DataFrame:
        return U.ordered(name, U.view(name, self.costed()))

    def stats(self) -> DataFrame:
        return U.stats(self.costed())

    def figures(self) -> list[tuple[str, str]]:
        """Labelled figures of the winners and of all rows, as a console shows them."""
        one, raw = self.stats().first().asDict(), U.stats_raw(self.table("events")).first().asDict()
        share = 100 * one["cache_read_tokens"] / one["total_tokens"] if one["total_tokens"] else 0.0
        shown = lambda v: f"{v:,}" if isinstance(v, int) else "" if v is None else str(v)
        more = {"raw events": raw["events"], "raw total tokens": raw["total_tokens"]}
        return [(k.replace("_", " "), shown(v)) for k, v in (one | more).items()] + [("cache read share", f"{share:.1f}%")]

    def unpriced(self) -> list[str]:
        """Models with tokens and no price, at most 20."""
        free = U.costed(self.table("dedup").where("total_tokens > 0 AND model <> ''"), self.table("pricing")).groupBy("model").agg(F.max("c12").alias("most")).where("most = 0")
        return [r["model"] for r in free.orderBy("model").limit(20).collect()]

    def report(self, name: str, n: int | None = None) -> DataFrame:
        """hourly [48], daily [30], sessions [40]: the last n; weekly and monthly: all; models: by model."""
        of, by, most = {"hourly": ("hourly_ts", ("hour_bucket",), 48), "daily": ("daily", ("date",), 30), "sessions": ("sessions_timeline", ("started", "session_id"), 40)}.get(name, (None, None, None))
        if of:
            return U.last_n(U.view(of, self.costed()), n or most, *by)
        return self.view({"weekly": "weekly", "monthly": "monthly", "models": "by_model"}[name])

    def export(self, folder: str) -> list[str]:
        return [sinks.write_csv(self.view(n), f"{folder}/{n}.csv") for n in EXPORTS]

    def register(self) -> None:
        for name in TABLES:
            self.table(name).createOrReplaceTempView(f"usage_{name}")
        costed = self.costed()
        costed.createOrReplaceTempView("v_events_costed")
        self.table("dedup").createOrReplaceTempView("v_events_dedup")
        for name in U.VIEWS:
            view = U.view(name, costed)
            view.createOrReplaceTempView(f"v_{name}")
            if name == "hour_of_day":
                view.createOrReplaceTempView("v_hourly")

    def sql(self, text: str) -> DataFrame:
        """A query over the tables (usage_*) and views (v_*); anything that isn't one is refused."""
        return read_only(self.spark, text, self.register)

    def schema(self) -> list[str]:
        return [f"{n}: {self.table(n).schema.simpleString()}" for n in TABLES]


def read_only(spark: SparkSession, text: str, before=lambda: None) -> DataFrame:
    """spark.sql for queries alone: the text starts with SELECT or WITH, and its parsed plan holds no command."""
    if not text.lstrip().lower().startswith(("select", "with")):
        raise NotReadOnly("only SELECT and WITH queries are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)

    def walk(p):
        name = p.getClass().getSimpleName()
        if any(b in name for b in _BARRED):
            raise NotReadOnly(f"{name} isn't a query")
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    before()
    return spark.sql(text)
