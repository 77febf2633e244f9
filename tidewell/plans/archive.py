"""The archive of transcript lines, its checks and restores, the repair sweep, and the prompt history."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import owner_session
from ..functions.schemas import REMOVED
from ..operators import lines as L
from ..operators import prompts as P
from ..operators import repair as R
from ..sources import bytes as B
from ..sources import transcripts
from .tables import Busy, VersionedTables, single_writer

LINES = "rel string, line_no long, raw binary, key string"
FILES = "rel string, size long, mtime long"
#: Changed files up to which their names are broadcast.
FEW = 100_000
PROMPTS = "session string, line_no long, display string, timestamp long, project string"


class Archive(VersionedTables):
    """Append-only copy of every line that a live tree has ever held. Lines are bytes; their order is line_no. Lines are
    dealt to buckets by file, and a sync adds the new ones to theirs."""

    keys = {"lines": "rel"}

    def __init__(self, spark: SparkSession, folder: str, live: str):
        super().__init__(spark, folder)
        self.live = live

    def lines(self) -> DataFrame:
        return self.table_or("lines", LINES)

    def live_lines(self, files: DataFrame | None = None) -> DataFrame:
        """Complete lines: a last line without its newline waits for the next sync."""
        rows = transcripts.raw_lines(self.spark, self.live, files if files is not None else transcripts.listing(self.spark, self.live))
        return transcripts.keyed(rows.where("ended")).select("rel", "line_no", "raw", "key")

    @single_writer
    def sync(self) -> str:
        """ok, or skipped when no file changed since the last sync."""
        listing = transcripts.listing(self.spark, self.live)
        state = listing.select("rel", "size", "mtime")
        changed = L.unchanged(state, self.table_or("files", FILES)).select("rel", "size", "mtime")
        if self.exists("lines") and changed.isEmpty():
            return "skipped"
        old = self.lines().join(F.broadcast(changed.select("rel")) if changed.count() <= FEW else changed.select("rel"), "rel", "left_semi")
        # Only what the files got since the last sync is read; one whose beginning changed is read whole, and its lines
        # meet the archived ones by key as all do.
        offsets = self.table_or("offsets", B.STATE)
        got, now = B.appended(listing.join(changed.select("rel"), "rel", "left_semi"), offsets)
        fresh = transcripts.keyed(got.where("ended").select("rel", F.col("start").alias("line_no"), "raw")).select("rel", "line_no", "raw", "key")
        new = L.first_of(L.archive_merge(fresh, old), ["rel", "key"], "line_no")
        last = old.groupBy(F.col("rel").alias("rel_")).agg(F.max("line_no").alias("last"))
        place = F.row_number().over(Window.partitionBy("rel").orderBy("line_no"))
        new = new.withColumn("place", place).join(last, F.col("rel") == F.col("rel_"), "left")
        new = new.select("rel", (F.coalesce("last", F.lit(0)) + F.col("place")).alias("line_no"), "raw", "key")
        offsets = offsets.join(now.select("rel"), "rel", "left_anti").unionByName(now)
        self.commit({"lines": new, "files": state, "offsets": offsets}, added=["lines"] if self.exists("lines") else ())
        if self.crowded("lines"):
            self.commit({"lines": self.lines()})
        return "ok"

    def verify(self, removed: DataFrame | None = None) -> DataFrame:
        """Archived lines that the live copies of their files lack: rel, line_no, key, class."""
        gone = L.missing(self.lines(), self.live_lines()).select("rel", "line_no", "key")
        return L.classify(gone, removed if removed is not None else self.spark.createDataFrame([], "kind string, rel string, value string"))

    def restore(self, merge_live: bool = False) -> DataFrame:
        """Lines of the files to write: those that only the archive has (restored), and with merge_live the others,
        archived lines before live ones that the archive lacks (merged). rel, part, line_no, raw, status."""
        held, live = self.lines(), self.live_lines()
        only = L.archive_only(held, live)
        out = held.join(only, "rel", "left_semi").select("rel", F.lit(0).alias("part"), "line_no", "raw", F.lit("restored").alias("status"))
        if not merge_live:
            return out
        rows = held.select("rel", "line_no", "key", "raw", F.lit(0).alias("part")).unionByName(live.select("rel", "line_no", "key", "raw", F.lit(1).alias("part")))
        kept = L.restore_merge(held.join(only, "rel", "left_anti"), live).select("rel", "part", "line_no")
        return out.unionByName(rows.join(kept, ["rel", "part", "line_no"], "left_semi").select("rel", "part", "line_no", "raw", F.lit("merged").alias("status")))

    def restore_files(self, merge_live: bool = False, now: float | None = None, running: list[str] = (), quiet: int = 3600) -> DataFrame:
        """Write back what the live tree lost: rel, status. Files that only the archive has are restored. With merge_live,
        files that lack archived lines get them (merged), unless a session runs, the file was written to lately or ends in
        half a line (skipped); the others are untouched."""
        now = time.time() if now is None else now
        listing = transcripts.listing(self.spark, self.live, skip=None)
        rows = self.restore(merge_live).withColumn("order", F.row_number().over(Window.partitionBy("rel").orderBy("part", "line_no")))
        write, other = rows.where("status = 'restored'"), None
        if merge_live:
            lacking = L.missing(self.lines(), self.live_lines()).select("rel").distinct()
            half = transcripts.raw_lines(self.spark, self.live, listing).where("NOT ended").select("rel")
            busy = listing.where((F.col("mtime") > int((now - quiet) * 1_000_000)) | owner_session(F.col("rel")).isin(list(running))).select("rel").unionByName(half).distinct()
            write = write.unionByName(rows.where("status = 'merged'").join(lacking, "rel", "left_semi").join(busy, "rel", "left_anti"))
            told = F.when(F.col("lacks"), "skipped").otherwise("untouched")
            other = rows.where("status = 'merged'").select("rel").distinct().join(lacking.withColumn("lacks", F.lit(True)), "rel", "left")
            other = other.select("rel", told.alias("status"))
        done = B.write_back(write.select("rel", F.col("order").alias("line_no"), "raw", F.lit(True).alias("ended")), listing, self.live, _stamp(now))
        done = done.select("rel", F.when(F.col("status") == "new", "restored").when(F.col("status") == "written", "merged").otherwise("skipped").alias("status"))
        return done if other is None else done.unionByName(other.join(done.select("rel"), "rel", "left_anti"))

    def status(self) -> DataFrame:
        return self.lines().agg(F.count_distinct("rel").alias("files"), F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)) / (1024 * 1024), 1).alias("megabytes"))

    def sessions(self) -> DataFrame:
        return self.lines().select(owner_session(F.col("rel")).alias("session")).distinct()


class Repairs(VersionedTables):
    """The repair sweep: damaged lines are mended, empty blocks dropped, and what goes is logged before it goes."""

    def __init__(self, spark: SparkSession, folder: str, live: str, quiet_seconds: int = 3600):
        super().__init__(spark, folder)
        self.live, self.quiet = live, quiet_seconds

    def log(self) -> DataFrame:
        return self.table_or("removed", REMOVED)

    def due(self, now: float, running: list[str] = (), force: bool = False) -> DataFrame:
        """Files to look at: changed since they were last found clean, not written to lately, not of a running session."""
        rows = transcripts.listing(self.spark, self.live)
        rows = rows.join(L.unchanged(rows.select("rel", "size", "mtime"), self.table_or("clean", FILES)).select("rel"), "rel", "left_semi")
        if running:
            rows = rows.where(~owner_session(F.col("rel")).isin(list(running)))
        return rows if force else rows.where(F.col("mtime") <= int((now - self.quiet) * 1_000_000))

    @single_writer
    def sweep(self, now: float | None = None, running: list[str] = (), force: bool = False) -> DataFrame:
        """Commits the log, and the new lines of the files as table `lines`; returns statistics by file."""
        now = time.time() if now is None else now
        files = self.due(now, running, force)
        lines = transcripts.raw_lines(self.spark, self.live, files)
        cleaned = R.clean(lines.select("rel", "line_no", "raw")).persist()
        blocks = R.drop_empty_blocks(R.kept(cleaned)).persist()
        stamp = F.lit(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now)))
        half = lines.where("NOT ended").select("rel", "line_no", "ended")
        text = lambda df: df.select(stamp.alias("archived_at"), "source_file", "source_line", "reason", F.col("content").cast("string").alias("content"))
        dropped = blocks.where("action = 'dropped'").select(F.col("rel").alias("source_file"), F.col("line_no").alias("source_line"), F.lit("empty-thinking-only line").alias("reason"), F.col("raw").alias("content"))
        records = text(R.removed(cleaned).unionByName(dropped))
        new = L.append_removed(self.log(), records)
        stats = cleaned.groupBy("rel").agg(F.count("*").alias("lines"), *[F.count_if(F.col("fate") == f).alias(f) for f in ("valid", "repaired", "unparseable", "blank", "control")], F.count_if(F.col("fate").startswith("duplicate")).alias("duplicates"))
        edits = blocks.groupBy(F.col("rel").alias("rel_")).agg(F.sum(F.when(F.col("action") == "edited", F.col("blocks")).otherwise(0)).alias("blocks_removed"), F.count_if(F.col("action") == "dropped").alias("lines_removed"), F.count_if(F.col("action") == "relinked").alias("relinked"))
        stats = stats.join(edits, F.col("rel") == F.col("rel_"), "left").drop("rel_")
        out = blocks.where("action <> 'dropped'").select("rel", "line_no", "raw").join(half, ["rel", "line_no"], "left").withColumn("ended", F.coalesce("ended", F.lit(True)))
        clean = self.table_or("clean", FILES).join(files.select("rel"), "rel", "left_anti").unionByName(files.select("rel", "size", "mtime"))
        self.commit({"removed": self.log().unionByName(new.select(*self.log().columns)), "lines": out, "clean": clean, "stats": stats, "swept": files.select("rel", "size", "mtime")})
        cleaned.unpersist()
        blocks.unpersist()
        return self.table("stats")


    def totals(self) -> DataFrame:
        return L.sweep_totals(self.table("stats"))

    def apply(self, now: float | None = None) -> DataFrame:
        """Write the last sweep's changed files back: rel, status, backup. What goes is in the log already; a file that was
        touched since it was read is left alone."""
        now = time.time() if now is None else now
        stats = self.table("stats")
        edits = sum((F.coalesce(F.col(c), F.lit(0)) for c in stats.columns if c not in ("rel", "lines", "valid", "unparseable")), F.lit(0))
        return B.write_back(self.table("lines").join(stats.where(edits > 0).select("rel"), "rel", "left_semi"), self.table("swept"), self.live, _stamp(now))


def _stamp(now: float) -> str:
    return time.strftime("%Y%m%dT%H%M%SZ", time.gmtime(now))


class History(VersionedTables):
    """The prompt history: append-only, one row for each session, time and text."""

    def known(self) -> DataFrame:
        return self.table_or("prompts", PROMPTS)

    def scan(self, live: str, now_ms: int) -> DataFrame:
        """Prompts of a live tree that the history lacks, without adding them."""
        return P.merge(transcripts.prompt_rows(transcripts.raw_lines(self.spark, live), now_ms), self.known(), "line_no")

    def merge_file(self, live: str, path: str, now_ms: int) -> str:
        """Append a live tree's new prompts to a history file of JSON lines, which others may write as well.

        ok; noop when nothing is new; refused when the part that was read last time has changed; deferred when the file ends
        in half a line; busy when another merge holds the folder; error when the file can't be read or written."""
        try:
            return self._merge_file(live, path, now_ms)
        except Busy:
            return "busy"
        except OSError:
            return "error"

    @single_writer
    def _merge_file(self, live: str, path: str, now_ms: int) -> str:
        fs, name = B.place(path)
        try:
            with fs.open_input_file(name) as f:
                raw = f.read()
        except FileNotFoundError:
            raw = b""
        read = lambda a, b: raw[a:b]
        seen = self.state().get("indexed")
        if seen and (len(raw) < seen["end"] or list(B.fingerprint(read, seen["end"])) != seen["prints"]):
            return "refused"
        if raw and not raw.endswith(b"\n"):
            return "deferred"
        found = transcripts.prompt_rows(transcripts.raw_lines(self.spark, live), now_ms)
        known = transcripts.history_rows(self.spark, path) if raw else self.spark.createDataFrame([], PROMPTS)
        new = P.merge(found, known.select(*found.columns), "line_no").orderBy("timestamp", "session", "line_no")
        line = F.to_json(F.struct("display", F.create_map().cast("map<string,string>").alias("pastedContents"), "timestamp", "project", F.col("session").alias("sessionId")))
        more = b"".join(r["line"].encode() + b"\n" for r in new.select(line.alias("line")).toLocalIterator())  # one history's new prompts
        if more:
            with fs.open_append_stream(name) if raw else fs.open_output_stream(name) as f:
                f.write(more)
        whole = raw + more
        self.commit({}, indexed={"end": len(whole), "prints": list(B.fingerprint(lambda a, b: whole[a:b], len(whole)))})
        return "ok" if more else "noop"

    def merge(self, live: str, now_ms: int, since: int | None = None, throttle_seconds: int = 0) -> str:
        """Add the prompts of a live tree's files, of those changed since (microseconds, less ten minutes) if given.
        ok; noop when nothing is new; throttled when the last merge is more recent than that; busy when another writes."""
        newest = self.versions()[-1:]
        if throttle_seconds and newest and now_ms - int(newest[0][1:].split("-")[0]) // 1_000_000 < throttle_seconds * 1000:
            return "throttled"
        try:
            return self._merge(live, now_ms, since)
        except Busy:
            return "busy"

    @single_writer
    def _merge(self, live: str, now_ms: int, since: int | None) -> str:
        files = transcripts.listing(self.spark, live)
        files = files if since is None else files.where(F.col("mtime") >= since - 600_000_000)
        found = transcripts.prompt_rows(transcripts.raw_lines(self.spark, live, files), now_ms)
        new = P.merge(found, self.known(), "line_no")
        if new.isEmpty():
            return "noop"
        self.commit({"prompts": self.known().unionByName(new.select(*self.known().columns))})
        return "ok"

    def find(self, text: str = "", project: str = "", since: str = "", limit: int | None = 20) -> DataFrame:
        """Latest first; all of them without a limit."""
        out = P.find(self.known(), text, project, since).orderBy(F.desc("last"), "session")
        return out if limit is None else out.limit(limit)
