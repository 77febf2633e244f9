"""Set algebra over lines: archive merge, loss detection, restore, repair, removed-line log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def line_key(uuid: Column, raw: Column) -> Column:
    """Identity of a line: its uuid, else its bytes."""
    return F.when(uuid.isNotNull() & (uuid.cast("string") != ""), F.concat(F.lit("u:"), uuid.cast("string"))).otherwise(F.concat(F.lit("r:"), F.hex(raw)))


def select_sources(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Copies to read: every archived file, and a live one that has no archived copy or is larger (key suffix |live).
    Both: rel, size. Returns source, rel, tree, size."""
    a, b = archive.select("rel", F.col("size").alias("archived")), live.select("rel", F.col("size").alias("present"))
    both = a.join(b, "rel", "full_outer")
    kept = both.where(F.col("archived").isNotNull()).select(F.col("rel").alias("source"), "rel", F.lit("archive").alias("tree"), F.col("archived").alias("size"))
    more = both.where(F.col("present").isNotNull() & (F.col("archived").isNull() | (F.col("present") > F.col("archived"))))
    return kept.unionByName(more.select(F.when(F.col("archived").isNull(), F.col("rel")).otherwise(F.concat("rel", F.lit("|live"))).alias("source"), "rel", F.lit("live").alias("tree"), F.col("present").alias("size")))


def first_of(lines: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return lines.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def archive_merge(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Live lines that the archive of their file lacks, to be appended in line order. Both: rel, line_no, key, ..."""
    return live.join(archive.select("rel", "key"), ["rel", "key"], "left_anti")


def archive_only(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Files that only the archive has."""
    return archive.select("rel").distinct().join(live.select("rel"), "rel", "left_anti")


def missing(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Archived lines that the live copy of their file no longer has; of equal lines the first."""
    gone = archive.join(live.select("rel").distinct(), "rel", "left_semi").join(live.select("rel", "key"), ["rel", "key"], "left_anti")
    return first_of(gone, ["rel", "key"], "line_no")


def classify(gone: DataFrame, removed: DataFrame) -> DataFrame:
    """Adds class: excused by a readable record of the removal log, by a uuid in an unreadable one, or unexplained.
    removed: kind (uuid | unreadable | record), rel (records only), value."""
    by_uuid = removed.where("kind = 'uuid'").select(F.col("value").alias("key"), F.lit(True).alias("by_uuid")).distinct()
    torn = removed.where("kind = 'unreadable'").select(F.col("value").alias("key"), F.lit(True).alias("torn")).distinct()
    record = removed.where("kind = 'record'").select("rel", F.col("value").alias("key"), F.lit(True).alias("record")).distinct()
    rows = gone.join(by_uuid, "key", "left").join(record, ["rel", "key"], "left").join(torn, "key", "left")
    kind = F.when(F.col("by_uuid") | F.col("record"), "excused").when(F.col("torn"), "excused_unreadable").otherwise("unexplained")
    return rows.withColumn("class", kind).drop("by_uuid", "torn", "record")


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("lines"), F.count_distinct("rel").alias("files"))


def restore_merge(archive: DataFrame, live: DataFrame) -> DataFrame:
    """A restored file: its archived lines, then live lines that the archive lacks. part, line_no give the order."""
    extra = live.join(archive.select("rel", "key"), ["rel", "key"], "left_anti")
    return archive.select("rel", F.lit(0).alias("part"), "line_no", "key").unionByName(extra.select("rel", F.lit(1).alias("part"), "line_no", "key"))


def append_removed(log: DataFrame, records: DataFrame) -> DataFrame:
    """Records that the log doesn't hold yet, one for each (source_file, content)."""
    return first_of(records, ["source_file", "content"], "source_line").join(log.select("source_file", "content"), ["source_file", "content"], "left_anti")


def append_ledger(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Usage rows that the ledger lacks, one for each (session, uuid)."""
    return rows.dropDuplicates(["session", "uuid"]).join(ledger.select("session", "uuid"), ["session", "uuid"], "left_anti")


def lost(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Keys that a rewritten history no longer has: it must be empty before the history may be replaced."""
    return before.select(*keys).distinct().join(after.select(*keys), list(keys), "left_anti")


def known_keys(index: DataFrame, history: DataFrame, *keys: str) -> DataFrame:
    """Keys that either an index or a history has."""
    return index.select(*keys).unionByName(history.select(*keys)).distinct()


def lines_of_message(lines: DataFrame) -> DataFrame:
    """Adds n_lines: lines of the same message in the file. lines: rel, message, ..."""
    return lines.withColumn("n_lines", F.count("*").over(Window.partitionBy("rel", "message")))


def forget(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """A manifest without the state of files that were rewritten, whatever copy it is of. manifest: source; gone: rel."""
    return manifest.withColumn("rel_", F.regexp_replace("source", r"\|live$", "")).join(gone.select(F.col("rel").alias("rel_")).distinct(), "rel_", "left_anti").drop("rel_")


def sweep_totals(stats: DataFrame) -> DataFrame:
    """One row over the statistics of a sweep's files: files, files that changed, and the sums of the counts."""
    counts = [c for c in stats.columns if c != "rel"]
    edits = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts if c not in ("lines", "valid", "unparseable")), F.lit(0))
    return stats.agg(F.count("*").alias("files"), F.count_if(edits > 0).alias("changed"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts])


def cleanable(events: DataFrame) -> DataFrame:
    """Session-end events after which a repair may run: all but those of a session that is being resumed.
    events: reason, end_reason, ..."""
    return events.where(F.lower(F.coalesce(F.nullif("reason", F.lit("")), F.col("end_reason"), F.lit(""))) != "resume")


def manifest_diff(source: DataFrame, deployed: DataFrame) -> DataFrame:
    """name -> new, same or differs. Both: name, sha256."""
    rows = source.join(deployed.select("name", F.col("sha256").alias("there")), "name", "left")
    return rows.select("name", F.when(F.col("there").isNull(), "new").when(F.col("there") == F.col("sha256"), "same").otherwise("differs").alias("status"))


def unchanged(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a listing that changed since the manifest: rel, size, mtime not all equal."""
    return listing.join(manifest.select("rel", "size", "mtime"), ["rel", "size", "mtime"], "left_anti")


def gate_allows(runs: DataFrame, now: int, every: int = 6 * 3600, most: int = 4) -> DataFrame:
    """Whether a job may run: its last run is `every` seconds old or more, and the last day has fewer than `most` runs.
    runs: job, at (seconds)."""
    day = F.count_if(F.col("at") > now - 86400)
    return runs.groupBy("job").agg(F.max("at").alias("last"), day.alias("in_day")).select("job", "last", "in_day", ((F.lit(now) - F.col("last") >= every) & (F.col("in_day") < most)).alias("allowed"))


CONTROL = r"^[\x00\x07\x08\x0b\x0c\x0d\x1a]+$"


def classify_lines(lines: DataFrame, valid: Column | None = None) -> DataFrame:
    """Adds fate of each line: blank, control, duplicate or kept. lines: rel, line_no, text (already stripped)."""
    kind = F.when(F.col("text") == "", "blank").when(F.col("text").rlike(CONTROL), "control").otherwise("text")
    w = Window.partitionBy("rel", "kind", "text").orderBy("line_no")
    rows = lines.withColumn("kind", kind).withColumn("nth", F.row_number().over(w))
    return rows.withColumn("fate", F.when(F.col("kind") != "text", F.col("kind")).when(F.col("nth") > 1, "duplicate").otherwise("kept")).drop("kind", "nth")


def line_stats(rows: DataFrame) -> DataFrame:
    one = lambda f: F.count_if(F.col("fate") == f).alias(f)
    return rows.groupBy("rel").agg(F.count("*").alias("lines"), one("kept"), one("blank"), one("control"), one("duplicate"))


def relink(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Parents of the lines that stay, past any removed ones: pointer jumping over the removed links, log2(n) joins.

    lines: rel, uuid, parent; removed: rel, uuid, parent. A chain that ends in a null gives null. A chain that runs into
    a cycle of removed lines gives the first line of the cycle that it meets. Returns rel, uuid, parent, relinked.
    """
    hops = removed.dropDuplicates(["rel", "uuid"]).select("rel", F.col("uuid").alias("at"), F.col("parent").alias("to"))
    ends, circling = _ends(hops)
    if circling is not None:
        # Jumps that never end have landed on every line of every cycle: without those lines' links all chains end there.
        on = written(circling.select("rel", F.col("to").alias("at")).distinct(), "cycles")
        ends = _ends(hops.join(on, ["rel", "at"], "left_anti"))[0].unionByName(on.select("rel", "at", F.col("at").alias("to")))
    ends = ends.select(F.col("rel").alias("rel_"), F.col("at").alias("at_"), F.col("to").alias("to_"))
    out = lines.join(ends, (F.col("rel") == F.col("rel_")) & (F.col("parent") == F.col("at_")), "left")
    return out.select("rel", "uuid", F.when(F.col("at_").isNotNull(), F.col("to_")).otherwise(F.col("parent")).alias("parent"), F.col("at_").isNotNull().alias("relinked"))


def _ends(hops: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each link doubled until it leads out of the links: (links, those that still move). Every round but one that only
    cycles are left in ends at least one link's walk, so that a round that ends none is the last."""
    jump, before = hops, None
    while True:
        step = jump.select(F.col("rel").alias("rel2"), F.col("at").alias("at2"), F.col("to").alias("to2"))
        new = jump.join(step, (F.col("rel") == F.col("rel2")) & (F.col("to") == F.col("at2")), "left")
        moved = F.col("at2").isNotNull()
        new = written(new.select("rel", "at", F.when(moved, F.col("to2")).otherwise(F.col("to")).alias("to"), moved.alias("moved")), "links")
        jump, moving = new.drop("moved"), new.where("moved").count()
        if not moving:
            return jump, None
        if moving == before:
            return jump, new.where("moved")
        before = moving
