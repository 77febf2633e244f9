"""Prompts: extraction from transcripts, merging into the history, search, and new-or-resumed detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import minute_text, strip


def extract(lines: DataFrame) -> DataFrame:
    """User prompts of parsed lines: session, line_no, display (500 characters), project (first seen so far in the file).

    lines: session, line_no, type, text, cwd, and booleans meta, tool_result."""
    so_far = Window.partitionBy("session").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("project", F.coalesce(F.first(F.nullif("cwd", F.lit("")), ignorenulls=True).over(so_far), F.lit("")))
    text = strip(F.coalesce("text", F.lit("")))
    fit = F.col("type").isin("user", "user_message") & ~F.col("meta") & ~F.col("tool_result") & (F.length(text) > 2)
    return rows.where(fit).select("session", "line_no", F.substring(text, 1, 500).alias("display"), "project")


def merge(candidates: DataFrame, known: DataFrame, *order: str) -> DataFrame:
    """Prompts to append: not known yet, and of equal ones the first. Key: session, timestamp, display."""
    key = ["session", "timestamp", "display"]
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = candidates.join(known.select(*key), key, "left_anti")
    return fresh.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def detect(asked: DataFrame, history: DataFrame, files: DataFrame) -> DataFrame:
    """session -> NEW or RESUME, with the reason: in the history first, else a transcript of that name."""
    h = history.select("session", F.lit(True).alias("in_history")).distinct()
    f = files.select("session", F.lit(True).alias("has_file")).distinct()
    rows = asked.join(h, "session", "left").join(f, "session", "left")
    return rows.select(
        "session", F.when(F.col("in_history") | F.col("has_file"), "RESUME").otherwise("NEW").alias("state"),
        F.when(F.col("in_history"), "found_in_history").when(F.col("has_file"), "jsonl_file_exists").otherwise("history_jsonl_lookup").alias("reason"),
    )


def sessions(history: DataFrame) -> DataFrame:
    """Fold prompts (session, line_no, timestamp in ms, display, project) to one row: project, first, last, prompts."""
    ts, named = F.nullif("timestamp", F.lit(0)), F.nullif("project", F.lit(""))
    return history.groupBy("session").agg(
        F.coalesce(F.min_by(named, F.when(named.isNotNull(), F.col("line_no"))), F.lit("")).alias("project"), F.coalesce(F.min(ts), F.lit(0)).alias("first"), F.coalesce(F.max(ts), F.lit(0)).alias("last"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "display"))), lambda x: x["display"]).alias("prompts"),
    )


def find(history: DataFrame, text: str = "", project: str = "", since: str = "") -> DataFrame:
    """Sessions with a prompt that holds `text`, whatever the case; project by substring; last day not before `since`
    (an unknown time shows as '?', which sorts after digits and so stays). session, project, first, last, matches, n."""
    rows = sessions(history).withColumn("matches", F.filter("prompts", lambda p: F.lower(p).contains(text.lower())))
    rows = rows.where((F.size("matches") > 0) & F.lower("project").contains(project.lower()))
    if since:
        rows = rows.where(F.substring(minute_text(F.col("last")), 1, 10) >= since)
    return rows.select("session", "project", minute_text(F.col("first")).alias("first"), minute_text(F.col("last")).alias("last"), F.size("prompts").alias("n_prompts"), F.size("matches").alias("n_matches"), F.element_at("matches", 1).alias("first_match"), "matches")


def state(found: DataFrame, live: DataFrame, archived: DataFrame) -> DataFrame:
    """Adds state: live, archived or gone."""
    a = live.select("session", F.lit(True).alias("is_live")).distinct()
    b = archived.select("session", F.lit(True).alias("is_archived")).distinct()
    return found.join(a, "session", "left").join(b, "session", "left").withColumn("state", F.when(F.col("is_live"), "live").when(F.col("is_archived"), "archived").otherwise("gone")).drop("is_live", "is_archived")
