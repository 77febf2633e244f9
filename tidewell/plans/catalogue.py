"""Every registered query of the engine over the driver's tables, with DuckDB SQL for the same rows.

The tables hold no transcripts, so a fixed mapping turns them into the engine's inputs: `events` into usage rows,
`conversations` into transcript lines with an archived and a live copy, `documents` into lines to clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import as_date, hour_bucket, ntz_epoch, week_label
from ..functions.schemas import PRICING
from ..operators import lines as L
from ..operators import prompts as P
from ..operators import usage as U

# The price list of the mapping, micro-USD per million tokens.
PRICES = [
    ("p", 1000000, 5000000, 1250000, 2000000, 100000),
    ("purch", 3000000, 15000000, 3750000, 6000000, 300000),
    ("view", 800000, 4000000, 1000000, 1600000, 80000),
    ("CLICK", 15000000, 75000000, 18750000, 30000000, 1500000),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- inputs


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    base = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        F.col("event_id").alias("uuid"), F.col("user_id").alias("session_id"), k.alias("message_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_iso"), ntz_epoch(F.col("ts")).alias("ts_epoch"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "yyyy-MM").alias("month"), F.hour("ts").alias("hour"), F.col("event_type").alias("model"),
        F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("proj-"), (F.col("user_id") % 7).cast("string"))).alias("project"),
        (base % 997).alias("input_tokens"), F.floor(base / 7).alias("output_tokens"), (k * 10).alias("cache_creation_tokens"), base.alias("cache_read_tokens"), (k * 5).alias("ephemeral_5m_tokens"), (k * 5).alias("ephemeral_1h_tokens"),
    )
    return rows.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.winner_per_message(usage(spark, sf_dir))


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.costed(winners(spark, sf_dir), spark.createDataFrame(PRICES, PRICING))
    return rows.withColumn("hour_bucket", hour_bucket(F.col("ts_iso"))).withColumn("week", week_label(as_date(F.col("date")))).withColumn("block", F.floor(F.col("ts_epoch") / 18000))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("rel"), F.col("turn").alias("line_no"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "role", "text")


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where((F.col("rel") * 31 + F.col("line_no")) % 11 != 0)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where((F.col("rel") * 17 + F.col("line_no")) % 13 != 0)


def listing(lines: DataFrame) -> DataFrame:
    return lines.groupBy("rel").agg(F.sum(F.length("text") + 1).alias("size"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).where("role = 'user'")
    project = F.when(F.col("rel") % 5 == 0, "").otherwise(F.concat(F.lit("proj-"), (F.col("rel") % 5).cast("string")))
    at = F.when(F.col("rel") % 9 == 0, F.lit(0)).otherwise((F.lit(1700000000) + F.col("rel") * 3600 + F.col("line_no") * 60) * 1000)
    return rows.select(F.col("rel").alias("session"), "line_no", at.alias("timestamp"), F.substring("text", 1, 500).alias("display"), project.alias("project"))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return put


# ---------------------------------------------------------------- SQL of the inputs

_COST = "CAST(CASE WHEN sum(c12) < 0 THEN (sum(c12) - 50000000) // 100000000 ELSE (sum(c12) + 50000000) // 100000000 END AS DOUBLE) / 1e4"
_USAGE = """
u0 AS (
  SELECT event_id AS uuid, user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS message_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_iso, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts_epoch, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m') AS month,
    CAST(hour(ts) AS INTEGER) AS hour, event_type AS model, CASE WHEN user_id % 7 = 0 THEN '' ELSE 'proj-' || (user_id % 7) END AS project,
    CAST(round(value * 100) AS BIGINT) AS base, ts
  FROM events
), usage AS (
  SELECT uuid, session_id, message_id, ts_iso, ts_epoch, date, month, hour, model, project,
    base % 997 AS input_tokens, base // 7 AS output_tokens, 10 * message_id AS cache_creation_tokens, base AS cache_read_tokens,
    5 * message_id AS ephemeral_5m_tokens, 5 * message_id AS ephemeral_1h_tokens,
    base % 997 + base // 7 + 10 * message_id + base AS total_tokens, ts
  FROM u0
), dedup AS (
  SELECT * FROM usage
  QUALIFY row_number() OVER (PARTITION BY session_id, message_id ORDER BY total_tokens DESC, ts_epoch DESC NULLS LAST, uuid) = 1
), prices(pat, ri, ro, r5, r1, rr) AS (
  VALUES ('p', 1000000, 5000000, 1250000, 2000000, 100000), ('purch', 3000000, 15000000, 3750000, 6000000, 300000),
    ('view', 800000, 4000000, 1000000, 1600000, 80000), ('CLICK', 15000000, 75000000, 18750000, 30000000, 1500000)
), rated AS (
  SELECT m.model AS priced, p.* FROM (SELECT DISTINCT model FROM dedup) m JOIN prices p ON m.model ILIKE p.pat || '%'
  QUALIFY row_number() OVER (PARTITION BY m.model ORDER BY length(p.pat) DESC, p.pat DESC) = 1
), costed AS (
  SELECT d.*, CAST(input_tokens * coalesce(ri, 0) + output_tokens * coalesce(ro, 0) + ephemeral_5m_tokens * coalesce(r5, 0) + ephemeral_1h_tokens * coalesce(r1, 0)
      + (cache_creation_tokens - ephemeral_5m_tokens - ephemeral_1h_tokens) * coalesce(r5, 0) + cache_read_tokens * coalesce(rr, 0) AS BIGINT) AS c12,
    strftime(ts, '%Y-%m-%d %H:00') AS hour_bucket, strftime(ts, '%Y-W%W') AS week, ts_epoch // 18000 AS block
  FROM dedup d LEFT JOIN rated r ON d.model = r.priced
)"""
_LINES = """
lines AS (SELECT conv_id AS rel, turn AS line_no, conv_id || ':' || turn AS key, role, text FROM conversations),
archived AS (SELECT * FROM lines WHERE (rel * 31 + line_no) % 11 <> 0),
live AS (SELECT * FROM lines WHERE (rel * 17 + line_no) % 13 <> 0),
history AS (
  SELECT rel AS session, line_no, CASE WHEN rel % 9 = 0 THEN 0 ELSE (1700000000 + rel * 3600 + line_no * 60) * 1000 END AS timestamp, substr(text, 1, 500) AS display,
    CASE WHEN rel % 5 = 0 THEN '' ELSE 'proj-' || (rel % 5) END AS project
  FROM lines WHERE role = 'user'
)"""

_T4 = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"))
_TT = "CAST(sum(total_tokens) AS BIGINT) AS total_tokens"
_ALL = f"count(*) AS events, count(DISTINCT session_id) AS sessions, {_T4}, {_TT}, {_COST} AS cost_usd"
_MODEL = f"count(*) AS events, {_T4}, {_TT}, {_COST} AS cost_usd"
_BLOCK_TEXT = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%d %H:%M:%S')"
#: Each view written out, apart from the engine's own table of views.
VIEW_SQL = {
    "daily": f"SELECT date, {_ALL} FROM costed GROUP BY date",
    "monthly": f"SELECT month, {_ALL} FROM costed GROUP BY month",
    "by_model": f"SELECT model, count(*) AS events, count(DISTINCT session_id) AS sessions, min(date) AS first_used, max(date) AS last_used, {_T4}, {_TT}, {_COST} AS cost_usd FROM costed GROUP BY model",
    "daily_by_model": f"SELECT date, model, count(*) AS events, {_TT}, {_COST} AS cost_usd FROM costed GROUP BY date, model",
    "by_session": f"SELECT session_id, min(ts_iso) AS first_activity, max(ts_iso) AS last_activity, count(*) AS events, count(DISTINCT model) AS models_used, max(project) AS project, {_TT}, {_COST} AS cost_usd FROM costed GROUP BY session_id",
    "by_project": f"SELECT project, count(*) AS events, count(DISTINCT session_id) AS sessions, {_TT}, {_COST} AS cost_usd FROM costed WHERE project IS NOT NULL AND project <> '' GROUP BY project",
    "hour_of_day": f"SELECT hour, count(*) AS events, {_TT} FROM costed GROUP BY hour",
    "hourly_ts": f"SELECT hour_bucket, {_ALL} FROM costed GROUP BY hour_bucket",
    "hourly_ts_by_model": f"SELECT hour_bucket, model, {_MODEL} FROM costed GROUP BY hour_bucket, model",
    "weekly": f"SELECT week, min(date) AS week_start, max(date) AS week_end, {_ALL} FROM costed GROUP BY week",
    "weekly_by_model": f"SELECT week, model, {_MODEL} FROM costed GROUP BY week, model",
    "monthly_by_model": f"SELECT month, model, {_MODEL} FROM costed GROUP BY month, model",
    "sessions_timeline": f"SELECT session_id, min(ts_iso) AS started, max(ts_iso) AS ended, CAST(floor((max(ts_epoch) - min(ts_epoch)) / 6.0 + 0.5) AS DOUBLE) / 10 AS duration_min, max(project) AS project, count(*) AS events, string_agg(DISTINCT model, ',' ORDER BY model) AS models, {_TT}, {_COST} AS cost_usd FROM costed GROUP BY session_id",
    "blocks_5h": f"SELECT {_BLOCK_TEXT.format('block * 18000')} AS block_start, {_BLOCK_TEXT.format('block * 18000 + 18000')} AS block_end, count(*) AS events, count(DISTINCT session_id) AS sessions, {_TT}, {_COST} AS cost_usd FROM costed GROUP BY block",
    "usage_rollup": f"SELECT session_id, date, model, count(*) AS messages, {_T4}, CAST(sum(ephemeral_5m_tokens) AS BIGINT) AS ephemeral_5m_tokens, CAST(sum(ephemeral_1h_tokens) AS BIGINT) AS ephemeral_1h_tokens, {_TT} FROM costed GROUP BY session_id, date, model",
}


for _name in U.VIEWS:
    query(_name, f"WITH {_USAGE}\n{VIEW_SQL[_name]}")(lambda s, d, n=_name: U.view(n, costed(s, d)))

# ---------------------------------------------------------------- usage

_EVENT = ("uuid", "session_id", "message_id", "ts_iso", "ts_epoch", "date", "month", "hour", "model", "project", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "ephemeral_5m_tokens", "ephemeral_1h_tokens", "total_tokens")


@query("usage_dedup", f"WITH {_USAGE} SELECT {', '.join(_EVENT)} FROM dedup")
def _dedup(s, d):
    return winners(s, d).select(*_EVENT)


@query("usage_costed", f"WITH {_USAGE} SELECT {', '.join(_EVENT)}, c12 FROM costed")
def _costed(s, d):
    return costed(s, d).select(*_EVENT, "c12")


@query("usage_latest_by_uuid", f"""WITH {_USAGE}, copies AS (
  SELECT uuid, session_id, message_id, total_tokens, 0 AS tree, uuid AS line_no FROM usage
  UNION ALL SELECT uuid, session_id, message_id, total_tokens + 1, 1, uuid FROM usage WHERE uuid % 5 = 0
  UNION ALL SELECT uuid, session_id, message_id, total_tokens + 2, 1, uuid + 1 FROM usage WHERE uuid % 35 = 0
) SELECT uuid, session_id, message_id, total_tokens FROM copies QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY tree DESC, line_no DESC) = 1""")
def _latest(s, d):
    u = usage(s, d).select("uuid", "session_id", "message_id", "total_tokens")
    more = lambda m, k: u.where(F.col("uuid") % m == 0).select("uuid", "session_id", "message_id", (F.col("total_tokens") + k).alias("total_tokens"), F.lit(1).alias("tree"), (F.col("uuid") + k - 1).alias("line_no"))
    both = u.withColumn("tree", F.lit(0)).withColumn("line_no", F.col("uuid")).unionByName(more(5, 1)).unionByName(more(35, 2))
    return U.latest_by_uuid(both, F.col("tree"), F.col("line_no")).drop("tree", "line_no")


@query("stats_dedup", f"""WITH {_USAGE} SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT model) AS models, count(DISTINCT project) AS projects, min(date) AS first_date, max(date) AS last_date,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {_COST} AS cost_usd FROM costed""")
def _stats(s, d):
    return U.stats(costed(s, d))


@query("stats_raw", f"WITH {_USAGE} SELECT count(*) AS events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM usage")
def _stats_raw(s, d):
    return U.stats_raw(usage(s, d))


for _name, _of, _n, _by in (("hourly_last_48", "hourly_ts", 48, ("hour_bucket",)), ("daily_last_30", "daily", 30, ("date",)), ("sessions_last_40", "sessions_timeline", 40, ("started", "session_id"))):
    query(_name, f"WITH {_USAGE}, v AS ({VIEW_SQL[_of]}) SELECT * FROM v ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in _by)} LIMIT {_n}")(lambda s, d, o=_of, n=_n, b=_by: U.last_n(U.view(o, costed(s, d)), n, *b))


_NO_PROJECT = "+ (SELECT coalesce(sum(total_tokens), 0) FROM costed WHERE project IS NULL OR project = '')"
_SUMS = " UNION ALL ".join(f"SELECT '{n}' AS view, coalesce(sum(total_tokens), 0) {_NO_PROJECT if n == 'by_project' else ''} AS t FROM ({q})" for n, q in VIEW_SQL.items())


@query("reconcile", f"WITH {_USAGE}, s AS ({_SUMS}), g AS (SELECT sum(total_tokens) AS g FROM dedup) SELECT view, CAST(t AS BIGINT) AS total_tokens, CAST(t - g AS BIGINT) AS delta FROM s, g")
def _reconcile(s, d):
    return U.reconcile(costed(s, d))


@query("cost_of_large_groups", f"""WITH {_USAGE}, big AS (SELECT model, CAST(c12 AS HUGEINT) * 10000 AS c12 FROM costed) SELECT model, {_COST} AS cost_usd FROM big GROUP BY model""")
def _large_cost(s, d):
    """Groups that cost more than a long of 1e-12 USD can say."""
    c = costed(s, d).select("model", (F.col("c12") * 10000).alias("c12"))
    return c.groupBy("model").agg(U.measure("cost_usd"))


@query("cache_ratio_daily", f"WITH {_USAGE} SELECT date, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST((1000 * sum(cache_read_tokens)) // nullif(sum(total_tokens), 0) AS BIGINT) AS per_mille FROM costed GROUP BY date")
def _cache_ratio(s, d):
    v = U.view("daily", costed(s, d))
    return v.select("date", "cache_read_tokens", F.expr("try_divide(1000 * cache_read_tokens - (1000 * cache_read_tokens) % total_tokens, total_tokens)").cast("long").alias("per_mille"))


@query("top_sessions_by_cost", f"WITH {_USAGE}, v AS ({VIEW_SQL['by_session']}) SELECT session_id, cost_usd, total_tokens FROM v ORDER BY cost_usd DESC, session_id LIMIT 10")
def _top_sessions(s, d):
    return U.view("by_session", costed(s, d)).select("session_id", "cost_usd", "total_tokens").orderBy(F.desc("cost_usd"), "session_id").limit(10)


@query("model_spend_month", f"WITH {_USAGE}, v AS ({VIEW_SQL['monthly_by_model']}) SELECT month, model, cost_usd FROM v WHERE month = (SELECT max(month) FROM costed)")
def _model_spend(s, d):
    rows = costed(s, d)
    latest = rows.agg(F.max("month").alias("latest"))
    return U.view("monthly_by_model", rows).join(F.broadcast(latest), F.col("month") == F.col("latest")).select("month", "model", "cost_usd")


# ---------------------------------------------------------------- archive


@query("sources_selection", f"""WITH {_LINES}, a AS (SELECT rel, CAST(sum(length(text) + 1) AS BIGINT) AS size FROM archived WHERE rel % 6 <> 0 GROUP BY rel), l AS (SELECT rel, CAST(sum(length(text) + 1) AS BIGINT) AS size FROM live WHERE rel % 4 <> 0 GROUP BY rel)
SELECT CAST(rel AS VARCHAR) AS source, 'archive' AS tree, size FROM a
UNION ALL SELECT CASE WHEN a.rel IS NULL THEN CAST(l.rel AS VARCHAR) ELSE l.rel || '|live' END, 'live', l.size FROM l LEFT JOIN a ON a.rel = l.rel WHERE a.rel IS NULL OR l.size > a.size""")
def _sources(s, d):
    text = lambda df: listing(df).withColumn("rel", F.col("rel").cast("string"))
    return L.select_sources(text(archived(s, d).where("rel % 6 <> 0")), text(live(s, d).where("rel % 4 <> 0"))).select("source", "tree", "size")


@query("archive_merge", f"WITH {_LINES} SELECT rel, line_no, key FROM live l WHERE NOT EXISTS (SELECT 1 FROM archived a WHERE a.rel = l.rel AND a.key = l.key)")
def _merge(s, d):
    return L.archive_merge(live(s, d), archived(s, d)).select("rel", "line_no", "key")


@query("archive_only", f"WITH {_LINES} SELECT DISTINCT rel FROM archived WHERE rel NOT IN (SELECT rel FROM live WHERE rel % 3 <> 0)")
def _archive_only(s, d):
    return L.archive_only(archived(s, d), live(s, d).where("rel % 3 <> 0"))


_MISSING = "missing AS (SELECT a.rel, a.key, min(a.line_no) AS line_no FROM archived a WHERE a.rel IN (SELECT rel FROM live) AND NOT EXISTS (SELECT 1 FROM live l WHERE l.rel = a.rel AND l.key = a.key) GROUP BY a.rel, a.key)"


@query("verify_missing", f"WITH {_LINES}, {_MISSING} SELECT rel, key, line_no FROM missing")
def _missing(s, d):
    return L.missing(archived(s, d), live(s, d)).select("rel", "key", "line_no")


@query("verify_classes", f"""WITH {_LINES}, {_MISSING}, c AS (
  SELECT rel, CASE WHEN line_no % 3 = 0 OR (line_no % 5 = 0 AND rel % 2 = 0) THEN 'excused' WHEN line_no % 7 = 1 THEN 'excused_unreadable' ELSE 'unexplained' END AS class FROM missing
) SELECT class, count(*) AS lines, count(DISTINCT rel) AS files FROM c GROUP BY class""")
def _classes(s, d):
    log = _lines(s, d)
    removed = log.where("line_no % 3 = 0").select(F.lit("uuid").alias("kind"), "rel", F.col("key").alias("value"))
    removed = removed.unionByName(log.where("line_no % 5 = 0 AND rel % 2 = 0").select(F.lit("record").alias("kind"), "rel", F.col("key").alias("value")))
    removed = removed.unionByName(log.where("line_no % 7 = 1").select(F.lit("unreadable").alias("kind"), "rel", F.col("key").alias("value")))
    return L.class_counts(L.classify(L.missing(archived(s, d), live(s, d)), removed))


@query("restore_merge", f"WITH {_LINES} SELECT rel, 0 AS part, line_no, key FROM archived UNION ALL SELECT rel, 1, line_no, key FROM live l WHERE NOT EXISTS (SELECT 1 FROM archived a WHERE a.rel = l.rel AND a.key = l.key)")
def _restore(s, d):
    return L.restore_merge(archived(s, d), live(s, d))


# ---------------------------------------------------------------- prompts


@query("prompts_extract", f"""WITH {_LINES}, w AS (
  SELECT *, coalesce(first_value(CASE WHEN line_no % 4 = 2 THEN 'proj-' || (rel % 3) END IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS project FROM lines
) SELECT rel AS session, line_no, substr(trim(text), 1, 500) AS display, project FROM w WHERE role = 'user' AND line_no % 7 <> 3 AND NOT (text LIKE '%ea%') AND length(trim(text)) > 2""")
def _extract(s, d):
    cwd = F.when(F.col("line_no") % 4 == 2, F.concat(F.lit("proj-"), (F.col("rel") % 3).cast("string"))).otherwise("")
    rows = _lines(s, d).select(F.col("rel").alias("session"), "line_no", F.col("role").alias("type"), "text", cwd.alias("cwd"), (F.col("line_no") % 7 == 3).alias("meta"), F.col("text").contains("ea").alias("tool_result"))
    return P.extract(rows)


@query("prompts_merge", f"""WITH {_LINES}, c AS (SELECT session, line_no, timestamp, display FROM history UNION ALL SELECT session, line_no + 1000, timestamp, display FROM history WHERE line_no % 2 = 0)
SELECT session, timestamp, display, min(line_no) AS line_no FROM c WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.session % 3 = 0 AND h.session = c.session AND h.timestamp = c.timestamp AND h.display = c.display) GROUP BY session, timestamp, display""")
def _prompts_merge(s, d):
    h = history(s, d).drop("project")
    both = h.unionByName(h.where("line_no % 2 = 0").withColumn("line_no", F.col("line_no") + 1000))
    return P.merge(both, h.where("session % 3 = 0"), "line_no").select("session", "timestamp", "display", "line_no")


@query("session_detect", f"""WITH {_LINES}, asked AS (SELECT DISTINCT user_id AS session FROM events)
SELECT session, CASE WHEN h OR f THEN 'RESUME' ELSE 'NEW' END AS state, CASE WHEN h THEN 'found_in_history' WHEN f THEN 'jsonl_file_exists' ELSE 'history_jsonl_lookup' END AS reason
FROM (SELECT session, session IN (SELECT session FROM history WHERE session % 2 = 0) AS h, session IN (SELECT rel FROM live) AS f FROM asked)""")
def _detect(s, d):
    asked = table(s, d, "events").select(F.col("user_id").alias("session")).distinct()
    return P.detect(asked, history(s, d).where("session % 2 = 0"), live(s, d).select(F.col("rel").alias("session")))


_FIND = """, s AS (
  SELECT session, coalesce(min_by(nullif(project, ''), line_no) FILTER (WHERE project <> ''), '') AS project, coalesce(min(nullif(timestamp, 0)), 0) AS first, coalesce(max(nullif(timestamp, 0)), 0) AS last,
    count(*) AS n_prompts, count(*) FILTER (WHERE contains(lower(display), 'th')) AS n_matches, min_by(display, line_no) FILTER (WHERE contains(lower(display), 'th')) AS first_match FROM history GROUP BY session
), t AS (
  SELECT session, project, CASE WHEN first = 0 THEN '?' ELSE strftime(make_timestamp(first * 1000), '%Y-%m-%d %H:%M') END AS first, CASE WHEN last = 0 THEN '?' ELSE strftime(make_timestamp(last * 1000), '%Y-%m-%d %H:%M') END AS last, n_prompts, n_matches, first_match FROM s
), found AS (SELECT session, project, first, last, CAST(n_prompts AS INTEGER) AS n_prompts, CAST(n_matches AS INTEGER) AS n_matches, first_match FROM t WHERE n_matches > 0 AND contains(project, 'proj') AND substr(last, 1, 10) >= '2023-11-16')"""


@query("session_find", f"WITH {_LINES}{_FIND} SELECT * FROM found")
def _find(s, d):
    return P.find(history(s, d), "TH", "Proj", "2023-11-16").drop("matches")


@query("session_find_state", f"WITH {_LINES}{_FIND} SELECT session, last, CASE WHEN session IN (SELECT rel FROM live WHERE rel % 3 <> 0) THEN 'live' WHEN session IN (SELECT rel FROM archived WHERE rel % 2 = 0) THEN 'archived' ELSE 'gone' END AS state FROM found")
def _find_state(s, d):
    names = lambda df: df.select(F.col("rel").alias("session"))
    found = P.find(history(s, d), "TH", "Proj", "2023-11-16")
    return P.state(found, names(live(s, d).where("rel % 3 <> 0")), names(archived(s, d).where("rel % 2 = 0"))).select("session", "last", "state")


# ---------------------------------------------------------------- cleaning

_CLEAN = """
split AS (SELECT doc_id AS rel, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
stripped AS (SELECT rel, line_no, trim(text, ' ' || chr(9)) AS text FROM split),
fates AS (
  SELECT rel, line_no, text, CASE WHEN text = '' THEN 'blank' WHEN regexp_full_match(text, '[\\x00\\x07\\x08\\x0b\\x0c\\x0d\\x1a]+') THEN 'control'
    WHEN row_number() OVER (PARTITION BY rel, text ORDER BY line_no) > 1 THEN 'duplicate' ELSE 'kept' END AS fate FROM stripped
)"""


def fates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return L.classify_lines(d.select("rel", (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("text", r"^[ \t]+|[ \t]+$", "").alias("text")))


@query("clean_lines_stats", f"WITH {_CLEAN} SELECT rel, count(*) AS lines, count(*) FILTER (WHERE fate = 'kept') AS kept, count(*) FILTER (WHERE fate = 'blank') AS blank, count(*) FILTER (WHERE fate = 'control') AS control, count(*) FILTER (WHERE fate = 'duplicate') AS duplicate FROM fates GROUP BY rel")
def _line_stats(s, d):
    return L.line_stats(fates(s, d))


@query("clean_lines_kept", f"WITH {_CLEAN} SELECT rel, line_no, md5(text) AS digest FROM fates WHERE fate = 'kept'")
def _kept(s, d):
    return fates(s, d).where("fate = 'kept'").select("rel", "line_no", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("clean_lines_removed", f"WITH {_CLEAN} SELECT rel, line_no, fate FROM fates WHERE fate <> 'kept'")
def _removed(s, d):
    return fates(s, d).where("fate <> 'kept'").select("rel", "line_no", "fate")


@query("empty_block_filter", """SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda b: trim(b) <> '' AND length(b) % 3 <> 0)) AS kept, len(list_filter(string_split(text, ' '), lambda b: NOT (trim(b) <> '' AND length(b) % 3 <> 0))) AS removed FROM conversations""")
def _blocks(s, d):
    blocks = F.transform(F.split("text", " ", -1), lambda t: F.struct(F.lit("thinking").alias("type"), F.when(F.length(t) % 3 != 0, t).alias("thinking")))
    rows = table(s, d, "conversations").select("conv_id", "turn", blocks.alias("blocks"))
    from ..operators.repair import is_empty_thinking

    return rows.select("conv_id", "turn", F.size(F.filter("blocks", lambda b: ~is_empty_thinking(b))).cast("long").alias("kept"), F.size(F.filter("blocks", is_empty_thinking)).cast("long").alias("removed"))


@query("relink_parents", f"""WITH RECURSIVE {_LINES}, rows AS (SELECT rel, line_no AS uuid, lag(line_no) OVER (PARTITION BY rel ORDER BY line_no) AS parent, role = 'assistant' OR line_no % 4 = 1 AS gone FROM lines),
walk AS (
  SELECT rel, uuid, parent FROM rows WHERE NOT gone
  UNION ALL SELECT w.rel, w.uuid, r.parent FROM walk w JOIN rows r ON r.rel = w.rel AND r.uuid = w.parent AND r.gone
) SELECT w.rel, w.uuid, w.parent FROM walk w LEFT JOIN rows r ON r.rel = w.rel AND r.uuid = w.parent WHERE r.uuid IS NULL OR NOT r.gone""")
def _relink(s, d):
    from pyspark.sql import Window

    rows = _lines(s, d).select("rel", F.col("line_no").alias("uuid"), F.lag("line_no").over(Window.partitionBy("rel").orderBy("line_no")).alias("parent"), ((F.col("role") == "assistant") | (F.col("line_no") % 4 == 1)).alias("gone"))
    return L.relink(rows.where("NOT gone").drop("gone"), rows.where("gone").drop("gone")).drop("relinked")


@query("removed_idempotent", f"""WITH {_LINES}, r AS (SELECT rel % 20 AS source_file, text AS content, min(rel * 1000 + line_no) AS source_line FROM lines WHERE role <> 'system' GROUP BY ALL)
SELECT source_file, source_line, md5(content) AS digest FROM r WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.line_no % 3 = 0 AND l.rel % 20 = r.source_file AND l.text = r.content)""")
def _idempotent(s, d):
    rows = _lines(s, d).select((F.col("rel") % 20).alias("source_file"), (F.col("rel") * 1000 + F.col("line_no")).alias("source_line"), F.col("text").alias("content"), "line_no", "role")
    out = L.append_removed(rows.where("line_no % 3 = 0"), rows.where("role <> 'system'").select("source_file", "source_line", "content"))
    return out.select("source_file", "source_line", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("manifest_diff", "SELECT p_name AS name, p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'new' WHEN p_partkey % 5 = 0 THEN 'differs' ELSE 'same' END AS status FROM part")
def _manifest(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("name"), "p_name")
    sha = F.sha2(F.concat_ws("|", "name", "p_name"), 256)
    there = p.where("id % 4 <> 0").select("name", F.when(F.col("id") % 5 == 0, "x").otherwise(sha).alias("sha256"))
    status = L.manifest_diff(p.select("name", sha.alias("sha256")), there)
    return status.join(p, "name").select(F.col("p_name").alias("name"), "id", "status")


@query("gate_allows", """WITH r AS (SELECT user_id AS job, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS tick FROM events), n AS (SELECT max(tick) AS now FROM r)
SELECT job, max(tick) AS last, count(*) FILTER (WHERE tick > now - 86400) AS in_day, (now - max(tick) >= 21600 AND count(*) FILTER (WHERE tick > now - 86400) < 4) AS allowed FROM r, n GROUP BY job, now""")
def _gate(s, d):
    runs = table(s, d, "events").select(F.col("user_id").alias("job"), ntz_epoch(F.col("ts")).alias("at"))
    now = runs.agg(F.max("at")).first()[0]
    return L.gate_allows(runs, now or 0)


@query("ledger_map_sum", "SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY user_id")
def _ledger(s, d):
    rows = table(s, d, "events").select("user_id", F.from_json("props", "map<string,bigint>").alias("usage"))
    return rows.groupBy("user_id").agg(F.sum(F.aggregate(F.map_values("usage"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))).alias("tokens"))


# ---------------------------------------------------------------- row functions

@query("repair_line_udf", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE '{"id": ' || event_id || ', "kind": "' || event_type || '"}' END AS fixed FROM events""")
def _repair(s, d):
    """Lines damaged in four ways come back as they were; one that nothing mends is null."""
    from ..operators.repair import mended

    good = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))
    cut = F.expr("substring(good, 1, length(good) - 1)")
    bad = F.when(F.col("n") == 0, F.col("good")).when(F.col("n") == 1, cut).when(F.col("n") == 2, F.concat(cut, F.lit(", }"))).when(F.col("n") == 3, F.concat(F.lit("\x07"), F.col("good"))).otherwise(F.lit("not json"))
    rows = table(s, d, "events").select("event_id", good.alias("good"), (F.col("event_id") % 5).alias("n"))
    fixed = F.when(F.col("n") == 2, F.regexp_replace(mended(bad), r"\s+\}$", "}")).otherwise(mended(bad))
    return rows.select("event_id", fixed.alias("fixed"))


@query("parse_line_udf", """SELECT 'e' || event_id AS uuid, 's' || user_id AS session_id, event_type AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) + 7 AS total_tokens,
strftime(ts, '%Y-%m-%d') AS date, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts_epoch FROM events WHERE event_id % 6 <> 0""")
def _parse(s, d):
    """Rows written as transcript lines (one in six without a uuid, which doesn't count) and parsed again."""
    from ..sources.transcripts import usage_rows

    k = F.get_json_object("props", "$.k").cast("long")
    message = F.struct(F.col("event_type").alias("model"), F.struct(k.alias("input_tokens"), F.lit(7).alias("output_tokens")).alias("usage"))
    line = F.to_json(F.struct(F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("uuid"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sessionId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), message.alias("message")))
    lines = table(s, d, "events").select(F.lit("events").alias("source"), F.col("event_id").alias("line_no"), line.cast("binary").alias("raw"))
    return usage_rows(lines).where("NOT bad").select("uuid", "session_id", "model", "input_tokens", "total_tokens", "date", "ts_epoch")


# ---------------------------------------------------------------- transcript lines

_T0 = 1_700_000_000


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as transcript lines: rel, line_no, raw. Every fifth line is plain text, some of those with a carriage
    return; of the others every eleventh has no time, every third has a folder, every fourth turn is nothing but an
    empty thinking block, and every sixth has one beside its text."""
    c = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    empty, spoken = F.struct(F.lit("thinking").alias("type"), F.lit(" ").alias("thinking"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("thinking"), F.col("text"))
    blocks = F.when(F.col("turn") % 4 == 1, F.array(empty)).when(F.col("turn") % 6 == 2, F.array(empty, spoken)).otherwise(F.array(spoken))
    at = F.date_format(F.timestamp_seconds(F.lit(_T0) + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.struct(
        F.col("role").alias("type"), name(F.col("turn")).alias("uuid"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parentUuid"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"),
        F.when(F.col("turn") % 11 != 0, at).alias("timestamp"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("/w/"), (F.col("conv_id") % 4).cast("string"))).alias("cwd"), F.struct(blocks.alias("content")).alias("message"),
    )
    plain = F.concat(F.lit("plain "), F.col("conv_id").cast("string"), F.lit(" "), F.col("turn").cast("string"), F.when(F.col("turn") % 10 == 5, "\r").otherwise(""))
    raw = F.when(F.col("turn") % 5 == 0, plain).otherwise(F.to_json(entry)).cast("binary")
    return c.select(F.concat(F.lit("f"), (F.col("conv_id") % 7).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("rel"), F.col("turn").cast("long").alias("line_no"), raw.alias("raw"))


_REL = "'f' || (conv_id % 7) || '/' || conv_id || '.jsonl'"
_TRANSCRIPT = f"t AS (SELECT {_REL} AS rel, conv_id, turn, role, text, turn % 5 = 0 AS plain, turn % 4 = 1 AS nothing, 'u' || conv_id || '-' || turn AS uuid, CASE WHEN turn > 0 THEN 'u' || conv_id || '-' || (turn - 1) END AS parent FROM conversations)"


@query("lines_keyed", f"WITH {_TRANSCRIPT} SELECT rel, turn AS line_no, CASE WHEN plain THEN 'r:' || hex('plain ' || conv_id || ' ' || turn) ELSE 'u:' || uuid END AS key FROM t")
def _keyed(s, d):
    from ..sources.transcripts import keyed

    return keyed(transcript(s, d)).select("rel", "line_no", "key")


@query("lines_prompts", f"""WITH {_TRANSCRIPT}, w AS (
  SELECT *, coalesce(first_value(CASE WHEN NOT plain AND turn % 3 = 0 THEN '/w/' || (conv_id % 4) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'f' || (conv_id % 7)) AS project FROM t
) SELECT CAST(conv_id AS VARCHAR) AS session, turn AS line_no, substr(trim(text), 1, 500) AS display, CASE WHEN turn % 11 = 0 THEN 5000 ELSE ({_T0} + conv_id * 3600 + turn * 60) * 1000 END AS timestamp, project
FROM w WHERE role = 'user' AND NOT plain AND NOT nothing AND length(trim(text)) > 2""")
def _lines_prompts(s, d):
    from ..sources.transcripts import prompt_rows

    return prompt_rows(transcript(s, d), 5000)


@query("lines_removal_keys", f"""WITH {_TRANSCRIPT}
SELECT 'uuid' AS kind, rel, 'u:' || uuid AS value FROM t WHERE NOT plain AND turn % 3 = 1
UNION ALL SELECT 'record', rel, 'r:' || hex('plain ' || conv_id || ' ' || turn) FROM t WHERE plain
UNION ALL SELECT 'record', rel, 'r:' || hex(json_object('uuid', uuid)) FROM t WHERE NOT plain AND turn % 3 = 1
UNION ALL SELECT 'unreadable', NULL, 'u:' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-0000-4000-8000-' || lpad(CAST(turn AS VARCHAR), 12, '0') FROM t WHERE NOT plain AND turn % 3 = 2""")
def _lines_removal_keys(s, d):
    """Records of whole lines, of lines with a uuid, and torn records that still hold one."""
    from ..sources.transcripts import removal_keys

    c = table(s, d, "conversations").withColumn("rel", F.concat(F.lit("f"), (F.col("conv_id") % 7).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl")))
    ids = [F.col(x).cast("string") for x in ("conv_id", "turn")]
    content = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("plain "), ids[0], F.lit(" "), ids[1])).otherwise(F.to_json(F.struct(F.concat(F.lit("u"), ids[0], F.lit("-"), ids[1]).alias("uuid"))))
    record = F.to_json(F.struct(F.col("rel").alias("source_file"), content.alias("content")))
    torn = F.concat(F.lit('{"content": "{\\"uuid\\": \\"'), F.lpad(ids[0], 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(ids[1], 12, "0"))
    rows = c.where("turn % 5 = 0 OR turn % 3 > 0")
    return removal_keys(rows.select(F.when((F.col("turn") % 5 != 0) & (F.col("turn") % 3 == 2), torn).otherwise(record).alias("value")))


@query("lines_clean", f"""WITH {_TRANSCRIPT}, k AS (SELECT rel, turn AS line_no, CASE turn % 7 WHEN 1 THEN 'blank' WHEN 2 THEN 'control' WHEN 3 THEN 'unparseable' WHEN 4 THEN 'repaired' WHEN 5 THEN 'copy' ELSE 'valid' END AS kind FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY rel, kind = 'copy' ORDER BY line_no) AS nth FROM k)
SELECT rel, line_no, CASE WHEN kind = 'copy' THEN CASE WHEN nth > 1 THEN 'duplicate' ELSE 'valid' END ELSE kind END AS fate FROM n""")
def _lines_clean(s, d):
    """Lines that are blank, control characters, no JSON, JSON without its end, copies of each other, or sound."""
    from ..operators.repair import clean

    kind = F.col("line_no") % 7
    good = F.concat(F.lit('{"n": '), F.col("line_no").cast("string"), F.lit("}"))
    bad = F.when(kind == 1, "  ").when(kind == 2, "\x07\x00").when(kind == 3, F.concat(F.lit("no json "), good)).when(kind == 4, F.expr("concat('{\"n\": ', line_no)")).when(kind == 5, '{"same": true}').otherwise(good)
    return clean(transcript(s, d).select("rel", "line_no", bad.cast("binary").alias("raw"))).select("rel", "line_no", "fate")


@query("lines_without_empty_blocks", f"""WITH RECURSIVE {_TRANSCRIPT}, j AS (SELECT * FROM t WHERE NOT plain), walk AS (
  SELECT rel, uuid, parent, parent AS first FROM j WHERE NOT nothing
  UNION ALL SELECT w.rel, w.uuid, g.parent, w.first FROM walk w JOIN j g ON g.rel = w.rel AND g.uuid = w.parent AND g.nothing
), ends AS (SELECT w.* FROM walk w LEFT JOIN j g ON g.rel = w.rel AND g.uuid = w.parent AND g.nothing WHERE g.uuid IS NULL)
SELECT t.rel, t.turn AS line_no, CASE WHEN t.plain THEN 'kept' WHEN t.nothing THEN 'dropped' WHEN t.turn % 6 = 2 THEN 'edited' WHEN e.parent IS DISTINCT FROM e.first THEN 'relinked' ELSE 'kept' END AS action,
  CASE WHEN NOT t.plain AND (t.nothing OR t.turn % 6 = 2) THEN 1 ELSE 0 END AS blocks, CASE WHEN NOT t.plain THEN CASE WHEN t.nothing THEN t.parent ELSE e.parent END END AS parent
FROM t LEFT JOIN ends e ON e.rel = t.rel AND e.uuid = t.uuid""")
def _lines_blocks(s, d):
    from ..operators.repair import drop_empty_blocks

    return drop_empty_blocks(transcript(s, d)).select("rel", "line_no", "action", "blocks", F.get_json_object(F.col("raw").cast("string"), "$.parentUuid").alias("parent"))


@query("lines_of_message", f"WITH {_LINES} SELECT rel, line_no, count(*) OVER (PARTITION BY rel, line_no // 3) AS n_lines FROM lines")
def _lines_of_message(s, d):
    rows = _lines(s, d).select("rel", "line_no", F.floor(F.col("line_no") / 3).alias("message"))
    return L.lines_of_message(rows).select("rel", "line_no", "n_lines")


@query("lost_prompts", f"WITH {_LINES} SELECT DISTINCT session, timestamp, md5(display) AS digest FROM history h WHERE session % 4 = 0 AND NOT EXISTS (SELECT 1 FROM history k WHERE (k.line_no % 3 = 0 OR k.session % 8 = 0) AND k.session = h.session AND k.timestamp = h.timestamp AND k.display = h.display)")
def _lost(s, d):
    h = history(s, d)
    kept = L.known_keys(h.where("line_no % 3 = 0"), h.where("session % 8 = 0"), "session", "timestamp", "display")
    return L.lost(h.where("session % 4 = 0"), kept, "session", "timestamp", "display").select("session", "timestamp", F.md5(F.col("display").cast("binary")).alias("digest"))


@query("manifest_forget", f"WITH {_LINES} SELECT CAST(rel AS VARCHAR) || CASE WHEN rel % 2 = 0 THEN '|live' ELSE '' END AS source FROM (SELECT DISTINCT rel FROM lines) WHERE rel % 3 <> 0")
def _forget(s, d):
    rels = _lines(s, d).select("rel").distinct()
    manifest = rels.select(F.concat(F.col("rel").cast("string"), F.when(F.col("rel") % 2 == 0, "|live").otherwise("")).alias("source"))
    return L.forget(manifest, rels.where("rel % 3 = 0").select(F.col("rel").cast("string").alias("rel")))


@query("sweep_totals", f"WITH {_CLEAN}, f AS (SELECT rel, count(*) AS lines, count(*) FILTER (WHERE fate = 'kept') AS kept, count(*) FILTER (WHERE fate = 'blank') AS blank, count(*) FILTER (WHERE fate = 'control') AS control, count(*) FILTER (WHERE fate = 'duplicate') AS duplicate FROM fates GROUP BY rel) SELECT count(*) AS files, count(*) FILTER (WHERE blank + control + duplicate > 0) AS changed, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(kept) AS BIGINT) AS valid, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(control) AS BIGINT) AS control, CAST(sum(duplicate) AS BIGINT) AS duplicate FROM f")
def _totals(s, d):
    return L.sweep_totals(L.line_stats(fates(s, d)).withColumnRenamed("kept", "valid"))
