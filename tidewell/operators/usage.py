"""Usage: two levels of de-duplication, prices, and the views over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_text, rounded_cost
from ..functions.schemas import RATES, TOKENS


#: Patterns of a price list up to which it becomes an expression.
FEW_PRICES = 200


def latest_by_uuid(lines: DataFrame, *order: Column, key: str = "uuid") -> DataFrame:
    """Last write wins: of the rows of a uuid, the one that `order` puts last. Spark keeps one row a group on the map side."""
    last = Window.partitionBy(key).orderBy(*[c.desc_nulls_last() for c in order])
    return lines.withColumn("rn_", F.row_number().over(last)).where("rn_ = 1").drop("rn_")


def winner_per_message(events: DataFrame) -> DataFrame:
    """One row for each (session, message): most tokens, then latest, then least uuid. '' is a message id like others."""
    best = Window.partitionBy("session_id", "message_id").orderBy(F.desc("total_tokens"), F.desc_nulls_last("ts_epoch"), F.asc("uuid"))
    return events.withColumn("rn_", F.row_number().over(best)).where("rn_ = 1").drop("rn_")


def costed(events: DataFrame, pricing: DataFrame) -> DataFrame:
    """Adds c12, the cost in 1e-12 USD: rates of the longest pattern that the model starts with, ignoring case; none, 0.
    Patterns of one length go by their text.

    A price list of at most FEW_PRICES patterns becomes an expression: no join, and no second reading of the events. A
    longer one meets the distinct models, and its rates come back by an equi-join.
    """
    prices = pricing.select("pattern", *RATES).limit(FEW_PRICES + 1).collect()
    if len(prices) <= FEW_PRICES:
        one = lambda p: F.struct(*[F.lit(p[r]).cast("long").alias(r) for r in RATES])
        rates = F.lit(None).cast(f"struct<{','.join(f'{r}:long' for r in RATES)}>")
        for p in sorted((p for p in prices if p["pattern"] is not None), key=lambda p: (len(p["pattern"]), p["pattern"])):
            rates = F.when(_starts(F.col("model"), F.lit(p["pattern"])), one(p)).otherwise(rates)
        rows = events.withColumn("r", rates)
    else:
        models = events.select(F.col("model").alias("priced")).distinct()
        best = models.join(pricing, _starts(F.col("priced"), F.col("pattern"))).groupBy("priced").agg(F.max_by(F.struct(*RATES), F.struct(F.length("pattern"), F.col("pattern"))).alias("r"))
        rows = events.join(best, F.col("model") == F.col("priced"), "left").drop("priced")
    rate = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(0).cast("long"))
    rest = F.col("cache_creation_tokens") - F.col("ephemeral_5m_tokens") - F.col("ephemeral_1h_tokens")
    c12 = (
        F.col("input_tokens") * rate("rate_input") + F.col("output_tokens") * rate("rate_output") + F.col("cache_read_tokens") * rate("rate_cache_read")
        + (F.col("ephemeral_5m_tokens") + rest) * rate("rate_cache_5m") + F.col("ephemeral_1h_tokens") * rate("rate_cache_1h")
    )
    return rows.withColumn("c12", c12).drop("r")


def _starts(model: Column, pattern: Column) -> Column:
    return F.lower(model).startswith(F.lower(pattern))


def total_cost() -> Column:
    """Sum of c12, of a group of any size: beyond 9.2 million USD it doesn't fit a long."""
    return F.sum(F.col("c12").cast("decimal(38,0)"))


@dataclass(frozen=True)
class View:
    """keys: grouping columns; wanted: measures in order; where: rows that count; order: how a report shows it."""

    keys: tuple[str, ...]
    wanted: tuple[str, ...]
    where: str | None = None
    order: tuple[str, ...] = ()


def measure(name: str) -> Column:
    total = lambda c: F.sum(c).cast("long")
    known = {
        "events": F.count("*"), "sessions": F.count_distinct("session_id"), "models_used": F.count_distinct("model"),
        "cost_usd": rounded_cost(total_cost()), "first_used": F.min("date"), "last_used": F.max("date"), "week_start": F.min("date"), "week_end": F.max("date"),
        "first_activity": F.min("ts_iso"), "last_activity": F.max("ts_iso"), "started": F.min("ts_iso"), "ended": F.max("ts_iso"), "project": F.max("project"),
        "models": F.array_join(F.array_sort(F.collect_set("model")), ","),
        "duration_min": F.round((F.max("ts_epoch") - F.min("ts_epoch")) / F.lit(60.0), 1), "messages": F.count("*"),
    }
    if name in known:
        return known[name].alias(name)
    return total(name).alias(name)


_ALL = ("events", "sessions", *TOKENS, "total_tokens", "cost_usd")
_BY_MODEL = ("events", *TOKENS, "total_tokens", "cost_usd")
VIEWS = {
    "daily": View(("date",), _ALL, order=("date",)),
    "monthly": View(("month",), _ALL, order=("month",)),
    "by_model": View(("model",), ("events", "sessions", "first_used", "last_used", *TOKENS, "total_tokens", "cost_usd"), order=("-total_tokens", "model")),
    "daily_by_model": View(("date", "model"), ("events", "total_tokens", "cost_usd"), order=("date", "-total_tokens", "model")),
    "by_session": View(("session_id",), ("first_activity", "last_activity", "events", "models_used", "project", "total_tokens", "cost_usd"), order=("-total_tokens", "session_id")),
    "by_project": View(("project",), ("events", "sessions", "total_tokens", "cost_usd"), where="project IS NOT NULL AND project <> ''", order=("-total_tokens", "project")),
    "hour_of_day": View(("hour",), ("events", "total_tokens"), order=("hour",)),
    "hourly_ts": View(("hour_bucket",), _ALL, order=("hour_bucket",)),
    "hourly_ts_by_model": View(("hour_bucket", "model"), _BY_MODEL, order=("hour_bucket", "-total_tokens", "model")),
    "weekly": View(("week",), ("week_start", "week_end", *_ALL), order=("week",)),
    "weekly_by_model": View(("week", "model"), _BY_MODEL, order=("week", "-total_tokens", "model")),
    "monthly_by_model": View(("month", "model"), _BY_MODEL, order=("month", "-total_tokens", "model")),
    "sessions_timeline": View(("session_id",), ("started", "ended", "duration_min", "project", "events", "models", "total_tokens", "cost_usd"), order=("started", "session_id")),
    "blocks_5h": View(("block",), ("events", "sessions", "total_tokens", "cost_usd"), order=("-block_start",)),
    "usage_rollup": View(("session_id", "date", "model"), ("messages", *TOKENS, "ephemeral_5m_tokens", "ephemeral_1h_tokens", "total_tokens")),
}


def view(name: str, rows: DataFrame) -> DataFrame:
    """A view over costed winners, not sorted: sorting is a report's business (see `ordered`)."""
    v = VIEWS[name]
    if v.where:
        rows = rows.where(v.where)
    out = rows.groupBy(*v.keys).agg(*[measure(m) for m in v.wanted])
    if name == "blocks_5h":
        out = out.select(epoch_text(F.col("block") * 18000).alias("block_start"), epoch_text(F.col("block") * 18000 + 18000).alias("block_end"), *v.wanted)
    return out


def ordered(name: str, df: DataFrame) -> DataFrame:
    return df.orderBy(*[F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_first(c) for c in VIEWS[name].order])


def last_n(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n last rows by `by`, first to last."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in by]).limit(n).orderBy(*[F.asc_nulls_first(c) for c in by])


def stats(events: DataFrame) -> DataFrame:
    """One row over costed winners."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return events.agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("model").alias("models"), F.count_distinct("project").alias("projects"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), *[total(c) for c in (*TOKENS, "total_tokens")], rounded_cost(F.coalesce(total_cost(), F.lit(0))).alias("cost_usd"),
    )


def stats_raw(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"))


def reconcile(rows: DataFrame) -> DataFrame:
    """Each view's grand total against the total of the rows: view, total_tokens, delta. By project, '' is added back.

    One pass: the views' keys are grouping sets, whose sums are added up by view."""
    keys = list(dict.fromkeys(k for v in VIEWS.values() for k in v.keys))
    sets = [[F.col(k) for k in keys_] for keys_ in dict.fromkeys(v.keys for v in VIEWS.values())]
    grouped = rows.select(*keys, "total_tokens").groupingSets([*sets, []], *keys).agg(F.grouping_id().alias("id"), F.sum("total_tokens").alias("total"))
    bit = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    ids = {name: sum(bit.values()) - sum(bit[k] for k in v.keys) for name, v in VIEWS.items()}
    sums = grouped.groupBy("id").agg(F.sum("total").alias("total"))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("view"), F.lit(i).cast("long").alias("of")) for name, i in ids.items()])).alias("v")
    grand = sums.where(F.col("id") == sum(bit.values())).select(F.coalesce("total", F.lit(0)).cast("long").alias("grand"))
    views = grand.select("grand", named).select("grand", "v.view", "v.of")  # one row for each view
    out = views.join(sums, F.col("of") == F.col("id"), "left")
    return out.select("view", F.coalesce("total", F.lit(0)).cast("long").alias("total_tokens"), (F.coalesce("total", F.lit(0)).cast("long") - F.col("grand")).alias("delta"))
