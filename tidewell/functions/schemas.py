"""Columns of the usage store and of the other record kinds."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

#: One row per line that reports usage. Missing text is '', not null, so that grouping sees it.
USAGE_EVENTS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("uuid", _S), ("session_id", _S), ("request_id", _S), ("message_id", _S), ("ts_iso", _S), ("ts_epoch", _L), ("date", _S),
        ("month", _S), ("hour", _I), ("model", _S), ("project", _S), ("git_branch", _S), ("cc_version", _S), ("is_sidechain", _I),
        ("service_tier", _S), ("speed", _S), ("effort", _S), ("stop_reason", _S), ("input_tokens", _L), ("output_tokens", _L),
        ("cache_creation_tokens", _L), ("cache_read_tokens", _L), ("ephemeral_5m_tokens", _L), ("ephemeral_1h_tokens", _L),
        ("total_tokens", _L), ("cost_usd", _D), ("source_file", _S),
    )]
)
TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")

#: Rates in whole micro-USD per million tokens: costs are exact integers of 1e-12 USD until they're shown.
PRICING = T.StructType([T.StructField("pattern", _S)] + [T.StructField(n, _L) for n in ("rate_input", "rate_output", "rate_cache_5m", "rate_cache_1h", "rate_cache_read")])
RATES = tuple(PRICING.names[1:])

RAW_LINES = T.StructType([T.StructField("rel", _S), T.StructField("line_no", _L), T.StructField("raw", T.BinaryType())])
PROMPTS = T.StructType([T.StructField("session_id", _S), T.StructField("line_no", _L), T.StructField("display", _S), T.StructField("timestamp", _L), T.StructField("project", _S)])
REMOVED = T.StructType([T.StructField("archived_at", _S), T.StructField("source_file", _S), T.StructField("source_line", _L), T.StructField("reason", _S), T.StructField("content", _S)])
