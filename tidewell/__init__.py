"""Analytics over append-only JSON-lines logs, built on Spark DataFrames."""
