"""Exports: one CSV file for each view, and tab-separated text."""

from __future__ import annotations

import csv
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame


def text_rows(df: DataFrame, sep: str = "\t") -> Iterator[str]:
    """Header and rows, nulls as nothing, streamed through the driver one partition at a time."""
    yield sep.join(df.columns)
    for row in df.toLocalIterator():
        yield sep.join("" if v is None else str(v) for v in row)


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file, header first, nulls and '' both as nothing: written beside its place and renamed. For reports, whose
    rows are few; a large result belongs in `df.write`."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, held = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(fd, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
        f.flush()
        os.fsync(f.fileno())
    os.replace(held, path)
    return path
