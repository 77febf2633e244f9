"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from tidewell.llm.pipeline import STAGES, run  # noqa: F401

#: Trained scores, tokenisation and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None
