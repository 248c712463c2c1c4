"""The queries of the subpackage, with production parameters, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _name in ("q_tokens", "q_mixing", "q_vectors", "q_pii", "q_near", "q_lines", "q_quality", "q_substrings", "q_lm", "q_negatives", "q_codes", "q_toxicity"):
    _module = import_module(f"docloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
