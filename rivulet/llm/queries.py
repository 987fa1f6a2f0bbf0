"""Queries of this folder, for the driver's entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10

_ALL = (op01, op02, op03, op04, op05, op06, op07, op08, op09, op10)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _ALL for k, v in getattr(m, "ORACLES", {}).items()}
