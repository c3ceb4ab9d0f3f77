"""Named queries of the core with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.queries import more, problems, reference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**problems.QUERIES, **reference.QUERIES, **more.QUERIES}
ORACLE: dict[str, str] = {**problems.ORACLE, **reference.ORACLE, **more.ORACLE}


flagship = reference.flagship
