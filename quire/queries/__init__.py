"""Registered queries: each module has QUERIES (name to function) and ORACLES (name to DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.queries import chunking, crossref, diff, language, report, sources, state, tables, triage, vectors

MODULES = (sources, chunking, language, tables, crossref, state, diff, vectors, triage, report)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
