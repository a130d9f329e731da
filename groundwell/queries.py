"""The registry of the library's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwell.plans import calibration, claims, decisions, ingest, providers, records, retrieval, revision, runs, stored, traces

_PLANS = (calibration, claims, decisions, ingest, providers, records, retrieval, revision, runs, stored, traces)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}
