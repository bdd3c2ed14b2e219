"""All queries of the engine by name, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(queries().values()))(spark, sf_dir)


def _parts() -> tuple:
    from evidenza.plans import archive, evidence, extras, recall, retrieval, streams, upkeep

    return (retrieval, recall, evidence, archive, upkeep, extras, streams)


def queries() -> dict[str, Query]:
    return {k: v for p in _parts() for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _parts() for k, v in p.ORACLE.items()}
