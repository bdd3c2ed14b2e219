"""Consolidation: pairs of recent records that may be one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenza.operators.search import semantic


def candidate_pairs(vectors: DataFrame, key: str, vector: str, recent: DataFrame, least: float = 0.6, per_row: int = 5, limit: int = 30, group: list[str] | None = None) -> DataFrame:
    """(a, b, similarity): the recent rows' nearest ones of their group, each pair once, the ``limit`` most similar pairs."""
    asked = vectors.join(recent.select(key).distinct(), key, "left_semi").select(F.col(key).alias("query_id"), F.col(vector).alias("vec"), *(group or []))
    hits = semantic(vectors, key, vector, asked, per_row, least, group)
    pairs = hits.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("score").alias("similarity"))
    return pairs.orderBy(F.desc(F.round("similarity", 9)), "a", "b").limit(limit)
