"""Ranking of search results by the quality of their evidence, and resolution of competing claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenza.functions import scoring, text
from evidenza.runtime import broadcast_if_small, numbered


def lane_normalized(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """``relevance``: scores of each lane mapped to 0.05..1; a lane of one value gets 1 if it is positive, else 0.01.

    The bounds of a lane are aggregated before the shuffle, so a lane that holds most rows is never gathered.
    """
    bounds = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    rows = df.join(broadcast_if_small(bounds), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]))
    lo, hi = F.col("_lo"), F.col("_hi")
    return rows.withColumn("relevance", F.when(hi > lo, 0.05 + 0.95 * (F.col(score) - lo) / (hi - lo)).when(F.col(score) > 0, 1.0).otherwise(0.01)).drop("_lo", "_hi", *[f"_{c}" for c in by])


def duplicate_penalty(df: DataFrame, by: list[str], content: str, order: list, penalty: float = 0.65) -> DataFrame:
    """``diversity``: 1 for the first of each normalized content, the penalty for the others; null contents are of one sort."""
    rows = df.withColumn("_key", F.coalesce(text.content_key(F.col(content)), F.lit("")))
    rows = numbered(rows, [*by, "_key"], order, "_n")
    return rows.withColumn("diversity", F.when(F.col("_n") > 1, penalty).otherwise(1.0)).drop("_key", "_n")


def signal(trust: Column, confidence: Column, verified: Column, seen: Column, source: Column) -> Column:
    """The quality of evidence in 0 to 1; missing trust and confidence count 0.5. The weights are fixed values."""
    corroborated = F.least(F.lit(1.0), (F.greatest(F.coalesce(seen, F.lit(1)), F.lit(1)) - 1) / 4)
    out = 0.35 * scoring.or_half(trust) + 0.30 * scoring.or_half(confidence) + 0.15 * F.when(verified, 1.0).otherwise(0.0) + 0.10 * corroborated + 0.10 * scoring.lookup(scoring.AUTHORITY, source, 0.65)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def applicability(status: Column, valid: Column | None = None, condition: Column | None = None) -> Column:
    out = F.when(status.isin("superseded", "historical"), 0.45).when(status.isin("contradicted", "unresolved"), 0.85).otherwise(1.0)
    if condition is not None:
        out = out * F.when(condition, 1.0).otherwise(0.70)
    if valid is not None:
        out = out * F.when(valid, 1.0).otherwise(0.25)
    return out


def quality_ranked(df: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Rows (query, key, relevance, diversity, applicability, signal) by the product of all, best k of each query."""
    q = F.col("relevance") * F.col("applicability") * (0.80 + 0.40 * F.col("signal")) * F.col("diversity")
    order = Window.partitionBy(query).orderBy(F.desc(F.round("quality", 9)), key)
    return df.withColumn("quality", q).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_content(df: DataFrame, by: list[str], content: str, order: list) -> DataFrame:
    """One row a normalized content: the first in the given order."""
    w = Window.partitionBy(*by, text.content_key(F.col(content))).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def claim_winners(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """The winner of each claim group and how many alternatives there are: certain before uncertain, then confidence, score, time."""
    w = Window.partitionBy(*group).orderBy(F.col("uncertain"), F.desc("confidence"), F.desc("score"), F.desc_nulls_last("at"), key)
    n = df.groupBy(*group).agg((F.count("*") - 1).alias("n_alternatives"), F.expr("max(uncertain) and not min(uncertain)").alias("mixed"))
    best = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    return best.join(n, group).withColumn("resolution", F.when(F.col("mixed"), "unresolved").otherwise("resolved")).drop("mixed")
