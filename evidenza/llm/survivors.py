"""Best representative of each duplicate group: window ordering inside groups of superseding records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenza.llm.components import connected_components
from evidenza.runtime import cut


def latest_versions(df: DataFrame, key: str = "id", updated: str = "updated_at") -> DataFrame:
    """One row a key: the latest by ``updated``, a missing time being earliest; among equal times the greatest row by its JSON."""
    rows = df.where(F.col(key).isNotNull())
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy(F.col(key)).agg(F.max_by(whole, F.struct(F.col(updated), F.xxhash64(F.to_json(whole)))).alias("row"))
    return best.select("row.*")


def superseding_groups(latest: DataFrame, key: str = "id", by: str = "superseded_by") -> DataFrame:
    """(node, component) of the records tied by ``by``, directly or through further ones.

    Links to ids without a row, to the record itself and null links tie nothing; circles are ordinary groups.
    """
    links = latest.where(F.col(by).isNotNull() & (F.col(by) != F.col(key))).select(F.col(key).alias("a"), F.col(by).alias("b"))
    there = latest.select(F.col(key).alias("b"))
    return connected_components(links.join(there, "b", "left_semi"))


def survivors(df: DataFrame, key: str = "id", by: str = "superseded_by", trust: str = "trust_score", updated: str = "updated_at", source: str = "source") -> DataFrame:
    """(group_id, trusted_id, newest_id, source_row_id, n_records, built_trust, built_updated_at, built_source): the surviving record of each group of two or more.

    A trust outside 0 to 1 (or NaN) counts as missing, and missing values as lowest. The survivor has the highest trust,
    then the latest time, then the smallest id; the newest has the latest time, then the smallest id; the source row is
    chosen as the survivor is, among rows whose source is not null or blank (null if there is none). The built columns are the
    surviving record field by field: the trust of the survivor, the newest time and the source row's source.
    """
    # read several times below, without the texts
    latest = cut(latest_versions(df.select(*dict.fromkeys((key, by, trust, updated, source))), key, updated))
    groups = superseding_groups(latest, key, by)
    t = F.col(trust).cast("double")
    kept = latest.select(
        F.col(key).alias("node"),
        F.when((t >= 0) & (t <= 1) & ~F.isnan(t), t).alias("trust"),
        F.col(updated).alias("at"),
        F.when(F.trim(F.regexp_replace(F.col(source), r"[\s\u0085 ]+", " ")) != "", F.col(source)).alias("src"),
    )
    rows = groups.join(kept, "node")
    purposes = F.explode(F.array(*[F.lit(x) for x in ("trusted", "newest", "source")])).alias("purpose")
    rows = rows.select("component", "node", "trust", "at", "src", purposes).where((F.col("purpose") != "source") | F.col("src").isNotNull())
    rows = rows.withColumn("first", F.when(F.col("purpose") != "newest", F.col("trust")))
    order = Window.partitionBy("component", "purpose").orderBy(F.desc_nulls_last("first"), F.desc_nulls_last("at"), "node")
    best = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") == 1)
    pick = lambda p, c: F.max(F.when(F.col("purpose") == p, F.col(c)))
    best = best.groupBy("component").agg(
        pick("trusted", "node").alias("trusted_id"), pick("newest", "node").alias("newest_id"), pick("source", "node").alias("source_row_id"),
        pick("trusted", "trust").alias("trust"), pick("newest", "at").alias("newest_at"), pick("source", "src").alias("built_source"),
    )
    size = groups.groupBy("component").agg(F.count("*").alias("n_records"))
    return best.join(size, "component").select(
        F.col("component").alias("group_id"), "trusted_id", "newest_id", "source_row_id", "n_records",
        F.col("trust").alias("built_trust"), F.col("newest_at").alias("built_updated_at"), "built_source",
    )
