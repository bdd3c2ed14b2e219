"""The engine's tables from the stored ones: one reading of each, shared by all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidenza.functions import scoring
from evidenza.runtime import table

#: The instant that batch queries count ages from.
NOW = "2025-06-30 00:00:00"


def latest(df: DataFrame, key: str, updated: str, **derived: Column) -> DataFrame:
    """The newest row of each key, a missing time being oldest; of equal times the greatest by content.

    ``derived`` are further columns made of a stored row; where they are wanted in a long text's stead, the text isn't shuffled.
    """
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(updated), F.desc(F.xxhash64(*[F.to_json(F.struct(*[f"`{c}`" for c in df.columns]))])))
    return df.withColumns(derived).where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def memories(spark: SparkSession, sf_dir: str, **derived: Column) -> DataFrame:
    """The newest version of each memory, with source in one spelling, impossible trust as null and defaults for null scope."""
    rows = latest(table(spark, sf_dir, "memories"), "id", "updated_at", **derived)
    return rows.withColumns({
        "source": F.coalesce(scoring.source_name(F.col("source")), F.lit("unknown")), "trust": scoring.valid_trust(F.col("trust_score")),
        "agent": F.coalesce("agent", F.lit("")), "visibility": F.coalesce("visibility", F.lit("private")), "status": F.coalesce("status", F.lit("active")),
    })


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (memory_id, entity_id) without nulls."""
    return table(spark, sf_dir, "memory_entities").where("memory_id IS NOT NULL AND entity_id IS NOT NULL").select("memory_id", "entity_id").distinct()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, each id once."""
    rows = table(spark, sf_dir, "messages")
    return latest(rows, "id", "timestamp")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "sessions"), "id", "started_at")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "turns"), "id", "created_at")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements from the event stream: subject the user, predicate the type, object the bucket of the value."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.floor(F.col("value") / 10).cast("bigint").alias("object"),
        F.col("ts").alias("observed_at"), (0.5 + 0.5 * (k % 2)).alias("confidence"), ((k % 3) == 0).alias("verified"), (k % 5 + 1).alias("seen_count"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome signals from the event stream, on one of 500 memories each."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), (F.col("event_id") % 500).alias("memory_id"), F.concat(F.lit("agent-"), (F.col("user_id") % 8).cast("string")).alias("agent"), F.col("user_id"),
        kind.alias("signal_type"), F.when(kind == "error", -1).otherwise(1).alias("direction"), F.when(kind == "purchase", 1.0).when(kind == "click", 0.5).when(kind == "signup", 0.8).when(kind == "error", 1.0).otherwise(0.2).alias("weight"),
        kind.isin("purchase", "error").alias("explicit"), F.col("ts").cast("timestamp").alias("created_at"),
    )
