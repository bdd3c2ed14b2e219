"""The queries of the problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenza.llm import conversations, cooccurrence, near_records, packing, personal, survivors, tokens, truncation, vectors
from evidenza.runtime import table


def _pairs(df: DataFrame, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    return df.select(F.least(a, b).alias(names[0]), F.greatest(a, b).alias(names[1])).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(vectors.similar_vectors(table(spark, sf_dir, "memory_vectors")), "id", "other", ("memory_a", "memory_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_records.near_records(table(spark, sf_dir, "memories"), "id", "content")
    return near_records.expanded(links, members).select(F.col("a").alias("memory_a"), F.col("b").alias("memory_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "memories")).select("group_id", "trusted_id", "newest_id", "source_row_id")


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "memories"))


def _together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.appearing_together(table(spark, sf_dir, "memory_entities"), "memory_id", "entity_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _together(spark, sf_dir).where((F.col("n_ab") >= 5) & (F.col("lift") >= 3.17))
    return pairs.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _together(spark, sf_dir).select("a", "b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("llr", 3).alias("llr"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "sessions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = _conversations(spark, sf_dir).where(~F.col("is_thread") & F.col("reason").isNotNull())
    return dropped.select(F.col("conversation").alias("session_id"), "reason")


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuilt(table(spark, sf_dir, "messages"), table(spark, sf_dir, "sessions"))


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = personal.texts(table(spark, sf_dir, "turns"), "turns", "id", ["user_text", "assistant_text"])
    return turns.unionByName(personal.texts(table(spark, sf_dir, "memories"), "memories", "id", ["content"]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal(_personal_texts(spark, sf_dir), table(spark, sf_dir, "known_names"))
    return found.select("src", "row_id", "field", "kind", "item").distinct()


def p6_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _personal_texts(spark, sf_dir)
    return personal.replaced(rows, personal.personal(rows, table(spark, sf_dir, "known_names")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.containers(counts, "doc_id", "n")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = truncation.endings(table(spark, sf_dir, "documents"))
    return judged.where("truncated").select(F.col("doc_id").cast("bigint").alias("doc_id"))


def p9_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.by_source(truncation.endings(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_survivors, p4_found, p4_pairs, p5_found, p5_conversations, p6_found, p6_replaced, p7_ids, p8_containers, p9_found, p9_by_source)}
