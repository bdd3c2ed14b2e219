"""Quality of retrieval against relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidenza.functions import text
from evidenza.operators import recall


def ranking_metrics(results: DataFrame, judged: DataFrame, query: str = "query_id", key: str = "id", at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall at some ranks, reciprocal rank and nDCG@5 of each judged query; a query without results scores 0."""
    hits = judged.select(query, key).distinct().join(results.select(query, key, "rank"), [query, key], "left")
    gain = F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = hits.groupBy(query).agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in at], F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.select(query, *[F.round(F.col(f"h{k}") / F.col("n"), 6).alias(f"recall_{k}") for k in at], F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg_5"))


def by_category(metrics: DataFrame, category: str, values: list[str]) -> DataFrame:
    """Means by category and over all, in one pass."""
    return metrics.rollup(category).agg(F.count("*").alias("n"), *[F.round(F.avg(v), 4).alias(v) for v in values]).withColumn(category, F.coalesce(category, F.lit("(all)")))


def scenarios(cases: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, category, recall_1, recall_3, recall_5, mrr, ndcg_5, stale, passed): evaluation cases, each over its own turns.

    ``cases`` are valid ones as of ``sources.files.cases``. The turns of a case are a store of its own, so no case sees another's; its
    question is asked by its words. ``stale`` counts results that the case names as outdated; a case passes if all that it
    wants is among the first five and nothing is stale.
    """
    turns = cases.select("case_id", F.explode("sessions").alias("s")).select("case_id", F.explode("s.turns").alias("t"))
    of = lambda label: F.concat_ws("/", "case_id", label)
    none = F.lit(None).cast("string")
    stored = turns.select(of(F.col("t.label")).alias("id"), F.col("case_id").alias("agent"), F.lit("private").alias("visibility"), F.lit("conversation").alias("source"), F.lit("fact").alias("type"), none.alias("source_id"), F.concat_ws(" ", "t.user", "t.assistant").alias("content"), F.array().cast("array<string>").alias("tags"))
    asked = cases.select(F.col("case_id").alias("query_id"), F.col("case_id").alias("owner"), text.tokens(text.retrieval_words(F.col("query.text"))).alias("terms"))
    found = recall.keyword_lane(stored, asked, k)
    labels = lambda c: cases.select("case_id", F.explode(F.coalesce(F.col(f"expected.{c}"), F.array().cast("array<string>"))).alias("label")).select(F.col("case_id").alias("query_id"), of(F.col("label")).alias("id"))
    metrics = ranking_metrics(found, labels("supporting_memory_labels"))
    stale = found.join(labels("stale_memory_labels"), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("stale"))
    rows = metrics.join(stale, "query_id", "left").join(cases.select(F.col("case_id").alias("query_id"), "category"), "query_id").withColumn("stale", F.coalesce("stale", F.lit(0)))
    return rows.withColumn("passed", (F.col("recall_5") == 1) & (F.col("stale") == 0))
