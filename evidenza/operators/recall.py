"""Recall over memories: candidates of both lanes, authorized, resolved, ranked and limited, for a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenza.functions import text
from evidenza.operators import ranking, scope, search


def keyword_lane(memories: DataFrame, questions: DataFrame, k: int = 10, ceiling: str = "shared", paths: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best of the asking agent's memories by the words of content and tags.

    ``memories`` has (id, agent, visibility, source, type, source_id, content, tags) of the statuses asked for, ``questions``
    (query_id, owner, terms). Visibility and, for documents, the path are conditions before the ranking.
    """
    said = memories.withColumn("_said", F.concat_ws(" ", "content", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    seen = scope.visible(F.col("visibility"), F.lit(ceiling)) & scope.document_allowed(F.col("source"), F.col("type"), F.col("source_id"), paths)
    return search.bm25(said, "id", "_said", questions, k, seen, F.col("agent"))


def vector_lane(memories: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = 10, least: float = 0.3, ceiling: str = "shared") -> DataFrame:
    """(query_id, id, score, rank): the asking agent's memories that are most similar to a vector of the same model.

    ``vectors`` has (memory_id, model, embedding, dimensions), repeats count once; ``questions`` (query_id, agent, model, vec).
    """
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions"))).groupBy("memory_id", "model").agg(F.min("embedding").alias("embedding"))
    rows = usable.join(memories.where(scope.visible(F.col("visibility"), F.lit(ceiling))).select(F.col("id").alias("memory_id"), "agent"), "memory_id")
    return search.semantic(rows, "memory_id", "embedding", questions, k, least, ["model", "agent"])


def first_wins(lanes: list[DataFrame]) -> DataFrame:
    """(query_id, id, place): the lanes behind one another, each row where it comes first."""
    rows = None
    for i, lane in enumerate(lanes):
        part = lane.select("query_id", "id", F.struct(F.lit(i).alias("lane"), "rank").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.groupBy("query_id", "id").agg(F.min("at").alias("at"))
    return rows.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("place"))


def recalled(candidates: DataFrame, memories: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, quality, rank): candidates (query_id, id, score) with what is stored of them, each content once, by quality.

    Content and conditions come from the stored rows only, so unknown ids drop out. A question's candidates are few by
    their lanes' limits, so its windows are small.
    """
    rows = candidates.join(memories.select("id", "agent", "status", "content", "source", "trust", "confidence", "verified", "seen_count"), "id").where(F.col("content").isNotNull())
    rows = ranking.best_per_content(rows, ["query_id"], "content", [F.desc_nulls_last("confidence"), F.desc(F.round("score", 9)), "id"])
    rows = ranking.lane_normalized(rows.withColumn("score", F.round("score", 9)), ["query_id"]).withColumn("diversity", F.lit(1.0))
    rows = rows.withColumn("applicability", ranking.applicability(F.col("status"))).withColumn("signal", ranking.signal(F.col("trust"), F.col("confidence"), F.col("verified"), F.col("seen_count"), F.col("source")))
    return ranking.quality_ranked(rows, "query_id", "id", k).select("query_id", "id", "quality", "rank")


def unsaid(results: DataFrame, messages: DataFrame, content: str = "content") -> DataFrame:
    """Results whose content no message of the conversation says already, by their comparable form without outer punctuation."""
    plain = lambda c: text.content_key(F.btrim(c, F.lit(" .,!?;:")))
    return results.withColumn("_k", plain(F.col(content))).join(messages.select(plain(F.col("content")).alias("_k")), "_k", "left_anti").drop("_k")
