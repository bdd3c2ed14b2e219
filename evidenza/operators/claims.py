"""Versioned claims: supersession, validity, conflicts and reconciliation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenza.functions import text


def versions(df: DataFrame, key: list[str], at: str, ident: str, value: str) -> DataFrame:
    """Each claim with the time it holds until (the next one's), whether its value differs from the one before, and its number."""
    w = Window.partitionBy(*key).orderBy(at, ident)
    before = F.lag(value).over(w)
    return df.withColumns({"valid_to": F.lead(at).over(w), "changed": F.coalesce(before != F.col(value), F.lit(True)), "version": F.row_number().over(w)})


def valid_at(start: Column, event: Column, end: Column, t: Column) -> Column:
    """start (or the event time) <= t < end; missing bounds don't bind."""
    s = F.coalesce(start, event)
    return F.coalesce(s <= t, F.lit(True)) & F.coalesce(end > t, F.lit(True))


def latest_active(df: DataFrame, key: list[str], at: str, ident: str) -> DataFrame:
    """The newest claim of each key; aggregated before the shuffle, so a hot key is no large group."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*key).agg(F.max_by(row, F.struct(at, ident)).alias("_row")).select("_row.*")


def conflict_class(same_object: Column, correction: Column, transition: Column, conditional: Column, competitor: Column) -> Column:
    """update, compatible, duplicate, conditional or unresolved, by the first rule that holds."""
    return F.when(correction & ~same_object, "update").when(~competitor, "compatible").when(same_object & conditional, "conditional").when(same_object, "duplicate").when(transition, "update").when(conditional, "conditional").otherwise("unresolved")


def supersedes(kind: Column, confidence: Column, active_verified: Column, correction: Column, verified: Column, trust: Column, seen: Column) -> Column:
    """An update supersedes with confidence of 0.75 if the active claim isn't verified, or it is a correction, or well corroborated."""
    corroborated = verified & (trust >= 0.85) & (seen >= 2)
    return (kind == "update") & (confidence >= 0.75) & (~active_verified | correction | corroborated)


def reconciled(df: DataFrame, key: list[str]) -> DataFrame:
    """Sequential reconciliation: each claim of a key meets the active one that the earlier claims left.

    Columns: key, id, object, observed_at, confidence, verified. Gives (id, decision, active_id): decision is first,
    duplicate, update or unresolved. Claims of one key form a sequence by nature; they are folded in one pass over the
    sorted rows of a partition with the state of one key held, so no key's claims are gathered.
    """
    columns = [*key, "observed_at", "id", "object", "confidence", "verified"]
    kinds = dict(df.dtypes)

    def run(batches):
        at, active, active_object, active_verified = None, None, None, False
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = tuple(row[: len(key)])
                ident, obj, confidence, verified = row[len(key) + 1 :]
                if k != at:
                    at, active, decision = k, None, "first"
                elif obj == active_object:
                    decision = "duplicate"
                elif confidence >= 0.75 and (not active_verified or verified):
                    decision = "update"
                else:
                    decision = "unresolved"
                if active is None or decision == "update":
                    active, active_object, active_verified = ident, obj, bool(verified)
                out.append((ident, decision, active))
            yield pd.DataFrame(out, columns=["id", "decision", "active_id"])

    rows = df.select(*columns).repartition(*key).sortWithinPartitions(*key, "observed_at", "id")
    return rows.mapInPandas(run, f"id {kinds['id']}, decision string, active_id {kinds['id']}")


def projected(memories: DataFrame) -> DataFrame:
    """(claim_id, memory_id, agent, subject, predicate, object, sentence, confidence, observed_at): statements of memories as claims.

    A sentence whose first word is its subject and whose verb is one of a few known ones gives a claim; the subject
    "general" and all other sentences give none. Null and empty contents have none.
    """
    rows = memories.where(F.col("content").isNotNull()).select("id", "agent", "confidence", "created_at", F.posexplode(text.sentences(F.col("content"))).alias("pos", "sentence"))
    rows = rows.withColumn("subject", F.split("sentence", " ")[0]).withColumn("p", text.claim_parts(F.col("subject"), F.col("sentence")))
    rows = rows.where((F.col("p.predicate") != "states") & (F.col("p.object") != "") & (F.lower("subject") != "general"))
    return rows.select(F.concat_ws("#", "id", F.col("pos").cast("string")).alias("claim_id"), F.col("id").alias("memory_id"), "agent", "subject", "p.predicate", "p.object", "sentence", "confidence", F.col("created_at").alias("observed_at"))


def text_conflict(sentence: Column, before: Column, value: Column) -> Column:
    """What a statement is to the active one before it: compatible (none), update (it says so), duplicate (the same object) or unresolved."""
    same = text.claim_value(before) == text.claim_value(value)
    changed = sentence.rlike(text.whole(text.CORRECTIONS))
    moved = sentence.rlike(text.whole(r"switched|changed|updated|now prefer|no longer|instead of|from [^\n]+ to"))
    return F.when(before.isNull(), "compatible").when(changed & ~same, "update").when(same, "duplicate").when(moved, "update").otherwise("unresolved")
