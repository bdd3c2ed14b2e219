"""Outcome feedback: utilities from decayed signals, rank adjustment, receipts, jobs and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def utilities(signals: DataFrame, key: list[str], now: Column, half_life_days: float = 90.0) -> DataFrame:
    """Decayed masses by sign and kind of each key, with mean, confidence and harm; sums are taken before the shuffle."""
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 86_400_000_000.0
    w = F.col("weight") * F.pow(F.lit(0.5), age / half_life_days)
    plus, minus = F.col("direction") > 0, F.col("direction") < 0
    mass = signals.groupBy(*key).agg(*[F.sum(F.when(c, w).otherwise(0.0)).alias(n) for n, c in (("pos", plus), ("neg", minus), ("explicit", F.col("explicit")), ("inferred", ~F.col("explicit")))], F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    obs = F.col("pos") + F.col("neg")
    return mass.withColumns({"mean": (2 + F.col("pos")) / (4 + obs), "confidence": 1 - F.exp(-obs / 10), "harm": F.when(obs > 0, F.col("neg") / obs).otherwise(0.0)})


def adjusted(results: DataFrame, utility: DataFrame, key: str, most: float = 0.15, least: float = 3.0, influence: float = 1.0) -> DataFrame:
    """Scores moved by at most ``most`` for rows with enough observations; influence 0 leaves them as they are."""
    rows = results.join(utility.select(key, "pos", "neg", "mean", "confidence"), key, "left")
    move = most * F.col("confidence") * 2 * (F.col("mean") - 0.5)
    move = F.when(F.col("pos") + F.col("neg") >= least, F.greatest(F.lit(-most), F.least(F.lit(most), move))).otherwise(0.0) * influence
    return rows.withColumn("adjusted", F.col("score") + F.coalesce(move, F.lit(0.0))).select(*results.columns, "adjusted")


def mixed(signals: DataFrame, key: str, archetype: str, now: Column, share: float = 0.25) -> DataFrame:
    """(key, archetype, pos, neg, mean, confidence): utilities of each kind of question, with a share of those over all kinds."""
    own = utilities(signals, [key, archetype], now).select(key, archetype, "pos", "neg")
    all_ = utilities(signals, [key], now).select(key, F.col("pos").alias("_p"), F.col("neg").alias("_n"))
    rows = own.join(all_, key).select(key, archetype, (F.col("pos") + share * F.col("_p")).alias("pos"), (F.col("neg") + share * F.col("_n")).alias("neg"))
    obs = F.col("pos") + F.col("neg")
    return rows.withColumns({"mean": (2 + F.col("pos")) / (4 + obs), "confidence": 1 - F.exp(-obs / 10)})


def synergies(signals: DataFrame, group: list[str], item: str) -> DataFrame:
    """Pairs of items next to one another in each group's order, with their synergy and its confidence."""
    w = Window.partitionBy(*group).orderBy("created_at", "id")
    pair = signals.withColumn("next", F.lead(item).over(w)).where(F.col("next").isNotNull() & (F.col("next") != F.col(item)))
    pair = pair.groupBy(F.least(item, "next").alias("a"), F.greatest(item, "next").alias("b")).agg(F.sum(F.when(F.col("direction") > 0, F.col("weight")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("direction") < 0, F.col("weight")).otherwise(0.0)).alias("neg"))
    total = F.col("pos") + F.col("neg")
    return pair.withColumns({"synergy": (F.col("pos") - F.col("neg")) / F.greatest(F.lit(1.0), total), "confidence": 1 - F.exp(-total / 6)})


def closed_receipts(opened: DataFrame, closing: DataFrame, key: str, seconds: int = 300) -> DataFrame:
    """(closing_id, opened_id): for each closing event the newest opening of its key at most so many seconds before.

    Opening and closing are bucketed by the horizon, so the join is by key and bucket and a busy key is spread over time.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    o = opened.select(F.col(key), F.col("id").alias("opened_id"), F.col("at").alias("opened_at"), F.explode(F.array(bucket(F.col("at")), bucket(F.col("at")) + 1)).alias("b"))
    c = closing.select(F.col(key), F.col("id").alias("closing_id"), F.col("at").alias("closed_at"), bucket(F.col("at")).alias("b"))
    gap = F.unix_micros("closed_at") - F.unix_micros("opened_at")
    pairs = c.join(o, [key, "b"]).where((gap >= 0) & (gap <= seconds * 1_000_000))
    return pairs.groupBy("closing_id").agg(F.max_by("opened_id", F.struct("opened_at", "opened_id")).alias("opened_id"))


def kept_newest(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """Retention: the n newest rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def job_states(log: DataFrame, key: str, retries: int = 3, now: Column | None = None, lease: int = 900) -> DataFrame:
    """State of each job from its log (key, at, seq, event: enqueued, claimed, done, failed).

    A failed job waits min(300, 2 ** (failures - 1)) seconds for its next try and is a dead letter after ``retries``
    failures; a job claimed longer than the lease before ``now`` is stale.
    """
    s = log.groupBy(key).agg(F.max_by("event", F.struct("at", "seq")).alias("last"), F.max("at").alias("last_at"), F.count_if(F.col("event") == "failed").alias("failures"))
    state = F.when(F.col("last") == "done", "ready").when((F.col("last") == "failed") & (F.col("failures") >= retries), "dead_letter").when(F.col("last") == "failed", "retry_wait").when(F.col("last") == "claimed", "running").otherwise("pending")
    if now is not None:
        state = F.when((state == "running") & (F.unix_micros(now) - F.unix_micros("last_at") > lease * 1_000_000), "stale").otherwise(state)
    wait = F.when(state == "retry_wait", F.least(F.lit(300.0), F.pow(F.lit(2.0), F.col("failures") - 1)))
    return s.select(key, state.alias("state"), "failures", wait.alias("wait_s"))
