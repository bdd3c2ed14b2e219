"""Ingest and upkeep of memories: contradictions, corroboration, edits, merges, idempotent stores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenza.functions import scoring, text
from evidenza.runtime import cut, numbered


def _kept_links(memories: DataFrame, links: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("memory_id").orderBy("entity_id")
    rows = links.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def contradictions(memories: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): memories of one agent that share any entity and whose statements contradict one another.

    Candidates meet by words, not by entities, so a hot entity makes no hot group, and exactly: but for negations, a
    contradiction misses at most one word of the smaller statement, or two beside an antonym, so one of its two or three
    rarest words is in the other. Only statements that may differ in negations or hold the two sides of
    an antonym meet at all, equal statements of an agent count once, and the entities are compared at the end.
    """
    linked = memories.join(links.select(F.col("memory_id").alias("id")), "id", "left_semi").select("id", "agent", text.said_words(F.col("content")).alias("t")).where((F.size("t") > 0) & F.col("agent").isNotNull())
    said = cut(linked.groupBy("agent", "t").agg(F.min("id").alias("s")))
    # what a statement shows, and what it must meet: no negation or some, and a side of an antonym
    negated = F.exists("t", lambda w: w.isin(*text.NEGATIONS))
    sides = [(x, y) for p in text.ANTONYMS for x, y in (p, p[::-1])]
    shows = F.array_compact(F.array(F.when(negated, "#some").otherwise("#none"), *[F.when(F.array_contains("t", x), x) for x in sorted({x for x, _ in sides})]))
    meets = F.array_compact(F.array(F.lit("#some"), F.when(negated, "#none"), *[F.when(F.array_contains("t", x), y) for x, y in sides]))
    plain = F.filter(F.array_distinct("t"), lambda w: ~w.isin(*text.NEGATIONS))
    words = said.select("s", "agent", F.size(plain).alias("n"), shows.alias("shows"), meets.alias("meets"), F.explode(plain).alias("w"))
    often = words.groupBy("agent", "w").agg(F.count("*").alias("often"))
    rare = words.join(often, ["agent", "w"]).withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("often", "w"))).where("r <= 3")
    x = rare.select("s", "agent", "n", "w", "r", F.explode(F.array_distinct("meets")).alias("way")).where((F.col("r") <= 2) | ~F.startswith("way", F.lit("#"))).select("agent", "w", "way", F.col("s").alias("x"), F.col("n").alias("nx"))
    y = words.select("agent", "w", F.explode("shows").alias("way"), F.col("s").alias("y"), F.col("n").alias("ny"))
    met = x.join(y, ["agent", "w", "way"]).where((F.col("nx") <= F.col("ny")) & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    of = lambda c: said.select(F.col("s").alias(c), F.col("t").alias(f"t{c}"))
    pairs = met.join(of("x"), "x").join(of("y"), "y").where(text.contradicts(F.col("tx"), F.col("ty"))).select("x", "y")
    of = lambda c, i: linked.join(said, ["agent", "t"]).select("id", F.col("s").alias(c)).join(links.select(F.col("memory_id").alias("id"), "entity_id"), "id").select(c, "entity_id", F.col("id").alias(i))
    both = pairs.join(of("x", "i"), "x").join(of("y", "j"), ["y", "entity_id"])
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def corroborated(memories: DataFrame, links: DataFrame, most: int = 5, step: float = 0.05, cap: float = 0.95) -> DataFrame:
    """(id, n_raises, boosted): each memory's trust once all have been stored in order of (created_at, id).

    A memory that is stored raises, once each, the earlier memories of its agent that share one of its first ``most`` entities,
    and itself once if there are any. Raises beyond those that lead from 0 to the cap change nothing, so of each entity only
    so many of the newest first-linked memories are looked at, and a hot entity makes no group of pairs.
    """
    enough = math.ceil(cap / step)
    at = F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(0)).alias("t"), F.col("id"))
    m = memories.select("id", "agent", at.alias("at"))
    named = lambda df: df.join(m.withColumnRenamed("id", "memory_id"), "memory_id")
    linked, firsts = named(links.select("memory_id", "entity_id").distinct()), named(_kept_links(memories, links, most))
    newest = firsts.withColumn("r", F.row_number().over(Window.partitionBy("agent", "entity_id").orderBy(F.desc("at")))).where(F.col("r") <= enough)
    later = linked.join(newest.select("agent", "entity_id", F.col("at").alias("by_at"), F.col("memory_id").alias("by")), ["agent", "entity_id"]).where(F.col("by_at") > F.col("at"))
    later = later.groupBy(F.col("memory_id").alias("id")).agg(F.least(F.countDistinct("by"), F.lit(enough)).alias("later"))
    oldest = linked.groupBy("agent", "entity_id").agg(F.min("at").alias("oldest"))
    own = firsts.join(oldest, ["agent", "entity_id"]).groupBy(F.col("memory_id").alias("id")).agg(F.max(F.col("oldest") < F.col("at")).cast("int").alias("own"))
    rows = memories.select("id", scoring.or_half(F.col("trust")).alias("t")).join(later, "id", "left").join(own, "id", "left")
    k = F.least(F.coalesce("later", F.lit(0)) + F.coalesce("own", F.lit(0)), F.lit(enough)).cast("bigint")
    return rows.select("id", k.alias("n_raises"), F.when(k > 0, F.least(F.lit(cap), F.col("t") + step * k)).otherwise(F.col("t")).alias("boosted"))


def new_only(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-ignore: incoming rows whose key isn't stored, each key once."""
    return incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def upserted(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace: of each key the row that is latest by ``order``, incoming before stored when equal."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(c) for c in stored.columns])
    return rows.groupBy(*key).agg(F.max_by(row, F.struct(*order, "_new")).alias("_row")).select("_row.*")


def ledger_conflicts(operations: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Keys of the idempotency ledger that came with more than one payload."""
    return operations.groupBy(*key).agg(F.countDistinct(payload).alias("n_payloads")).where("n_payloads > 1")


def merged(rows: DataFrame, group: str, key: str, content: str, tags: str, order: str) -> DataFrame:
    """One new record a group: distinct contents joined in order, tags in order of appearance, ids replaced and their number.

    Contents and tags are reduced to their first appearance before they are gathered, so copies in a large group cost
    nothing; ``n`` needs no list, and ``replaced`` is gathered only where it is asked for.
    """
    at = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    rows = rows.select(F.col(group).alias("g"), at.alias("at"), F.col(content).alias("c"), F.col(tags).alias("t"))
    firsts = lambda df, by: df.groupBy("g", "v").agg(F.min(by).alias("at")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("l"))
    contents = firsts(rows.where(F.col("c").isNotNull()).select("g", "at", F.col("c").alias("v")), "at").alias("c")
    labels = firsts(rows.select("g", "at", F.posexplode("t").alias("p", "v")), F.struct("at", "p")).alias("t")
    all_ = rows.groupBy("g").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("at")), lambda e: e["k"]).alias("replaced")).alias("a")
    out = all_.join(contents, F.col("a.g").eqNullSafe(F.col("c.g")), "left").join(labels, F.col("a.g").eqNullSafe(F.col("t.g")), "left")
    return out.select(F.col("a.g").alias(group), F.coalesce(F.array_join("c.l", " | "), F.lit("")).alias("content"), F.coalesce("t.l", F.array().cast("array<string>")).alias("tags"), "replaced", "n")


def _steps(rows: DataFrame, chunk: int) -> DataFrame:
    """(id, k, d, lo, hi): runs of ``chunk`` steps of one record (id, k, d, lo, hi), in order, as one step.

    A step takes x to min(hi, max(lo, x + d)); what several of them do in a row is again such a step.
    """
    start = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    clamp = lambda x, e: F.least(e["hi"], F.greatest(e["lo"], x + e["d"]))
    both = lambda s, e: F.struct((s["d"] + e["d"]).alias("d"), clamp(s["lo"], e).alias("lo"), clamp(s["hi"], e).alias("hi"))
    lists = rows.groupBy("id", F.floor((F.col("k") - 1) / chunk).alias("at")).agg(F.array_sort(F.collect_list(F.struct("k", "d", "lo", "hi"))).alias("l"))
    return lists.select("id", (F.col("at") + 1).alias("k"), F.aggregate("l", start, both).alias("s")).select("id", "k", "s.*")


def edited(memories: DataFrame, edits: DataFrame, chunk: int = 1000) -> DataFrame:
    """(id, status, visibility, trust) after edit events (id, at, seq, action, amount): forget, restore, share, unshare, feedback.

    Feedback adds and clamps to 0..1 step by step, in the order of the events. Steps are put together by ``chunk``, and those
    again, so of a record that most events are of, no task holds more than a millionth. The last of forget and
    restore, and of share and unshare, decide the rest. Events without an id are left out.
    """
    last = lambda a, b: F.max_by(F.when(F.col("action").isin(a, b), F.col("action")), F.when(F.col("action").isin(a, b), F.struct("at", "seq")))
    per = edits.groupBy("id").agg(last("forget", "restore").alias("state"), last("share", "unshare").alias("seen"))
    steps = numbered(edits.where("action = 'feedback' AND id IS NOT NULL AND amount IS NOT NULL").select("id", "at", "seq", F.col("amount").cast("double").alias("d"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), ["id"], ["at", "seq"], "k").drop("at", "seq")
    once = _steps(_steps(_steps(steps, chunk), chunk), 2**31 - 1).drop("k")
    rows = memories.select("id", "status", "visibility", F.coalesce("trust", F.lit(0.5)).alias("trust")).join(per, "id", "left").join(once, "id", "left")
    trust = F.when(F.col("d").isNull(), F.col("trust")).otherwise(F.least(F.col("hi"), F.greatest(F.col("lo"), F.col("trust") + F.col("d"))))
    return rows.select("id", F.when(F.col("state") == "forget", "forgotten").when(F.col("state") == "restore", "active").otherwise(F.col("status")).alias("status"), F.when(F.col("seen") == "share", "shared").when(F.col("seen") == "unshare", "private").otherwise(F.col("visibility")).alias("visibility"), trust.alias("trust"))
