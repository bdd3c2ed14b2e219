"""Near-duplicate records with small edits: ProbMinHash signatures, banding and verification.

A record is the set of its distinct pairs of adjacent words (weights may be given). Every element is a Poisson process
of its own: its arrivals each hit one of the ``m`` registers, and a register keeps the element that came first. Arrivals
of an element only grow later, so it is dropped as soon as its next one is later than everything the registers hold.
Two registers agree with the probability Jaccard similarity of the records. Equal bands of registers make candidates,
and each candidate is verified on the element sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenza.runtime import broadcast_if_small, cut

#: Bands and registers a band for similarity of 0.5 and more: a pair of exactly 0.5 becomes a candidate with 0.985.
BANDS, ROWS = 132, 5
#: Records of one band that a task pairs with one another; a larger band is split over tasks, every pair still meeting once.
#: Which bands are large is estimated from one record of so many, as it only decides who does the work.
SPLIT, ESTIMATE = 1000, 64
_WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def shingles(tokens: Column, size: int) -> Column:
    """Sorted distinct hashes of the runs of ``size`` adjacent words; fewer words give none."""

    def runs(t: Column) -> Column:
        starts = F.when(F.size(t) >= size, F.sequence(F.lit(1), F.size(t) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(t, i, size), " ")))))

    # named once, else the words would be found anew for each run
    return F.element_at(F.transform(F.array(tokens), runs), 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sizes: np.ndarray, elements: np.ndarray, weights: np.ndarray | None, m: int) -> np.ndarray:
    """ProbMinHash signatures (n, m) of n records whose elements stand behind one another."""
    n = len(sizes)
    doc, item = np.repeat(np.arange(n), sizes), elements.astype(np.uint64)
    rate = np.ones(len(item)) if weights is None else weights.astype(np.float64)
    live = rate > 0
    doc, item, rate = doc[live], item[live], rate[live]
    time, first = np.zeros(len(item)), np.full(n * m, np.inf)
    sig = np.zeros(n * m, np.uint64)
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(item):
            step += np.uint64(1)
            h = _mix(item + step * np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log1p(-(h >> np.uint64(11)).astype(np.float64) / 9007199254740992.0) / rate
            at = doc * m + (_mix(h) % np.uint64(m)).astype(np.int64)
            better = time < first[at]
            order = np.lexsort((item[better], -time[better]))  # of equal registers the earliest arrival is written last
            to, by = at[better][order], np.flatnonzero(better)[order]
            first[to], sig[to] = time[by], item[by]
            limit = first.reshape(n, m).max(1)
            keep = time < limit[doc]
            doc, item, rate, time = doc[keep], item[keep], rate[keep], time[keep]
    return sig.reshape(n, m)


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                col = part.column("elements")
                sizes = np.diff(np.asarray(col.offsets))
                flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
                sig = signatures(sizes, flat, None, bands * rows).reshape(len(sizes), bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sizes), bands)).copy()
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.ListArray.from_arrays(np.arange(0, len(sizes) * bands + 1, bands, dtype=np.int32), pa.array(key.ravel().view(np.int64)))], names=["rep", "keys"])

    return run


def near_records(df: DataFrame, key: str, text: str, size: int = 2, least: float = 0.5, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs (a, b, sim) of representatives of different element sets, and (id, rep) of every record.

    Records with null or no element (null, empty and one-word texts) are in no group and left out of both. Rows under
    one key count once (of different texts of one key the least). Records with equal element sets share the smallest
    key as representative; they are never paired with one another one by one. Ids are compared as strings. Extra
    columns are ignored; an empty table gives empty results.
    """
    texts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(F.min(text).alias("text"))
    sets = texts.select("id", shingles(words(F.col("text")), size).alias("elements")).where(F.size("elements") > 0)
    sets = sets.select("id", "elements", F.xxhash64("elements").alias("h1"), F.hash("elements").alias("h2"))
    reps = cut(sets.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("elements").alias("elements")).withColumn("n", F.monotonically_increasing_id()))
    members = sets.select("id", "h1", "h2").join(reps.select("h1", "h2", "rep").hint("merge"), ["h1", "h2"]).select("id", "rep")

    # what joins grows with the data, and the planner can't see how many bands a record has: never broadcast
    signed = cut(reps.select(F.col("n").alias("rep"), "elements").mapInArrow(_bands(bands, rows), "rep bigint, keys array<bigint>"))
    pairs = _met(signed)
    one = reps.select(F.col("n").alias("a"), F.col("rep").alias("ra"), F.col("elements").alias("ea")).hint("merge")
    two = reps.select(F.col("n").alias("b"), F.col("rep").alias("rb"), F.col("elements").alias("eb")).hint("merge")
    both = pairs.join(one, "a").join(two, "b")
    both = both.withColumn("shared", F.size(F.array_intersect("ea", "eb")))
    both = both.withColumn("sim", F.col("shared") / (F.size("ea") + F.size("eb") - F.col("shared")))
    links = both.where(F.col("sim") >= least).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "sim")
    return links, members


def _met(signed: DataFrame, split: int | None = None, estimate: int | None = None) -> DataFrame:
    """(a, b) with a < b: records (rep, keys) that share a key.

    A key of more than about ``split`` records is dealt to several tasks: each record stands in one part as the first of
    a pair, and in every part as the second.
    """
    split, estimate = split or SPLIT, estimate or ESTIMATE
    exploded = lambda df: df.select("rep", F.explode("keys").alias("band"))
    some = exploded(signed.where(F.pmod(F.xxhash64("rep"), F.lit(estimate)) == 0)).groupBy("band").agg(F.count("*").alias("n"))
    large = cut(some.where(F.col("n") * estimate > split).select("band", F.ceil(F.col("n") * estimate / split).cast("int").alias("parts")))
    bands = exploded(signed)
    rest = bands
    if not large.isEmpty():
        large = broadcast_if_small(large)
        rest = bands.join(large, "band", "left_anti")
    side = lambda c: rest.select("band", F.col("rep").alias(c))
    met = side("a").join(side("b").hint("merge"), "band").select("a", "b")
    if rest is not bands:
        hot = bands.join(large, "band")
        first = hot.select("band", F.pmod(F.xxhash64("rep", F.lit(1)), "parts").cast("int").alias("part"), F.col("rep").alias("a"))
        second = hot.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("b"))
        met = met.unionByName(first.join(second.hint("merge"), ["band", "part"]).select("a", "b"))
    return met.where("a < b").distinct()


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) with a < b of records, from links of representatives and membership; for results that are defined as pairs of records."""
    m = members
    same = m.alias("x").join(m.alias("y").hint("merge"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    across = links.join(m.select(F.col("rep").alias("a"), F.col("id").alias("ia")).hint("merge"), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("ib")).hint("merge"), "b")
    return same.unionByName(across.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))).distinct()
