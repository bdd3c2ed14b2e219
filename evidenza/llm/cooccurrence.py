"""Items that appear together: stripes of co-occurring neighbours, merged by item, with log-likelihood significance."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a basket that are paired in one piece; larger baskets are cut into blocks whose pairs of blocks are spread.
BLOCK = 400
#: Neighbours a task holds before it lets its stripes go.
HELD = 400_000
_STRIPES = "a string, neighbours map<string,bigint>"


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (left, right) are two sorted item lists of a piece of a basket, right null where the piece is a whole basket."""
    held: defaultdict[str, Counter] = defaultdict(Counter)
    n = 0
    kind = pa.map_(pa.string(), pa.int64())

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([list(c.items()) for c in held.values()], kind)], names=["a", "neighbours"])

    for batch in batches:
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            if right is None:
                for i, a in enumerate(left):
                    if rest := left[i + 1 :]:
                        held[a].update(rest)
                n += len(left) * (len(left) - 1) // 2
            else:
                for a in left:
                    if after := [b for b in right if b > a]:
                        held[a].update(after)
                    for b in right:
                        if b < a:
                            held[b][a] += 1
                n += len(left) * len(right)
            if n > HELD:
                yield out()
                held.clear()
                n = 0
    if held:
        yield out()


def _xlogx(*counts: Column) -> Column:
    return sum((F.when(c > 0, c * F.log(c)).otherwise(0.0) for c in counts), F.lit(0.0))


def appearing_together(df: DataFrame, basket: str, item: str, block: int = BLOCK) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n, lift, llr) of every pair a < b of items that share a basket.

    Rows with a null basket or item are left out and a repeated (basket, item) counts once; n is the number of baskets.
    lift is n_ab * n / (n_a * n_b); llr is the log-likelihood ratio of the two-by-two table. A task folds its baskets
    into stripes (item to neighbours with counts) before anything is shuffled, and stripes of one item are merged by
    adding up their entries, so a hot item isn't gathered in one row. A basket of more than ``block`` items is cut into
    blocks whose pairs are spread over tasks. An empty table gives an empty result; items compare as strings.
    """
    rows = df.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    rows = rows.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item")).distinct()
    singles = rows.groupBy("item").agg(F.count("*").alias("n"))
    # number of blocks of a basket: one for all but the largest
    sizes = rows.groupBy("basket").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    large = sizes.where(F.col("k") > 1)
    placed = rows.join(large, "basket", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    placed = placed.withColumn("i", F.expr("int(pmod(xxhash64(item), k))"))
    placed = placed.select("basket", "item", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    piece = placed.select("basket", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "item", "i")
    piece = piece.groupBy("basket", "x", "y").agg(
        F.array_sort(F.collect_list(F.when(F.col("i") == F.col("x"), F.col("item")))).alias("left"),
        F.array_sort(F.collect_list(F.when(F.col("i") != F.col("x"), F.col("item")))).alias("right"),
    )
    piece = piece.select("left", F.when(F.col("x") != F.col("y"), F.col("right")).alias("right"))
    stripes = piece.where(F.size("left") > F.when(F.col("right").isNull(), 1).otherwise(0)).mapInArrow(_stripes, _STRIPES)
    pairs = stripes.select("a", F.explode("neighbours").alias("b", "n")).groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    total = rows.agg(F.countDistinct("basket").alias("n"))
    out = pairs.join(singles.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(singles.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    out = out.join(F.broadcast(total))  # one row
    k11, k12, k21 = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    k22 = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    llr = 2 * (_xlogx(k11, k12, k21, k22) + _xlogx(F.col("n")) - _xlogx(F.col("n_a"), F.col("n") - F.col("n_a")) - _xlogx(F.col("n_b"), F.col("n") - F.col("n_b")))
    return out.select("a", "b", "n_ab", "n_a", "n_b", "n", (k11 * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"), F.greatest(llr, F.lit(0.0)).alias("llr"))
