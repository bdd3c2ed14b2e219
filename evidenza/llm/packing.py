"""Filling containers of fixed capacity: large-item matching and best fit, worked out on the histogram of sizes.

Sizes are whole numbers up to the capacity, so a corpus of any length has a histogram of at most ``capacity`` entries. The
packing is found on that histogram: how many containers are filled with which sizes. Items of one size are
interchangeable, so an item then only needs its number among those of its size, and that number says its container.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenza.runtime import cut

CAPACITY = 2048


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((size, times), ...), containers)]: a packing of ``histogram[size]`` items of each size from 1 to capacity.

    Items above a third of the capacity go at most two to a container: from the largest down, each is matched with the
    largest that still fits beside it. Smaller items, from the largest down, go into the smallest gap that takes them,
    and into new containers if none does. All items of one size are placed by one step for each kind of container they
    meet, so the work depends on the number of sizes, not of items.
    """
    third = capacity / 3
    left = {s: n for s, n in histogram.items() if n > 0}
    gaps: defaultdict[int, defaultdict[tuple, int]] = defaultdict(lambda: defaultdict(int))  # gap -> content -> containers
    large = sorted(s for s in left if s > third)

    def mate(s: int) -> int | None:
        k = bisect.bisect_right(large, capacity - s) - 1
        return large[k] if k >= 0 else None

    while large:
        s = large[-1]
        m = mate(s)
        if m is None:
            gaps[capacity - s][((s, 1),)] += left[s]
            used = {s: left[s]}
        elif m == s and left[s] > 1:
            gaps[capacity - 2 * s][((s, 2),)] += left[s] // 2
            used = {s: left[s] - left[s] % 2}
        elif m == s:  # the last of its size
            lower = large[-2] if len(large) > 1 else None
            gaps[capacity - s - (lower or 0)][((s, 1), (lower, 1)) if lower else ((s, 1),)] += 1
            used = {s: 1, lower: 1} if lower else {s: 1}
        else:
            n = min(left[s], left[m])
            gaps[capacity - s - m][((s, 1), (m, 1))] += n
            used = {s: n, m: n}
        for x, n in used.items():
            left[x] -= n
            if not left[x]:
                del left[x]
                large.pop(bisect.bisect_left(large, x))
    open_gaps = sorted(gaps)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            k = bisect.bisect_left(open_gaps, s)
            if k == len(open_gaps):
                each = capacity // s
                full, rest = divmod(n, each)
                for times, count in ((each, full), (rest, 1)):
                    if times and count:
                        if not gaps[capacity - s * times]:
                            bisect.insort(open_gaps, capacity - s * times)
                        gaps[capacity - s * times][((s, times),)] += count
                break
            gap = open_gaps[k]
            content, count = next(iter(gaps[gap].items()))
            # the smallest gap takes as many of this size as go in, as it stays the smallest one that takes them
            each = gap // s
            take = min(count, n // each)
            if not take:
                each, take = n, 1
            rest = gap - each * s
            gaps[gap][content] -= take
            if not gaps[gap][content]:
                del gaps[gap][content]
                if not gaps[gap]:
                    open_gaps.pop(k)
            if not gaps[rest]:
                bisect.insort(open_gaps, rest)
            gaps[rest][(*content, (s, each))] += take
            n -= each * take
    return sorted((content, n) for by in gaps.values() for content, n in by.items() if n)


def numbered(rows: DataFrame, by: str, key: list[str]) -> DataFrame:
    """The rows with ``number``, from 0 within each value of ``by``, without gathering any value in one task.

    Rows are numbered inside (value, bucket of the key) and offset by the buckets before.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(1024)).cast("int"))
    sizes = rows.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inner = Window.partitionBy(by, "bucket").orderBy(*key)
    out = rows.withColumn("at", F.row_number().over(inner)).join(sizes, [by, "bucket"])
    return out.withColumn("number", F.col("skip") + F.col("at") - 1).drop("bucket", "skip", "at")


def containers(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part, start, size, container): every item, or each part of an item that alone exceeds the capacity.

    A larger item is divided into full containers (parts 0, 1, ...) and a rest; ``start`` is where a part begins. Items of
    size 0 or null take no room and are spread over the containers there are, by their key. Keys are taken as they are: repeated rows
    are items of their own, told apart by nothing but their number. An empty table gives an empty result.
    """
    rows = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))
    rows = rows.select("key", "n", F.explode(parts).alias("part")).withColumn("start", F.col("part") * F.lit(capacity).cast("long"))
    rows = cut(rows.select("key", "part", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("int").alias("size")))
    histogram = {r["size"]: r["c"] for r in rows.groupBy("size").agg(F.count("*").alias("c")).collect()}  # at most capacity + 1 rows
    zero = histogram.pop(0, 0)
    plan = patterns(histogram, capacity)
    # runs[size]: the items numbered from `first` on go `times` each into containers from `container` on; as many runs as kinds of containers
    spark, first, container, runs = items.sparkSession, defaultdict(int), 0, []
    for content, n in plan:
        for s, times in content:
            runs.append((s, first[s], times, container))
            first[s] += n * times
        container += n
    placed = numbered(rows.where(F.col("size") > 0), "size", ["key", "part"])
    by_size: defaultdict[int, list] = defaultdict(list)
    for s, f, t, c in runs:
        by_size[s].append((f, t, c))
    table = spark.createDataFrame([(s, [x[0] for x in r], [x[1] for x in r], [x[2] for x in r]) for s, r in by_size.items()], "size int, firsts array<bigint>, times array<int>, starts array<bigint>")
    placed = placed.join(F.broadcast(table), "size")  # a row a size, at most capacity rows
    # the last run that begins at or before the number, by halving
    at = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0).alias("lo"), F.size("firsts").alias("hi")),
        lambda s, _: F.when(s["hi"] - s["lo"] <= 1, s).otherwise(
            F.when(F.get("firsts", ((s["lo"] + s["hi"]) / 2).cast("int")) <= F.col("number"), F.struct(((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))),
        lambda s: s["lo"],
    )
    placed = placed.withColumn("run", at)
    found = F.get("starts", F.col("run")) + F.expr("(number - get(firsts, run)) div get(times, run)")
    out = placed.select("key", "part", "start", "size", found.alias("container"))
    if zero:
        free = rows.where(F.col("size") == 0)
        out = out.unionByName(free.select("key", "part", "start", "size", F.pmod(F.xxhash64("key"), F.lit(max(container, 1))).cast("bigint").alias("container")))
    return out.select(F.col("key").alias(key), "part", "start", "size", "container")
