"""Most similar vectors for every vector: a forest of sorted hash strings.

Each tree writes a vector as a string of ``BITS`` random-hyperplane signs and its place along one more random direction,
which sets vectors apart that are too close for the signs, and keeps the strings as one sorted array. The
strings that share the longest prefix with a given one stand directly around it, and those of every shorter prefix in a
stretch around these. So a vector descends to its own place in each tree, and ascends in all trees at once, a sign of the
prefix at a time, until all its stretches together hold ``wanted`` candidates. Those are compared by cosine.

The places, the lengths of the stretches and the level of each vector come from the strings alone. The vectors are
then sent to blocks of equal numbers of places, with ``REACH`` places of the next blocks on either side, so results depend
neither on partitions nor on their borders, and a dense cluster is simply a longer part of the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenza.runtime import cut

BITS = 64
TREES = 14
#: Candidates that the stretches of all trees together shall hold, and the levels (lengths of the prefix) they are counted at.
WANTED, LEVELS = 10_000, 48
#: Places of a block, the longest stretch on either side of a place, and rows compared at once.
PLACES, REACH, ROWS = 4096, 768, 256
SEED = 20240229
_STRINGS = "grp string, dim int, tree int, code binary, rep string"
_COUNTED = "grp string, dim int, tree int, code binary, rep string, mid bigint, counts array<smallint>"
_HITS = "grp string, a string, b string, sim double"


def usable(df: DataFrame, key: str, vector: str, group: str, dims: str) -> DataFrame:
    """(grp, id, vec): one usable vector of each key and group.

    Usable is a vector that is not null, has exactly ``dims`` elements, all of them finite, and isn't all zero; rows
    with a null key, group or ``dims`` are left out. Repeats count once; of several different vectors of one key and
    group the least (element by element) counts.
    """
    v = F.col(vector)
    fine = v.isNotNull() & F.col(key).isNotNull() & F.col(group).isNotNull() & (F.size(v) == F.col(dims)) & (F.size(v) > 0)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.where(fine).where(F.forall(v, number) & F.exists(v, lambda x: x != 0))
    return rows.groupBy(F.col(group).alias("grp"), F.col(key).cast("string").alias("id")).agg(F.min(v).alias("vec"))


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * (BITS + 1))).astype(np.float32)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers as four bytes each that sort as they do."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(">u4")


def _strings(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vec = batch.column("vec")
            sizes = np.diff(np.asarray(vec.offsets))
            flat = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[(starts[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                if dim not in planes:
                    planes[dim] = _planes(int(dim), trees)
                unit = (x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]).astype(np.float32)
                along = unit @ planes[dim]
                codes = np.empty((len(at), trees, BITS // 8 + 4), np.uint8)
                codes[:, :, : BITS // 8] = np.packbits(along[:, : trees * BITS] > 0, axis=1).reshape(len(at), trees, BITS // 8)
                codes[:, :, BITS // 8 :] = _ordered(along[:, trees * BITS :]).view(np.uint8).reshape(len(at), trees, 4)
                rows = batch.take(pa.array(at))
                for t in range(trees):
                    code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8 + 4), len(at), [None, pa.py_buffer(np.ascontiguousarray(codes[:, t]).tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([rows.column("grp"), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), t, np.int32)), code, rows.column("rep")], names=["grp", "dim", "tree", "code", "rep"])

    return run


def _numbers(codes: pa.Array) -> np.ndarray:
    """The signs of strings as whole numbers in the same order."""
    return np.frombuffer(b"".join([c[: BITS // 8] for c in codes.to_pylist()]), ">u8").astype(np.uint64)


def _segments(*columns: np.ndarray) -> list[tuple[int, int]]:
    n = len(columns[0])
    new = np.zeros(n - 1, bool) if n else np.zeros(0, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1), n]
    return list(zip(cuts, cuts[1:]))


def _stretches(codes: np.ndarray, first: int, end: int) -> np.ndarray:
    """(rows first..end, levels): how many others share so many signs with each row of a sorted array, within reach."""
    at = np.arange(len(codes))
    out = np.empty((end - first, LEVELS), np.int16)
    for level in range(1, LEVELS + 1):
        new = np.flatnonzero(np.diff(codes >> np.uint64(BITS - level))) + 1
        lo, hi = np.concatenate([[0], new]), np.concatenate([new, [len(codes)]])
        run = np.searchsorted(new, at[first:end], side="right")
        out[:, level - 1] = np.minimum(at[first:end] - lo[run], REACH) + np.minimum(hi[run] - 1 - at[first:end], REACH)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row of the sorted arrays how many others share its prefix, by level; a task holds a few batches."""
    held, done = None, 0  # rows not yet let go, and how many of them are counted

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, done
        end = held.num_rows if last else held.num_rows - REACH
        if end <= done:
            return
        codes = _numbers(held.column("code"))
        counts = np.zeros((held.num_rows, LEVELS), np.int16)
        for lo, hi in _segments(*(held.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "dim", "tree"))):
            a, b = max(lo, done), min(hi, end)
            if a < b:
                counts[a:b] = _stretches(codes[lo:hi], a - lo, b - lo)
        part = held.slice(done, end - done)
        lists = pa.ListArray.from_arrays(np.arange(0, part.num_rows * LEVELS + 1, LEVELS, dtype=np.int32), pa.array(counts[done:end].ravel()))
        yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "counts"])
        drop = max(0, end - REACH)
        held, done = held.slice(drop), end - drop

    for batch in batches:
        if batch.num_rows:
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.num_rows >= done + 4 * REACH:
                yield from out(False)
    if held is not None:
        yield from out(True)


def _compare(k: int, least: float):
    def best(own: np.ndarray, codes: np.ndarray, level: np.ndarray, place: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hits of the rows ``own`` of one sorted array."""
        unit = x.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        small = unit.astype(np.float32)
        for at in range(0, len(own), ROWS):
            q = own[at : at + ROWS]
            shift = (BITS - level[q]).astype(np.uint64)
            low = np.where(level[q] > 0, codes[q] >> np.minimum(shift, np.uint64(BITS - 1)) << np.minimum(shift, np.uint64(BITS - 1)), np.uint64(0))
            high = np.where(level[q] > 0, low | ((np.uint64(1) << np.minimum(shift, np.uint64(BITS - 1))) - np.uint64(1)), np.uint64(2**64 - 1))
            lo = np.maximum(np.searchsorted(codes, low, side="left"), np.searchsorted(place, place[q] - REACH, side="left"))
            hi = np.minimum(np.searchsorted(codes, high, side="right"), np.searchsorted(place, place[q] + REACH, side="right"))
            a, b = lo.min(), hi.max()
            sims = small[q] @ small[a:b].T
            col = np.arange(a, b)
            sims[(col < lo[:, None]) | (col >= hi[:, None]) | (col == q[:, None])] = -2
            near = sims >= least - 1e-4
            count = near.sum(1)
            parts = []
            many = np.flatnonzero(count > k + 4)
            if len(many):
                top = np.argpartition(sims[many], -(k + 4), axis=1)[:, -(k + 4) :]
                parts.append((np.repeat(many, k + 4), top.ravel()))
            few = np.flatnonzero((count > 0) & (count <= k + 4))
            if len(few):
                r, c = np.nonzero(near[few])
                parts.append((few[r], c))
            if parts:
                r, c = q[np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]) + a
                exact = np.einsum("ij,ij->i", unit[r], unit[c])
                keep = exact >= least
                yield r[keep], c[keep], exact[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            col = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "dim", "tree", "place", "level", "own", "rep")}
            codes, vec = _numbers(rows.column("code")), rows.column("vec")
            flat, offsets = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), np.float32), np.asarray(vec.offsets) - vec.offsets[0].as_py()
            for lo, hi in _segments(col["grp"], col["dim"], col["tree"]):
                own = np.flatnonzero(col["own"][lo:hi])
                if len(own):
                    x = flat[offsets[lo] : offsets[hi]].reshape(hi - lo, -1)
                    for a, b, sim in best(own, codes[lo:hi], col["level"][lo:hi].astype(np.int64), col["place"][lo:hi], x):
                        yield pa.RecordBatch.from_arrays([pa.array([col["grp"][lo]] * len(a), pa.string()), pa.array(col["rep"][lo:hi][a], pa.string()), pa.array(col["rep"][lo:hi][b], pa.string()), pa.array(sim)], names=["grp", "a", "b", "sim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            blocks = held.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1)]
            for lo, hi in zip(cuts, cuts[1:]):
                yield from out(held.slice(lo, hi - lo))
            held = held.slice(cuts[-1])
        if held is not None:
            yield from out(held)

    return run


def _placed(reps: DataFrame, trees: int, wanted: int) -> DataFrame:
    """(grp, rep, dim, level, trees: tree, place, code): where a vector stands in each sorted array, and the level to which it ascends."""
    spark = reps.sparkSession
    keys = ["grp", "dim", "tree", "code", "rep"]
    rows = reps.select("grp", "rep", "vec").mapInArrow(_strings(trees), _STRINGS)
    rows = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id()))
    # the places before each range: one number a partition
    sizes = {r["part"]: r["n"] for r in rows.groupBy(F.shiftright("mid", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    skips, total = [], 0
    for part in sorted(sizes):
        skips.append((part, total))
        total += sizes[part]
    skips = spark.createDataFrame(skips, "part bigint, skip bigint")
    rows = rows.mapInArrow(_counts, _COUNTED).join(F.broadcast(skips), F.shiftright("mid", 33) == F.col("part"))
    place = F.col("skip") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    each = rows.groupBy("grp", "rep").agg(F.first("dim").alias("dim"), F.collect_list(F.struct("tree", place.alias("place"), "code", "counts")).alias("trees"))  # one of each tree
    none = F.array_repeat(F.lit(0), LEVELS)
    counts = F.aggregate("trees", none, lambda s, t: F.zip_with(s, t["counts"], lambda x, y: x + y.cast("int")))
    level = F.size(F.filter(counts, lambda n: n >= wanted))
    return each.select("grp", "rep", "dim", level.alias("level"), F.transform("trees", lambda t: F.struct(t["tree"].alias("tree"), t["place"].alias("place"), t["code"].alias("code"))).alias("trees"))


def similar_vectors(df: DataFrame, key: str = "memory_id", vector: str = "embedding", group: str = "model", dims: str = "dimensions", k: int = 8, least: float = 0.8, trees: int = TREES, wanted: int = WANTED) -> DataFrame:
    """(grp, id, other, sim): for each usable vector the up to k most similar of its group with at least that similarity.

    Ties go to the smaller id. Exact copies of a vector are compared once and share the result: of each set of copies
    the k + 1 smallest ids stand for the whole set as neighbours, and every member gets its own list, so a set holding a third
    of all rows costs one comparison and never a list of all its pairs. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    rows = usable(df, key, vector, group, dims)
    rows = rows.select("grp", "id", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    reps = rows.groupBy("grp", "h1", "h2").agg(F.min("id").alias("rep"), F.min("vec").alias("vec"), F.count("*").alias("n"))
    placed = _placed(reps, trees, wanted).join(reps.select("grp", "rep", "vec"), ["grp", "rep"])
    placed = placed.select("grp", "rep", "dim", "level", "vec", F.explode("trees").alias("t")).select("grp", "rep", "dim", "level", "vec", "t.tree", "t.place", "t.code")
    home, inside = F.floor(F.col("place") / PLACES).cast("bigint"), F.pmod("place", F.lit(PLACES))
    blocks = F.array_compact(F.array(home, F.when((inside < REACH) & (home > 0), home - 1), F.when(inside >= PLACES - REACH, home + 1)))
    blocks = placed.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == home)
    hits = blocks.repartition("block").sortWithinPartitions("block", "place").mapInArrow(_compare(k, least), _HITS)
    hits = hits.groupBy("grp", "a", "b").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("grp", "a").orderBy(F.desc("sim"), "b")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

    members = rows.select("grp", "h1", "h2", "id")
    copies = Window.partitionBy("grp", "h1", "h2").orderBy("id")
    first = members.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    first = first.groupBy("grp", "h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    first = first.select("grp", "h1", "h2", "ids", F.element_at("ids", 1).alias("rep"))
    own = first.where(F.size("ids") > 1).select("grp", F.col("rep").alias("a"), F.lit(1.0).alias("sim"), "ids")
    hits = hits.join(first.select("grp", F.col("rep").alias("b"), "ids"), ["grp", "b"]).select("grp", "a", "sim", "ids").unionByName(own)
    # at most k sets of at most k + 1 ids, and the own set: bounded
    lists = hits.groupBy("grp", "a").agg(F.collect_list(F.struct("sim", "ids")).alias("sets"))
    each = F.flatten(F.transform("sets", lambda s: F.transform(s["ids"], lambda i: F.struct((-s["sim"]).alias("far"), i.alias("other")))))
    lists = lists.select("grp", F.col("a").alias("rep"), F.slice(F.array_sort(each), 1, 2 * k + 2).alias("list"))
    keyed = lists.join(first.select("grp", "rep", "h1", "h2"), ["grp", "rep"]).select("grp", "h1", "h2", "list")
    mine = members.join(keyed, ["grp", "h1", "h2"])
    mine = mine.select("grp", "id", F.explode(F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)).alias("x"))
    return mine.select("grp", "id", F.col("x.other").alias("other"), (-F.col("x.far")).alias("sim"))
