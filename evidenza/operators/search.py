"""Keyword, vector and hybrid search of a batch of queries over a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenza.functions import scoring, text
from evidenza.runtime import cut, opened, packed_cut, shut

K1, B, RRF_K = 1.2, 0.75, 60
#: Vectors of a block, and bytes of queries up to which their blocks are broadcast.
BLOCK, BROADCAST_BYTES = 256, 64 << 20
#: Of keyword search: words of a block of documents, pairs of a set and a document looked at together, parts of the corpus, rows a part holds before it gives them away, and how near scores may be equal at nine decimals.
BLOCK_WORDS, PAIRS, PARTS, HELD, NEAR = 500_000, 1 << 20, 32, 500_000, 2e-9


def postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(id, dl, term, tf): how often each document has each of its terms; null texts are documents without terms."""
    rows = docs.select(F.col(key).alias("id"), text.tokens(F.col(body)).alias("t"))
    each = rows.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def _lean(a: np.ndarray) -> bytes:
    """Counts and places in as few bytes each as the largest needs, compressed, after a sign for the type and their length."""
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    return kind.char.encode() + len(raw := a.astype(kind).tobytes()).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[9:], int.from_bytes(b[1:9], "little"), "zstd", asbytes=True), chr(b[0])).astype(np.int64)


def _shut(a: pa.Array) -> bytes:
    return shut(pa.record_batch([a], ["x"]))


def _opened(b: bytes) -> pa.Array:
    return opened(b).column(0)


def _row(schema: pa.Schema, **values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v := values[f.name], pa.Array) else pa.array([v], f.type) for f in schema], schema=schema)


def _lists(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, owner, ok, t) as blocks, each with the words of all its documents (terms, and in how many each is: seen) and the postings of those that are ok, by owner and id."""
    for batch in batches:
        offsets = np.asarray(batch.column("t").offsets, np.int64)
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_WORDS, "right")) - 1), batch.num_rows)
            part, starts = batch.slice(at, to - at), offsets[at : to + 1]
            words = batch.column("t").values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
            n, size, dl = to - at, max(1, len(words.dictionary)), np.diff(starts)
            key, tf = np.unique(np.repeat(np.arange(n), dl) * size + np.asarray(words.indices, np.int64), return_counts=True)
            doc, code = key // size, key % size
            order = np.asarray(pc.sort_indices(pa.Table.from_batches([part.select(["owner", "id"])]), sort_keys=[("owner", "ascending"), ("id", "ascending")]))
            order = order[np.asarray(part.column("ok").cast(pa.uint8()))[order] > 0]
            place = np.full(n, -1)
            place[order] = np.arange(len(order))
            kept = np.flatnonzero(place[doc] >= 0)
            kept = kept[np.argsort(place[doc[kept]], kind="stable")]
            owner = part.column("owner").take(pa.array(order)).dictionary_encode()
            runs = np.bincount(np.asarray(owner.indices, np.int64), minlength=len(owner.dictionary))
            schema = pa.schema([("terms", pa.list_(pa.string())), ("seen", pa.list_(pa.int64())), ("n", pa.int64()), ("words", pa.int64()), ("owners", pa.list_(pa.string())), ("runs", pa.binary()), ("ids", pa.binary()), ("dls", pa.binary()), ("held", pa.binary()), ("codes", pa.binary()), ("tfs", pa.binary())])
            yield _row(schema, terms=_lists(words.dictionary), seen=_lists(pa.array(np.bincount(code, minlength=len(words.dictionary)))), n=n, words=int(dl.sum()), owners=_lists(owner.dictionary), runs=_lean(runs), ids=_shut(part.column("id").take(pa.array(order))), dls=_lean(dl[order]), held=_lean(np.bincount(place[doc[kept]], minlength=len(order))), codes=_lean(code[kept]), tfs=_lean(tf[kept]))
            at = to


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of words (owner, set, terms), by ascending number, as blocks of about BLOCK_WORDS words: each word and number is in it once, in few bytes, as a block goes to every part."""
    schema = pa.schema([("said", pa.binary()), ("owners", pa.list_(pa.string())), ("runs", pa.binary()), ("asked", pa.binary()), ("held", pa.binary()), ("codes", pa.binary()), ("sets", pa.int64()), ("words", pa.int64())])
    rows, n = [], 0

    def out() -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        rows.clear()
        owner, words = batch.column("owner").dictionary_encode(), batch.column("terms").flatten().dictionary_encode()
        return _row(schema, said=_shut(words.dictionary), owners=_lists(owner.dictionary), runs=_lean(np.asarray(owner.indices, np.int64)), asked=_lean(np.diff(np.asarray(batch.column("set")), prepend=0)), held=_lean(np.asarray(pc.list_value_length(batch.column("terms")), np.int64)), codes=_lean(np.asarray(words.indices, np.int64)), sets=batch.num_rows, words=len(words))

    for batch in batches:
        if batch.num_rows:
            rows.append(batch)
            n += len(batch.column("terms").flatten())
        if n >= BLOCK_WORDS:
            yield out()
            n = 0
    if rows:
        yield out()


class _Asked:
    """What is asked, of all blocks: by owner, the rarest term of each set first; sets with a term that no document has are left out."""

    def __init__(self, rows: list[dict]):
        vocabulary = [r for r in rows if r["idf"].is_valid]
        self.terms = pa.concat_arrays([r["terms"].values for r in vocabulary]) if vocabulary else pa.array([], pa.string())
        self.idf = np.concatenate([np.asarray(r["idf"].values) for r in vocabulary]) if vocabulary else np.zeros(0)
        held, codes, owner, ids, self.owners = [], [], [], [], {}
        for r in (r for r in rows if not r["idf"].is_valid):
            code = np.asarray(pc.index_in(_opened(r["said"].as_py()), value_set=self.terms).fill_null(-1), np.int64)
            names = np.array([self.owners.setdefault(x, len(self.owners)) for x in r["owners"].values.to_pylist()])
            held.append(_wide(r["held"].as_py())), codes.append(code[_wide(r["codes"].as_py())]), owner.append(names[_wide(r["runs"].as_py())]), ids.append(np.cumsum(_wide(r["asked"].as_py())))
        if not ids:
            self.n, self.ids = 0, None
            return
        n, code, owner = np.concatenate(held), np.concatenate(codes), np.concatenate(owner)
        fine = np.minimum.reduceat(code, np.cumsum(n) - n) >= 0
        code, kept = code[np.repeat(fine, n)], np.flatnonzero(fine)
        order = np.argsort(owner[kept], kind="stable")
        rank = np.empty(len(kept), np.int64)
        rank[order] = np.arange(len(kept))
        rarest = np.argsort(-self.idf, kind="stable")
        place = np.empty(len(rarest), np.int64)
        place[rarest] = np.arange(len(rarest))
        key = np.repeat(rank, n[kept]) * len(rarest) + place[code]
        key.sort()
        kept = kept[order]
        self.n, self.size, self.codes, self.ids = len(kept), n[kept], rarest.astype(np.int32)[key % max(1, len(rarest))], np.concatenate(ids)[kept]
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.range = np.searchsorted(owner[kept], np.arange(len(self.owners) + 1))
        self.kth = np.full(self.n, -np.inf)


def _matches(asked: _Asked, lo: int, hi: int, g: np.ndarray, doc: np.ndarray, part: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set, document, score) of the sets from lo to hi whose words are all in a document, of n documents with postings (g, doc, part)."""
    slot = np.full(len(asked.terms), -1)
    slot[g] = 0
    used = np.flatnonzero(slot == 0)
    slot[used] = np.arange(len(used))
    terms = slot[asked.codes[asked.start[lo] : asked.start[hi]]]
    first = asked.start[lo:hi] - asked.start[lo]
    alive = np.flatnonzero(np.minimum.reduceat(terms, first) >= 0)
    if not len(alive):
        return
    key = slot[g] * n + doc
    order = np.argsort(key)
    key, part = key[order], part[order]
    bits = np.empty((len(used), -(-n // 64)), np.uint64)  # of each word, the documents that have it
    for a in range(0, len(used), 1024):
        b = min(a + 1024, len(used))
        dense = np.zeros((b - a, bits.shape[1] * 64), bool)
        i, j = np.searchsorted(key, [a * n, b * n])
        dense[key[i:j] // n - a, key[i:j] % n] = True
        bits[a:b] = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
    step = max(1, PAIRS // n)
    for at in range(0, len(alive), step):
        q = alive[at : at + step]
        size, begin = asked.size[lo + q], first[q]
        acc = bits[terms[begin]]
        for j in (1, 2):
            more = np.flatnonzero(size > j)
            acc[more] &= bits[terms[begin[more] + j]]
        row, word = np.nonzero(acc)
        acc = acc[row, word]  # few are left of what the rarest words left
        for j in range(3, int(size.max())):
            more = np.flatnonzero(size[row] > j)
            if not len(more):
                break
            acc[more] &= bits[terms[begin[row[more]] + j], word[more]]
            more = np.flatnonzero(acc)
            row, word, acc = row[more], word[more], acc[more]
        if not len(row):
            continue
        hit, bit = np.nonzero(np.unpackbits(acc.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        row, at_doc = row[hit], word[hit] * 64 + bit
        score = np.zeros(len(row))
        for j in range(int(size[row].max())):
            more = slice(None) if (size[row] > j).all() else np.flatnonzero(size[row] > j)
            score[more] += part[np.searchsorted(key, terms[begin[row[more]] + j] * n + at_doc[more])]
        yield lo + q[row], at_doc, score


def _first(q: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows by set, falling score and id: which can be among the k best of their set, and the sets that have k with their k-th best score. Of one score only k can be."""
    new = np.concatenate([[True], q[1:] != q[:-1]])
    starts = np.flatnonzero(new)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    same = np.flatnonzero(new | np.concatenate([[True], score[1:] != score[:-1]]))
    twin = np.arange(len(q)) - np.repeat(same, np.diff(np.append(same, len(q))))
    full = starts[np.diff(np.append(starts, len(q))) >= k]
    least = np.full(len(starts), -np.inf)
    least[np.diff(np.append(starts, len(q))) >= k] = score[full + k - 1]
    return (place < k) | (twin < k) & (score >= np.repeat(least, np.diff(np.append(starts, len(q)))) - NEAR), q[full], score[full + k - 1]


def _best(k: int, avgdl: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, asked, held, fresh = [], None, None, []

        def merged() -> pa.Table:
            t = pa.concat_tables([*([held] if held is not None else []), *fresh])
            t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")])).combine_chunks()
            keep, q, kth = _first(np.asarray(t["q"]), np.asarray(t["score"]), k)
            asked.kth[q] = np.maximum(asked.kth[q], kth)
            fresh.clear()
            return t.filter(pa.array(keep))

        def out(t: pa.Table | None) -> Iterator[pa.RecordBatch]:
            for a in range(0, t.num_rows if t is not None else 0, 50_000):
                b = t.slice(a, 50_000).combine_chunks()
                yield from pa.table({"set": pa.array(asked.ids[np.asarray(b["q"])]), "id": b["id"], "score": b["score"]}).combine_chunks().to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                if not r["ids"].is_valid:
                    assert asked is None, "what is asked comes before the documents"
                    rows.append(r)
                    continue
                if asked is None:
                    asked = _Asked(rows)
                    rows.clear()
                if not asked.n:
                    continue
                ids = _opened(r["ids"].as_py())
                g = np.asarray(pc.index_in(r["terms"].values, value_set=asked.terms).fill_null(-1), np.int64)[_wide(r["codes"].as_py())]
                doc, dl, tf = np.repeat(np.arange(len(ids)), _wide(r["held"].as_py())), _wide(r["dls"].as_py()), _wide(r["tfs"].as_py())
                known = np.flatnonzero(g >= 0)
                g, doc, tf = g[known], doc[known], tf[known]
                part = asked.idf[g] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
                ends = np.cumsum(_wide(r["runs"].as_py()))
                for name, a, b in zip(r["owners"].values.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    if name not in asked.owners or b == a:
                        continue
                    lo, hi = asked.range[asked.owners[name] : asked.owners[name] + 2]
                    i0, i1 = np.searchsorted(doc, [a, b])
                    if hi == lo or i1 == i0:
                        continue
                    for q, d, s in _matches(asked, lo, hi, g[i0:i1], doc[i0:i1] - a, part[i0:i1], b - a):
                        good = np.flatnonzero(s >= asked.kth[q] - NEAR)
                        q, d, s = q[good], d[good], s[good]
                        order = np.lexsort((d, -s, q))
                        q, d, s = q[order], d[order], s[order]
                        if len(q):
                            keep = np.flatnonzero(_first(q, s, k)[0])
                            fresh.append(pa.table({"q": q[keep], "score": s[keep], "id": ids.take(pa.array(d[keep] + a))}))
                    if sum(t.num_rows for t in fresh) > 100_000 + (held.num_rows if held is not None else 0) // 2:
                        held = merged()
                if held is not None and held.num_rows > HELD:
                    yield from out(held)
                    held = None
        if fresh:
            held = merged()
        yield from out(held)

    return run


def bm25(docs: DataFrame, key: str, body: str, queries: DataFrame, k: int = 10, eligible: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best documents that have all terms of a query.

    ``queries`` has (query_id, terms), each query_id once; ``eligible`` may name a condition on documents, applied before ranking while
    the statistics stay those of all documents. With ``owner``, an expression on documents, queries also have a column ``owner`` and find
    only documents of their own. Score ties go to the smaller id; a query without terms finds nothing.

    The corpus is read into words once and packed into blocks; what is asked goes, as blocks too, to each of a bounded number of parts of
    it. A part finds the documents that have all words by the words' bit rows and keeps k a query, so no candidate is shuffled or
    stored. Queries of equal words and owner are asked once, under a number, and what is stored or sent to all parts is compressed.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    own = owner.cast("string") if owner is not None else F.lit("")
    asked = queries.select("query_id", (F.col("owner").cast("string") if owner is not None else F.lit("")).alias("owner"), F.array_sort(F.array_distinct("terms")).alias("terms"))
    asked = packed_cut(asked.where(F.col("query_id").isNotNull() & F.col("owner").isNotNull() & (F.size("terms") > 0) & F.forall("terms", lambda t: t.isNotNull())))
    sets = packed_cut(asked.select("owner", "terms").distinct().withColumn("set", F.monotonically_increasing_id()))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(own, F.lit("")).alias("owner"), (F.coalesce(eligible if eligible is not None else F.lit(True), F.lit(False)) & F.col(key).isNotNull() & own.isNotNull()).alias("ok"), text.tokens(F.col(body)).alias("t"))
    blocks = cut(rows.mapInArrow(_docs, "terms array<string>, seen array<bigint>, n bigint, words bigint, owners array<string>, runs binary, ids binary, dls binary, held binary, codes binary, tfs binary"))
    wanted = cut(sets.select("owner", "set", "terms").mapInArrow(_asked, "said binary, owners array<string>, runs binary, asked binary, held binary, codes binary, sets bigint, words bigint"))
    sizes = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    avgdl = sizes["words"] / max(1, sizes["n"]) or 1.0
    df = blocks.select(F.explode(F.arrays_zip("terms", "seen")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.seen").alias("df"))
    idf = F.greatest(F.log((F.lit(sizes["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    known = df.join(sets.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").select("term", idf.alias("idf"))
    known = cut(known.groupBy(F.pmod(F.xxhash64("term"), F.lit(PARTS)).alias("at")).agg(F.collect_list(F.struct("term", "idf")).alias("x")).select(F.col("x.term").alias("terms"), F.col("x.idf").alias("idf")))
    size = wanted.agg(F.coalesce(F.sum(F.col("sets") * 16 + F.col("words") * 4), F.lit(0)).alias("n")).first()["n"]
    across = min(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))  # each part of the corpus gives k a query
    down = max(1, -(-size // BROADCAST_BYTES))
    every = lambda n, of: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of))
    number = F.monotonically_increasing_id()
    parts = blocks.drop("seen", "n", "words").withColumn("_at", F.pmod(F.shiftright(number, 33) + F.pmod(number, F.lit(1 << 33)), F.lit(across)))
    parts = parts.withColumn("part", every(down, lambda i: i * across + F.col("_at"))).drop("_at").withColumn("side", F.lit(1))
    wanted = wanted.drop("sets", "words").withColumn("_at", F.pmod(F.xxhash64("codes", "held"), F.lit(down))).withColumn("part", every(across, lambda i: F.col("_at") * across + i)).drop("_at")
    known = known.withColumn("part", every(across * down, lambda i: i))
    both = parts.unionByName(wanted.withColumn("side", F.lit(0)), True).unionByName(known.withColumn("side", F.lit(0)), True)
    both = both.withColumn("part", F.col("part").cast("int")).repartitionById(across * down, "part").sortWithinPartitions("side").drop("part", "side")
    found = both.mapInArrow(_best(k, avgdl), f"set bigint, id {kind}, score double")
    each = asked.join(sets, ["owner", "terms"]).select("query_id", "set")
    return each.join(ranked(found, "set", k), "set").select("query_id", "id", "score", "rank")


def ranked(scored: DataFrame, query: str, k: int) -> DataFrame:
    """The k best of each query with their rank from 1; ties, at nine decimals, go to the smaller id."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, "id", "score", "rank")


_PACKED = "grp string, dim int, ids array<string>, mat binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (grp, id, vec) as blocks of unit vectors of one group and length, at most BLOCK a block."""
    held: dict[tuple, tuple[list, list]] = {}

    def out(keys: list[tuple]) -> pa.RecordBatch:
        blocks = [(key, *held.pop(key)) for key in keys]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _, _ in blocks]), pa.array([k[1] for k, _, _ in blocks], pa.int32()), pa.array([i for _, i, _ in blocks], pa.list_(pa.string())), pa.array([np.vstack(v).tobytes() for _, _, v in blocks], pa.binary())], names=["grp", "dim", "ids", "mat"])

    for batch in batches:
        vec = batch.column("vec")
        offsets, flat = np.asarray(vec.offsets), np.asarray(vec.values.to_numpy(zero_copy_only=False), np.float64)
        for i, (grp, ident) in enumerate(zip(batch.column("grp").to_pylist(), batch.column("id").to_pylist())):
            v = flat[offsets[i] : offsets[i + 1]]
            ids, rows = held.setdefault((grp, len(v)), ([], []))
            ids.append(ident)
            rows.append(v / np.linalg.norm(v))
            if len(ids) >= BLOCK:
                yield out([(grp, len(v))])
        if sum(len(ids) for ids, _ in held.values()) > 8 * BLOCK:
            yield out(list(held))
    if held:
        yield out(list(held))


def _top(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, mat, asked, qmat in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "mat", "asked", "qmat"))):
                s = np.frombuffer(qmat).reshape(-1, dim) @ np.frombuffer(mat).reshape(-1, dim).T
                r, c = np.nonzero(s >= least)
                if k < s.shape[1]:
                    # of this block no row below a query's k-th best can be among its k best; equal ones stay
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    keep = s[r, c] >= kth[r] - 1e-9
                    r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(asked).take(pa.array(r)), pa.array(ids).take(pa.array(c)), pa.array(s[r, c])], names=["query_id", "id", "score"])

    return run


def semantic(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, least: float = 0.3, group: list[str] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k most similar vectors of each query by exact cosine, of at least ``least``.

    ``queries`` has (query_id, vec) and the columns of ``group``; a query meets the vectors of its own group (such as model
    and owner) and length only. Both sides are packed into blocks and compared as matrix products; each pair of blocks keeps
    its k best a query before anything is shuffled. Blocks of queries are broadcast while they are small, by their measured bytes;
    more of them go to every part of the vectors by a shuffle. Null, empty, non-finite and all-zero vectors are
    neither found nor asked for; a query doesn't find itself.
    """
    fine = lambda v: v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    of = F.concat_ws("\u0001", *[F.col(c) for c in group or []])
    rows = vectors.where(fine(F.col(vector)) & F.col(key).isNotNull()).select(of.alias("grp"), F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    asked = queries.where(fine(F.col("vec"))).select(of.alias("grp"), F.col("query_id").cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    blocks = rows.mapInArrow(_packed, _PACKED)
    asked = cut(asked.coalesce(8).mapInArrow(_packed, _PACKED)).select("grp", "dim", F.col("ids").alias("asked"), F.col("mat").alias("qmat"))
    size = asked.agg(F.coalesce(F.sum(F.length("qmat")), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(asked), ["grp", "dim"])
    else:
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
        pairs = blocks.join(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).hint("merge"), ["grp", "dim", "part"])
    found = pairs.select("dim", "ids", "mat", "asked", "qmat").mapInArrow(_top(k + 1, least), "query_id string, id string, score double")
    found = found.where(F.col("query_id") != F.col("id"))
    return ranked(found.select(F.col("query_id").cast(dict(queries.dtypes)["query_id"]), F.col("id").cast(dict(vectors.dtypes)[key]), "score"), "query_id", k)


def fused(lanes: list[DataFrame], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank): reciprocal rank fusion of lanes that have (query_id, id, rank from 1)."""
    rows = None
    for i, lane in enumerate(lanes):
        part = lane.select("query_id", "id", F.lit(i).alias("lane"), (1 / (constant + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    scored = rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    return ranked(scored, "query_id", k or 2**31 - 1)


def weighted(results: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Fused scores times the weight of each row's source, ranked anew; ``sources`` has (id, source)."""
    rows = results.join(sources, "id").withColumn("score", F.col("score") * scoring.lookup(scoring.SOURCE_WEIGHT, F.col("source"), 1.0))
    return ranked(rows, "query_id", k)


def strategy(name: str, keyword: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """keyword, semantic, hybrid, or auto: fusion, but the keyword lane alone for queries whose vector lane is empty."""
    if name == "keyword":
        return keyword.where(F.col("rank") <= k)
    if name == "semantic":
        return vector.where(F.col("rank") <= k)
    if name == "hybrid":
        return fused([keyword, vector], k)
    keyword, vector = cut(keyword), cut(vector)  # each is read more than once
    both = fused([keyword, vector], k)
    lone = keyword.join(vector.select("query_id").distinct(), "query_id", "left_anti").where(F.col("rank") <= k)
    return both.join(vector.select("query_id").distinct(), "query_id", "left_semi").unionByName(lone)
