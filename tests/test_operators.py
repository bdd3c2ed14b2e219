"""Operators on small inputs with nulls, ties, repeats and empty tables."""

import json
import math
import pathlib
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evidenza import runtime
from evidenza.functions import scoring, text
from evidenza.operators import claims, context, evaluate, feedback, graph, health, history, lifecycle, ranking, recall, scope, search, vault
from evidenza.runtime import broadcast_if_small
from evidenza.plans import recall as plans_recall
from evidenza.sources import files, tables
from tests.compare import connect, differ


def test_broadcast_is_checked(spark):
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(broadcast_if_small(spark.range(5), 10)) or "UnresolvedHint" in plan(broadcast_if_small(spark.range(5), 10))
    assert "Hint" not in plan(broadcast_if_small(spark.range(50), 10))


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "  A\t b\n", text.content_key) == "a b"
    assert one(spark, None, text.content_key) is None
    assert one(spark, None, text.tokens) == []
    assert one(spark, "", text.token_estimate) == 1
    assert one(spark, "abcdefg", text.token_estimate) == 3
    assert one(spark, "x" * 50, lambda c: text.fit_tokens(c, 5)) == "x" * 14 + "…"
    assert one(spark, "One. Two! Three", text.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, "Sam prefers tea.", lambda c: text.claim_parts(F.lit("Sam"), c)) == ("prefers", "tea")
    assert one(spark, "It rains", lambda c: text.claim_parts(F.lit("Sam"), c)) == ("states", "It rains")
    assert one(spark, "---\na: 1\n---\nbody", text.frontmatter) == "a: 1"
    assert one(spark, "no block", text.frontmatter) is None
    assert one(spark, "see [it](http://x) `now` **b**", text.plain_markdown) == "see it now b"
    assert one(spark, "the api_key = abcdef123", text.has_secret) is True
    assert one(spark, None, text.has_secret) is False
    assert one(spark, "load is 40 %", text.transient) is True
    assert one(spark, "what did we decide previously", text.historical_intent) is True
    assert one(spark, "thanks!", text.needs_memory) is False
    assert one(spark, None, text.query_archetype) == "unknown"
    assert one(spark, "a b c d", lambda c: text.phrases(c, 3)) == ["a b c", "b c d", "a b"]


def test_contradiction(spark):
    yes = [("the lamp is not on", "the lamp is on"), ("the stove is online", "the stove is offline!"), ("it never rains", "it not never rains")]
    no = [("the lamp is on", "the lamp is on"), ("red green blue", "one two three not")]
    df = spark.createDataFrame(yes + no, "a string, b string").select(text.contradicts(text.said_words(F.col("a")), text.said_words(F.col("b"))).alias("c"))
    assert [r["c"] for r in df.collect()] == [True, True, True, False, False]


def test_cosine_and_decay(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(scoring.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert one(spark, 0.1, lambda c: scoring.decayed_trust(c, F.lit(0.0)), "double") == 0.3
    assert one(spark, 0.8, lambda c: scoring.decayed(c, F.lit(30.0), 30.0), "double") == pytest.approx(0.4)


def test_scope(spark):
    df = spark.createDataFrame([("a/b.md",), ("a\\c.md",), ("ab/c.md",), (None,)], "p string")
    assert [r[0] for r in df.select(scope.in_paths(F.col("p"), ["a/"])).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(scope.in_paths(F.col("p"), [])).collect()] == [False] * 4
    assert scope.effective_paths(["a/b"], ["a", "c"]) == ["a/b"]
    assert scope.effective_paths(["x"], ["a"]) == []
    assert scope.effective_paths(None, ["a"]) == ["a"]
    assert scope.effective_paths(["a"], []) == ["a"] and scope.effective_paths([], None) is None
    rows = spark.createDataFrame([("vault", None, "x/y"), ("vault", None, "z"), ("import", "document", "z"), ("import", None, "z"), (None, None, None)], "s string, k string, p string")
    assert [r[0] for r in rows.select(scope.document_allowed(F.col("s"), F.col("k"), F.col("p"), ["x"])).collect()] == [True, False, False, True, True]


def test_search_without_hits(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "a a")], "id bigint, t string")
    q = spark.createDataFrame([(7, ["a", "zz"]), (8, ["a"]), (9, [])], "query_id bigint, terms array<string>")
    got = search.bm25(docs, "id", "t", q).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(8, 1), (8, 3)}


@pytest.mark.parametrize("owned", [False, True])
def test_keyword_search_against_every_pair(spark, monkeypatch, owned):
    """Many blocks, ties, copies, null and long texts, documents that only count, equal and hopeless questions."""
    for name, value in (("BLOCK_WORDS", 150), ("PAIRS", 64), ("HELD", 200), ("PARTS", 3)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(3)
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 40)}"
    docs = [(f"d{i:03d}", None if i % 50 == 7 else " ".join(word() for _ in range(rng.choice([1, 3, 8, 12, 400 if i % 90 == 0 else 9]))), rng.choice("xyz") if i % 40 else None, i % 7 != 3) for i in range(300)]
    docs += [(f"e{i:03d}", *d[1:]) for i, d in enumerate(docs[:60])]
    asked = [(i, rng.choice("xyzq"), [word() for _ in range(rng.choice([1, 1, 2, 3, 5]))]) for i in range(80)] + [(98, "x", ["w0", "nowhere"]), (99, "x", []), (100, "x", None), (101, None, ["w1"]), (102, "x", ["w1", None])]
    words = {d[0]: re.findall("[a-z0-9]+", (d[1] or "").lower()) for d in docs}
    avgdl = sum(map(len, words.values())) / len(words)
    df = defaultdict(int)
    for w in words.values():
        for t in set(w):
            df[t] += 1
    want = {}
    for q, own, terms in asked:
        if not terms or None in terms or owned and own is None:
            continue
        hits = []
        for ident, _, mine, ok in docs:
            if ok and (not owned or mine == own) and set(terms) <= set(words[ident]):
                tf = {t: words[ident].count(t) for t in set(terms)}
                hits.append((sum(max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words[ident]) / avgdl)) for t in tf), ident))
        for rank, (score, ident) in enumerate(sorted(hits, key=lambda h: (-round(h[0], 9), h[1]))[:4], 1):
            want[q, ident] = (round(score, 6), rank)
    d = spark.createDataFrame(docs, "id string, t string, agent string, ok boolean").repartition(3)
    q = spark.createDataFrame(asked, "query_id bigint, owner string, terms array<string>")
    got = search.bm25(d, "id", "t", q, 4, F.col("ok"), F.col("agent") if owned else None).collect()
    assert len(want) > 100 and {(r["query_id"], r["id"]): (round(r["score"], 6), r["rank"]) for r in got} == want


def test_keyword_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, t string")
    q = spark.createDataFrame([(7, ["a"])], "query_id bigint, terms array<string>")
    assert search.bm25(docs.where("id > 5"), "id", "t", q).collect() == []
    assert search.bm25(docs, "id", "t", q.where("query_id = 0")).collect() == []


def moved(spark, run):
    """Rows that the shuffles of a run write."""
    store = spark.sparkContext._jsc.sc().statusStore()
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    wait()
    sums = lambda: sum(s.shuffleWriteRecords() for s in [all_.apply(i) for i in range(all_.size())])
    all_ = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = sums()
    run()
    wait()
    all_ = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sums() - before


def test_keyword_search_moves_no_candidates(spark):
    """300 questions, 2,000 documents that have the words of all of them: 600,000 pairs, of which 10 a question come out."""
    docs = spark.range(2000).select("id", F.concat(F.lit("common "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit("w"), i)), " "), F.lit(" "), F.col("id")).alias("t")).repartition(4, F.md5("t"))
    q = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id"))).alias("terms"))
    found = []
    assert moved(spark, lambda: found.extend(search.bm25(docs, "id", "t", q).collect())) < 60_000
    assert len(found) == 3000 and {r["id"] for r in found} == set(range(10))


def crowd(spark, n=300):
    """Documents that have all words of all questions, and the questions, for the tests of what a search moves."""
    docs = spark.range(2000).select("id", F.concat(F.lit("common "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("w"), i)), " "), F.lit(" "), F.col("id")).alias("t")).repartition(4, F.md5("t"))
    q = spark.range(n).select(F.col("id").alias("query_id"), F.lit("a").alias("owner"), F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id"))).alias("terms"))
    return docs, q


def test_fused_lanes_move_no_candidates(spark):
    docs, q = crowd(spark)
    found = []
    vector = q.select("query_id", F.lit(7).cast("bigint").alias("id"), F.lit(1).alias("rank"))
    assert moved(spark, lambda: found.extend(search.fused([search.bm25(docs, "id", "t", q.drop("owner")), vector], 10).collect())) < 60_000
    assert len(found) == 3000 and {r["id"] for r in found if r["rank"] == 1} == {7}


def test_fallback_moves_no_candidates(spark):
    """The keyword lane is read twice; it must be found once."""
    docs, q = crowd(spark)
    found = []
    vector = q.where("query_id % 2 = 0").select("query_id", F.lit(7).cast("bigint").alias("id"), F.lit(1).alias("rank"))
    assert moved(spark, lambda: found.extend(search.strategy("auto", search.bm25(docs, "id", "t", q.drop("owner")), vector, 5).collect())) < 60_000
    assert len(found) == 1500 and {(r["query_id"] % 2, r["id"]) for r in found if r["rank"] == 1} == {(0, 7), (1, 0)}


def test_owned_keyword_search_moves_no_candidates(spark):
    docs, q = crowd(spark)
    found = []
    assert moved(spark, lambda: found.extend(search.bm25(docs, "id", "t", q, 8, owner=F.when(F.col("id") % 2 == 1, "a").otherwise("b")).collect())) < 60_000
    assert len(found) == 2400 and {r["id"] for r in found} == set(range(1, 16, 2))


def test_scoped_keyword_search_moves_no_candidates(spark):
    docs, q = crowd(spark)
    found = []
    assert moved(spark, lambda: found.extend(search.bm25(docs, "id", "t", q.drop("owner"), 5, F.col("id") >= 100).collect())) < 60_000
    assert len(found) == 1500 and {r["id"] for r in found} == set(range(100, 105))


def test_weighted_lanes_move_no_candidates(spark):
    docs, q = crowd(spark)
    found = []
    sources = docs.select("id", F.when(F.col("id") == 9, "manual").otherwise("vault").alias("source"))
    assert moved(spark, lambda: found.extend(search.weighted(search.fused([search.bm25(docs, "id", "t", q.drop("owner"))]), sources, 10).collect())) < 60_000
    assert len(found) == 3000 and {r["id"] for r in found if r["rank"] == 1} == {9}


def test_keyword_lane_moves_no_candidates(spark):
    """As a prefetch asks: many questions of the same words are found once, and each gets its rows."""
    docs, q = crowd(spark, 150)
    m = docs.select(F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.lit("a").alias("agent"), F.lit("shared").alias("visibility"), F.lit("manual").alias("source"), F.lit("fact").alias("type"), F.lit(None).cast("string").alias("source_id"), F.col("t").alias("content"), F.array(F.lit("common")).alias("tags"))
    q = q.select(F.explode(F.array(*[F.concat_ws("#", "query_id", F.lit(i).cast("string")) for i in range(3)])).alias("query_id"), "owner", "terms")
    found = []
    assert moved(spark, lambda: found.extend(recall.keyword_lane(m, q, 5).collect())) < 60_000
    assert len(found) == 150 * 3 * 5 and {r["id"] for r in found} == {f"m000{i}" for i in range(5)}


def moved_bytes(spark, run):
    """Bytes that the shuffles of a run write."""
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    sums = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000) or sum(s.shuffleWriteBytes() for s in [all_.apply(i) for all_ in [stages()] for i in range(all_.size())])
    before = sums()
    run()
    return sums() - before


def many(spark, owned=False):
    """20,000 questions of different words and long ids, each of which one document answers."""
    docs = spark.range(0, 20_000, 1, 4).select(F.md5(F.col("id").cast("string")).alias("id"), F.lit("a").alias("agent"), F.concat(F.lit("common w"), F.col("id")).alias("t"))
    q = spark.range(0, 20_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("query_id"), F.lit("a").alias("owner"), F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id"))).alias("terms"))
    return docs, q if owned else q.drop("owner")


def with_partitions(spark, n, run):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_questions_go_to_all_parts_without_their_ids(spark):
    docs, q = many(spark, owned=True)
    found = []
    n = with_partitions(spark, 16, lambda: moved_bytes(spark, lambda: found.extend(search.bm25(docs, "id", "t", q, 5, owner=F.col("agent")).collect())))
    assert len(found) == 20_000 and {r["rank"] for r in found} == {1} and n < 15_000_000, n


def test_fused_lanes_send_questions_without_their_ids(spark):
    docs, q = many(spark)
    found = []
    vector = q.limit(1).select("query_id", F.lit("near").alias("id"), F.lit(1).alias("rank"))
    n = with_partitions(spark, 16, lambda: moved_bytes(spark, lambda: found.extend(search.fused([search.bm25(docs, "id", "t", q), vector], 10).collect())))
    assert len(found) == 20_001 and n < 25_000_000, n


def test_scoped_search_sends_questions_without_their_ids(spark):
    docs, q = many(spark)
    found = []
    n = with_partitions(spark, 16, lambda: moved_bytes(spark, lambda: found.extend(search.bm25(docs, "id", "t", q, 5, F.col("t").endswith("7")).collect())))
    assert len(found) == 2000 and n < 15_000_000, n


def test_weighted_lanes_send_questions_without_their_ids(spark):
    docs, q = many(spark)
    found = []
    sources = docs.select("id", F.lit("vault").alias("source"))
    n = with_partitions(spark, 16, lambda: moved_bytes(spark, lambda: found.extend(search.weighted(search.fused([search.bm25(docs, "id", "t", q)]), sources, 10).collect())))
    assert len(found) == 20_000 and n < 25_000_000, n


def test_packed_cut_stores_few_bytes(spark):
    rows = spark.range(0, 20_000, 1, 2).select("id", F.array(F.lit("common"), F.lit("word"), F.when(F.col("id") > 0, F.concat(F.lit("w"), F.col("id")))).alias("terms"), F.lit(None).cast("string").alias("owner"))
    kept, where = runtime.packed_cut(rows), spark.sparkContext._jsc.sc().getCheckpointDir().get()
    sizes = {p: sum(f.stat().st_size for f in p.iterdir()) for p in pathlib.Path(where.removeprefix("file:")).iterdir()}
    assert sizes[max(sizes, key=lambda p: int(p.name.removeprefix("rdd-")))] < 400_000
    assert kept.dtypes == rows.dtypes and sorted(kept.collect()) == sorted(rows.collect())


def test_costs_are_shuffled_without_the_texts(spark, tmp_path):
    """Prefetch packs by costs; the texts they come from needn't be moved."""
    rows = spark.range(2000).select(F.col("id").cast("string"), F.expr("concat_ws('', transform(sequence(1, 30), i -> md5(concat(id, '-', i))))").alias("content"), F.lit("active").alias("status"), F.lit("fact").alias("type"), F.lit("a").alias("agent"), F.lit("shared").alias("visibility"), F.lit("manual").alias("source"), F.lit(0.5).alias("trust_score"), F.lit("2025-01-01").cast("timestamp").alias("updated_at"))
    rows.unionByName(rows.withColumns({"updated_at": F.lit("2024-01-01").cast("timestamp"), "content": F.lit("old")})).write.parquet(f"{tmp_path}/memories.parquet")
    found = []
    n = moved_bytes(spark, lambda: found.extend(tables.memories(spark, str(tmp_path), cost=text.token_estimate(F.col("content"))).select("id", "cost").collect()))
    assert len(found) == 2000 and {r["cost"] for r in found} == {320} and n < 300_000, n


def test_candidates_shuffle_the_texts_once(spark, tmp_path):
    """Of the facts that ask, only the words they ask with need be moved."""
    noise = "translate(concat_ws('', transform(sequence(1, 30), i -> md5(concat(id, '-', i)))), '0123456789abcdef', '!@#$%^&*()~+=-:;')"
    rows = spark.range(2000).select(F.col("id").cast("string"), F.expr(f"concat('stored w', 100000 + id, ' ', {noise})").alias("content"), F.lit("active").alias("status"), F.lit("fact").alias("type"), F.lit("a").alias("agent"), F.lit("shared").alias("visibility"), F.lit("manual").alias("source"), F.lit(0.5).alias("trust_score"), F.lit("2025-01-01").cast("timestamp").alias("updated_at"))
    rows.write.parquet(f"{tmp_path}/memories.parquet")
    found = []
    n = moved_bytes(spark, lambda: found.extend(plans_recall.memory_candidates(spark, str(tmp_path)).collect()))
    assert {(r["query_id"], r["id"], r["rank"]) for r in found} == {(str(i), str(i), 1) for i in range(2000)} and n < 3_500_000, n


def facts(spark, where, texts):
    """Stored facts of (id, agent, content)."""
    rows = spark.createDataFrame(texts, "id string, agent string, content string")
    rows.select("*", F.lit("active").alias("status"), F.lit("fact").alias("type"), F.lit("shared").alias("visibility"), F.lit("manual").alias("source"), F.lit(0.5).alias("trust_score"), F.lit("2025-01-01").cast("timestamp").alias("updated_at")).write.parquet(f"{where}/memories.parquet")


def test_candidates_have_all_long_words_of_a_fact(spark, tmp_path):
    """A fact asks with its whole text: what only begins like it is no candidate."""
    same = "silver harbour lantern"
    facts(spark, tmp_path, [("1", "a", f"{same} by winter morning"), ("2", "a", f"{same} by summer evening"), ("3", "a", f"{same} by winter morning, gardens"), ("4", "b", f"{same} by winter morning"), ("5", "a", same), ("6", "a", "Red sky")])
    got = {(r["query_id"], r["id"]): r["rank"] for r in plans_recall.memory_candidates(spark, str(tmp_path)).collect()}
    assert got == {("1", "1"): 1, ("1", "3"): 2, ("2", "2"): 1, ("3", "3"): 1, ("4", "4"): 1, ("5", "5"): 1, ("5", "1"): 2, ("5", "2"): 3, ("5", "3"): 4}


def test_candidates_of_many_words_equal_sql(spark, tmp_path):
    rnd, words = random.Random(5), [f"harbour{i}" for i in range(16)]
    facts(spark, tmp_path, [(f"m{i}", rnd.choice("ab"), " ".join(rnd.choices(words, k=rnd.randint(1, 24)))) for i in range(600)])
    assert differ(plans_recall.memory_candidates(spark, str(tmp_path)), connect(str(tmp_path)), plans_recall.ORACLE["memory_candidates"]) == ""


def test_semantic_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.1])], "id bigint, v array<double>")
    got = search.semantic(v, "id", "v", v.select(F.col("id").alias("query_id"), F.col("v").alias("vec")), 1).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(1, 2), (2, 6), (6, 2)}
    assert search.semantic(v, "id", "v", v.where("id = 3").select(F.col("id").alias("query_id"), F.col("v").alias("vec"))).collect() == []


def test_fusion_and_fallback(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 5, 1)], "query_id bigint, id bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id bigint, id bigint, rank int")
    got = {(r["query_id"], r["id"]): r["rank"] for r in search.fused([a, b], 10).collect()}
    assert got[1, 11] == 1 and got[1, 10] == 2


def test_resolution(spark):
    df = spark.createDataFrame([("s", 1, True, 0.9, 1.0, None), ("s", 2, False, 0.5, 1.0, None), ("t", 3, False, 0.5, 1.0, None)], "g string, id int, uncertain boolean, confidence double, score double, at timestamp")
    got = {r["g"]: (r["id"], r["n_alternatives"], r["resolution"]) for r in ranking.claim_winners(df, ["g"], "id").collect()}
    assert got == {"s": (2, 1, "unresolved"), "t": (3, 0, "resolved")}


def test_lane_normalized(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 0.0)], "lane string, score double")
    assert sorted(r["relevance"] for r in ranking.lane_normalized(df, ["lane"]).collect()) == pytest.approx([0.01, 0.05, 1.0, 1.0])


def test_packing_against_plain_python(spark):
    r = random.Random(1)
    rows = [(g, i, r.randrange(1, 60), r.choice(list(context.QUOTAS))) for g in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, id int, cost int, kind string")
    got = {(x["g"], x["id"]) for x in context.greedy_packed(df, "g", ["id"], "id", "cost", 200).collect()}
    want = set()
    for g in range(5):
        used = 0
        for _, i, c, _k in [x for x in rows if x[0] == g]:
            if used + c <= 200:
                used += c
                want.add((g, i))
    assert got == want
    packed = context.context_packed(df, "g", ["id"], "id", "cost", "kind", 300).toPandas()
    assert (packed.groupby("g").granted.sum() <= 300).all() and (packed.groupby("g").cut.sum() <= 1).all()


def test_reconciled(spark):
    t = [datetime(2025, 1, i, tzinfo=timezone.utc) for i in range(1, 6)]
    rows = [("s", 1, 5, t[0], 0.9, True), ("s", 2, 5, t[1], 0.9, False), ("s", 3, 6, t[2], 0.9, False), ("s", 4, 6, t[3], 0.9, True), ("s", 5, 7, t[4], 0.5, True)]
    df = spark.createDataFrame(rows, "subject string, id int, object int, observed_at timestamp, confidence double, verified boolean")
    got = {r["id"]: (r["decision"], r["active_id"]) for r in claims.reconciled(df, ["subject"]).collect()}
    assert got == {1: ("first", 1), 2: ("duplicate", 1), 3: ("unresolved", 1), 4: ("update", 4), 5: ("unresolved", 4)}


def test_contradicting_memories(spark):
    m = spark.createDataFrame([("a", "x", "the lamp is on"), ("b", "x", "the lamp is not on"), ("c", "y", "the lamp is not on"), ("d", "x", None)], "id string, agent string, content string")
    links = spark.createDataFrame([(i, e) for i in "abcd" for e in ("e1", "e2")], "memory_id string, entity_id string")
    assert [(r["a"], r["b"]) for r in lifecycle.contradictions(m, links).collect()] == [("a", "b")]


def test_contradictions_share_any_one_entity(spark):
    r = random.Random(5)
    words = ["lamp", "door", "open", "closed", "not", "never", "red", "on", "off", "shed", "light", "dark", "always"]
    rows = [(f"m{k:03d}", r.choice(["x", "y"]), " ".join(r.choice(words) for _ in range(r.randrange(0, 8)))) for k in range(120)]
    rows += [("p", "z", "the lamp is on"), ("q", "z", "the lamp is not on"), ("r", "z", "the lamp is not on"), ("s", "z", "the lamp is off")]
    linked = {i: {f"e{r.randrange(12):02d}" for _ in range(r.randrange(0, 5))} for i, _, _ in rows} | {"p": {"e01", "e02", "e09"}, "q": {"e00", "e03", "e09"}, "r": {"e04"}, "s": {"e09"}}
    m = spark.createDataFrame(rows, "id string, agent string, content string")
    links = spark.createDataFrame([(i, e) for i in linked for e in linked[i]], "memory_id string, entity_id string")
    got = [(x["a"], x["b"]) for x in lifecycle.contradictions(m, links).collect()]
    a, b = m.select(F.col("id").alias("a"), F.col("agent").alias("g"), text.said_words(F.col("content")).alias("t")), m.select(F.col("id").alias("b"), F.col("agent").alias("h"), text.said_words(F.col("content")).alias("u"))
    want = {(x["a"], x["b"]) for x in a.join(b, (F.col("g") == F.col("h")) & (F.col("a") < F.col("b"))).where(text.contradicts(F.col("t"), F.col("u"))).collect() if linked[x["a"]] & linked[x["b"]]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert ("p", "q") in want and ("p", "s") in want and not any("r" in p for p in got)


def test_merge_edit_upsert(spark):
    m = spark.createDataFrame([("g", "a", "one", ["t"], 1), ("g", "b", "one", None, 2), ("g", "c", "two", ["u", "t"], 3)], "g string, id string, content string, tags array<string>, at int")
    r = lifecycle.merged(m, "g", "id", "content", "tags", "at").first()
    assert (r["content"], r["tags"], r["replaced"]) == ("one | two", ["t", "u"], ["a", "b", "c"])
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    mem = spark.createDataFrame([("a", "active", "private", 0.5), ("b", "active", "private", None)], "id string, status string, visibility string, trust double")
    e = spark.createDataFrame([("a", t, 1, "feedback", 0.9), ("a", t, 2, "feedback", -0.2), ("a", t, 3, "share", None), ("a", t, 4, "forget", None)], "id string, at timestamp, seq bigint, action string, amount double")
    got = {x["id"]: (x["status"], x["visibility"], round(x["trust"], 6)) for x in lifecycle.edited(mem, e).collect()}
    assert got == {"a": ("forgotten", "shared", 0.8), "b": ("active", "private", 0.5)}
    old, new = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, v int, c string"), spark.createDataFrame([(1, 1, "z"), (3, 0, "w")], "k int, v int, c string")
    assert {(x["k"], x["c"]) for x in lifecycle.upserted(old, new, ["k"], ["v"]).collect()} == {(1, "z"), (2, "y"), (3, "w")}
    assert {x["k"] for x in lifecycle.new_only(new, old, ["k"]).collect()} == {3}


def test_merge_of_a_large_group(spark):
    rows = [("g", f"m{k:04d}", f"text {k % 1500}", [f"tag {k % 1300}", "all"], k) for k in range(3000)] + [("h", "x", None, None, 1), ("h", "y", None, [], None), (None, "z", "alone", ["b", None, "b", "a"], 1)]
    m = spark.createDataFrame(rows, "g string, id string, content string, tags array<string>, at int")
    got = {r["g"]: r for r in lifecycle.merged(m, "g", "id", "content", "tags", "at").collect()}
    g = got["g"]
    assert g["replaced"] == [f"m{k:04d}" for k in range(3000)] and g["n"] == 3000 and g["content"] == " | ".join(f"text {k}" for k in range(1500))
    assert g["tags"] == ["tag 0", "all"] + [f"tag {k}" for k in range(1, 1300)]
    assert (got["h"]["content"], got["h"]["tags"], got["h"]["replaced"], got["h"]["n"]) == ("", [], ["y", "x"], 2)
    assert (got[None]["content"], got[None]["tags"], got[None]["n"]) == ("alone", ["b", None, "a"], 1) and len(got) == 3


def test_entity_mentions(spark):
    df = spark.createDataFrame([(1, "The Blue Lamp is near Blue. Ask Sam at Blue Lamp"), (2, None), (3, "")], "id int, t string")
    got = [(r["id"], r["name"]) for r in graph.entity_mentions(df, "id", "t").orderBy("id", "rank").collect()]
    assert got[0] == (1, "Blue Lamp") and (1, "Blue") not in got and {i for i, _ in got} == {1}


def test_reachable(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "entity_a string, entity_b string")
    s = spark.createDataFrame([("a",), ("z",)], "seed string")
    assert {(r["seed"], r["node"], r["hops"]) for r in graph.reachable(e, s, 2).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("z", "z", 0)}


def test_civil_ranges_and_cursors():
    now = datetime(2025, 3, 30, 12, tzinfo=timezone.utc)  # clocks change in Berlin
    a, b = history.civil_range("today", now, "Europe/Berlin")
    assert (b - a).total_seconds() == 23 * 3600
    a, b = history.civil_range("2d", now, "UTC")
    assert (b - a).days == 2
    token = history.cursor({"id": "x"}, {"q": 1})
    assert history.opened(token, {"q": 1}) == {"id": "x"}
    with pytest.raises(ValueError):
        history.opened(token, {"q": 2})
    with pytest.raises(ValueError):
        history.opened("?", {"q": 1})


def test_receipts_against_brute_force(spark):
    r = random.Random(5)
    base = datetime(2025, 1, 1, tzinfo=timezone.utc).timestamp()
    ev = [(i, r.randrange(4), base + r.randrange(4000)) for i in range(120)]
    df = spark.createDataFrame([(i, k, datetime.fromtimestamp(t, timezone.utc)) for i, k, t in ev], "id int, k int, at timestamp")
    got = {x["closing_id"]: x["opened_id"] for x in feedback.closed_receipts(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "k", 300).collect()}
    want = {}
    for i, k, t in ev:
        if i % 2:
            c = [(u, j) for j, q, u in ev if j % 2 == 0 and q == k and 0 <= t - u <= 300]
            if c:
                want[i] = max(c)[1]
    assert got == want


def test_jobs(spark):
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    log = spark.createDataFrame([("a", t, 1, "enqueued"), ("b", t, 1, "failed"), ("b", t, 2, "failed"), ("c", t, 1, "failed"), ("c", t, 2, "failed"), ("c", t, 3, "failed"), ("d", t, 1, "claimed"), ("e", t, 1, "done")], "job string, at timestamp, seq int, event string")
    got = {r["job"]: (r["state"], r["wait_s"]) for r in feedback.job_states(log, "job", now=F.lit("2025-01-02").cast("timestamp")).collect()}
    assert got == {"a": ("pending", None), "b": ("retry_wait", 2.0), "c": ("dead_letter", None), "d": ("stale", None), "e": ("ready", None)}


def test_percentile_index(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(6)], "g string, v double")
    assert health.percentiles(df, ["g"], "v", [0.5]).first()["value"] == 2.0  # 2.5 rounds to even


def passages_of(body, size, overlap):
    """The rule in plain Python: (heading path, start, end)."""
    body = body.strip()
    if len(body) <= size:
        return [("", 0, len(body))]
    sections, path, start, at, heading = [], [], 0, 0, ""
    for line in body.split("\n"):
        if m := re.match(r"[ \t]*(#{1,6})[ \t]+(\S.*)", line):
            if at > start:
                sections.append((heading, start, at))
            path = path[: len(m[1]) - 1] + [m[2].strip()]
            heading, start = " > ".join(path), at
        at += len(line) + 1
    sections.append((heading, start, len(body)))
    out = []
    for heading, lo, hi in sections:
        begin = lo
        while begin < hi:
            end = min(hi, begin + size)
            if end < hi and (line := body.rfind("\n", begin + size * 3 // 4, end)) > begin:
                end = line
            if body[begin:end].strip():
                out.append((heading, begin, end))
            if end >= hi:
                break
            begin = max(end - min(overlap, size // 2), begin + 1)
    return out


def test_passages(spark):
    r = random.Random(9)
    line = lambda: r.choice(["# One", "## Two", "### Three three", "#none", "", "", "a" * r.randrange(1, 60), "word " * r.randrange(1, 8)])
    bodies = ["\n".join(line() for _ in range(r.randrange(1, 40))) for _ in range(60)] + ["b" * 500, " \n", "# Head\n" + "c" * 90]
    got = defaultdict(list)
    for x in vault.passages(spark.createDataFrame([*enumerate(bodies), (900, None), (901, "")], "id int, t string"), "id", "t", 80, 15).orderBy("id", "start").collect():
        got[x["id"]].append((x["heading"], x["start"], x["start"] + x["length"]))
    assert dict(got) == {i: p for i, b in enumerate(bodies) if b.strip() and (p := passages_of(b, 80, 15))}


def test_snapshot_diff(spark):
    o, n = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "p string, h string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", "4")], "p string, h string")
    assert {r["p"]: r["change"] for r in vault.snapshot_diff(o, n, ["p"], "h").collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "new"}


def test_metrics(spark):
    j = spark.createDataFrame([(1, 5), (1, 6), (2, 9)], "query_id int, id int")
    r = spark.createDataFrame([(1, 6, 1), (1, 8, 2)], "query_id int, id int, rank int")
    got = {x["query_id"]: (x["recall_1"], x["mrr"]) for x in evaluate.ranking_metrics(r, j).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, 0.0)}


def test_files(spark, tmp_path):
    (tmp_path / "v" / "90_old").mkdir(parents=True)
    (tmp_path / "v" / "a.md").write_text("# A\n- one\n```\n- code\n```\n2. two\n")
    (tmp_path / "v" / "90_old" / "b.md").write_text("x")
    (tmp_path / "v" / "c.txt").write_text("x")
    df = files.markdown_folder(spark, str(tmp_path / "v"), ["90_"])
    assert [r["path"] for r in df.collect()] == ["a.md"]
    assert [r["entry"] for r in files.entry_lines(df, "path", "text").orderBy("line").collect()] == ["one", "two"]
    t = spark.createDataFrame([("=1+1", 1), ("ok", None)], "a string, b int")
    files.write_report(t, str(tmp_path / "r"))
    assert {x["a"] for x in spark.read.option("header", True).csv(str(tmp_path / "r/report")).collect()} == {"'=1+1", "ok"}
    mark = files.backup(t, str(tmp_path / "b"))
    assert files.restore(spark, str(tmp_path / "b"), mark).count() == 2
    with pytest.raises(ValueError):
        files.restore(spark, str(tmp_path / "b"), (3, "0"))
    best, conflicts = files.recovered([t, spark.createDataFrame([("ok", 7)], "a string, b int")], ["a"])
    assert {(r["a"], r["b"]) for r in best.collect()} == {("=1+1", 1), ("ok", None)} and conflicts.count() == 1
    case = {"schema_version": 1, "case_id": "x", "persona": "p", "category": "historical_query", "sessions": [{"observed_at": "2025-01-01T00:00:00Z", "turns": [{"user": "u"}]}], "query": {"text": "q", "at": "2025-01-01T00:00:00Z"}, "expected": {"supporting_memory_labels": ["session-0-turn-0"]}}
    wrong = {"schema_version": {"schema_version": 2}, "category": {"category": "other"}, "persona": {"persona": " "}, "sessions": {"sessions": []}, "turns": {"sessions": [{"observed_at": "2025-01-01", "turns": []}]}, "observed_at": {"sessions": [{"observed_at": "soon", "turns": [{"user": "u"}]}]}, "query": {"query": {"text": "q"}}, "unknown labels": {"expected": {"supporting_memory_labels": ["m"]}}, "user": {"sessions": [{"observed_at": "2025-01-01", "turns": [{"user": ""}]}]}}
    lines = [case, *[case | w | {"case_id": f"w{i}"} for i, w in enumerate(wrong.values())], case | {"case_id": "two"}, case | {"case_id": "two"}]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    (tmp_path / "c.json").write_text(json.dumps(lines, indent=1))
    for name in ("c.jsonl", "c.json"):
        good, bad = files.cases(spark, str(tmp_path / name))
        assert [r["case_id"] for r in good.collect()] == ["x"]
        assert {r["case_id"]: r["reason"] for r in bad.collect()} == {f"w{i}": k for i, k in enumerate(wrong)} | {"two": "case_id"}
    assert files.canonical_digest({"b": 1, "a": [2]}) == files.canonical_digest({"a": [2], "b": 1}) != files.canonical_digest({"a": [2], "b": 2})
    assert files.stable_report({"b": [{"elapsed_ms": 3, "x": 1}], "run_id": "r"}) == {"b": [{"x": 1}], "run_id": "*"}
    files.write_report(t, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j/manifest")).first()["n_rows"] == 2


def test_secrets(spark):
    long = "AbCdEfGhIjKlMnOp12ZaYbXcWd34"
    rows = [f"api_key={long}; the password is written in the vault", "/home/alice/Project2026/notes/Memory.md", f"{long[:14]}/{long[14:]}", "see http://u:pass@x.test/y", "nothing", None, "sk-" + "a1" * 10]
    got = [one(spark, x, text.has_secret) for x in rows]
    assert got == [True, False, True, True, False, False, True]
    found = one(spark, "the password is kept; api-key of it", text.secret_counts)
    assert [(x["class"], x["n"]) for x in found] == [("review-pointer", 2)]
    shown = one(spark, rows[0], lambda c: text.redacted(c, "content"))
    assert long not in shown and "[SECRET-LIKE field=content]" in shown


def test_streams(spark, tmp_path):
    from evidenza.streaming import jobs

    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    rows = [(i % 3, t + timedelta(minutes=i), i, "failed" if i % 3 == 0 else "done") for i in range(12)]
    spark.createDataFrame(rows, "job int, at timestamp, seq bigint, event string").coalesce(1).write.parquet(str(tmp_path / "log"))  # one file: they come in order
    out = jobs.drained(jobs.retry_transitions(jobs.file_stream(spark, str(tmp_path / "log"), 1)))
    last = {r["job"]: r["state"] for r in out.orderBy("seq").collect()}
    assert last == {0: "dead_letter", 1: "ready", 2: "ready"}
    jobs.batches_upserted(jobs.file_stream(spark, str(tmp_path / "log"), 1).select("job", "seq", "at"), str(tmp_path / "up"), lambda a, b: lifecycle.upserted(a.select("job", "seq", "at"), b.select("job", "seq", "at"), ["job"], ["seq"]))
    newest = max(int(p.name.split("=")[1]) for p in (tmp_path / "up").iterdir() if p.name.startswith("version="))
    got = spark.read.parquet(str(tmp_path / "up" / f"version={newest}")).groupBy("job").agg(F.max("seq").alias("s")).collect()
    assert {r["job"]: r["s"] for r in got} == {0: 9, 1: 10, 2: 11}
