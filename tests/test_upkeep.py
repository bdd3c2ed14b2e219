"""Recall, graph search, claims from texts, numbering and upkeep on small inputs with nulls, ties, repeats and empty tables."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evidenza.functions import text
from evidenza.operators import claims, evaluate, feedback, graph, history, lifecycle, recall, search
from evidenza.runtime import numbered
from evidenza.sources import files, migrate
from evidenza.streaming import jobs

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers_of_a_hot_group(spark):
    r = random.Random(1)
    rows = [("hot" if k % 3 else f"g{k % 7}", r.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    got = {(x["g"], x["id"]): x["n"] for x in numbered(df, ["g"], [F.desc("v"), "id"]).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        for n, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            want[g, x[2]] = n
    assert got == want
    assert numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_text_rules(spark):
    assert column(spark, ["Sure: {\"a\": 1} ok", "{\"a\": 1}", "none", None, "{broken", "x {1} y"], text.json_slice) == ["{\"a\": 1}", "{\"a\": 1}", None, None, None, None]
    urls = ["http://localhost:80/x", "https://u:p@10.1.2.3/x", "http://172.32.0.1", "http://172.16.0.1", "http://box.lan", "http://[::1]:9/", "https://example.test", "http://your-host.local", None, "no"]
    assert column(spark, urls, text.local_endpoint) == [True, True, False, True, True, True, False, False, False, False]
    assert column(spark, ["When did Ada use the old stove?", "who is it", None, ""], text.retrieval_words) == ["Ada use old stove", "who is it", None, ""]
    assert column(spark, ["Ada Quill moved the red stove", None, "the"], text.expansions) == [["Ada Quill", "Ada Quill moved red stove"], [], []]
    assert column(spark, ["it is 5 percent", "at 12:30 pm", "12:345", "nowhere", "right now", None], text.transient) == [True, True, False, False, True, False]
    assert column(spark, ["hello!", "what did we say", "", None, "ok?"], text.needs_memory) == [False, True, False, False, False]
    assert column(spark, ["We will go", "it might", "no longer", "plain", None], text.statement_kind) == ["decision", "proposal", "abandoned", "discussion", "discussion"]
    block = "type: note\ntags: [a, 'b c', ]\nempty:\ncreated: 2025-01-02"
    assert column(spark, [block], lambda c: text.frontmatter_tags(c)) == [["a", "b c"]] and column(spark, [block], lambda c: text.frontmatter_field(c, "empty")) == [None]


def test_claims_from_texts(spark):
    rows = [("a", "x", 0.9, T0, "Ada now prefers tea. Ada likes rain!"), ("b", "x", 0.9, T0 + timedelta(1), "Ada prefers coffee instead of tea."), ("c", "x", 0.9, None, None), ("d", "x", 0.9, T0, ""), ("e", "x", 0.9, T0, "General uses it. It rains. Bela works on roofs")]
    c = claims.projected(spark.createDataFrame(rows, "id string, agent string, confidence double, created_at timestamp, content string"))
    assert {(r["claim_id"], r["predicate"], r["object"]) for r in c.collect()} == {("a#0", "prefers", "tea"), ("a#1", "likes", "rain"), ("b#0", "prefers", "coffee instead of tea"), ("e#2", "works_on", "roofs")}
    df = spark.createDataFrame([("Ada prefers tea", None, "tea"), ("Ada prefers tea", "Tea.", "tea"), ("Ada switched to tea", "milk", "tea"), ("Ada prefers tea", "milk", "tea")], "s string, b string, o string")
    assert [r[0] for r in df.select(claims.text_conflict(F.col("s"), F.col("b"), F.col("o"))).collect()] == ["compatible", "duplicate", "update", "unresolved"]


def test_raises_against_a_plain_sequence(spark):
    r = random.Random(4)
    rows = [(f"m{k:02d}", "x" if k % 4 else "y", T0 + timedelta(minutes=r.randrange(30)), r.choice([None, 0.2, 0.93, 0.0])) for k in range(40)]
    linked = {i: sorted({f"e{r.randrange(9)}" for _ in range(r.randrange(0, 8))}) for i, *_ in rows}
    m = spark.createDataFrame(rows, "id string, agent string, created_at timestamp, trust double")
    links = spark.createDataFrame([(i, e) for i, es in linked.items() for e in es] + [("m99", "e1")], "memory_id string, entity_id string")
    got = {x["id"]: round(x["boosted"], 6) for x in lifecycle.corroborated(m, links).collect()}
    trust, stored = {i: t or 0.5 for i, _, _, t in rows}, []
    for i, agent, at, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        others = {j for j, a in stored if a == agent and set(linked[i][:5]) & set(linked[j])}
        for j in [*others, *([i] if others else [])]:
            trust[j] = min(trust[j] + 0.05, 0.95)
        stored.append((i, agent))
    assert got == {i: round(t, 6) for i, t in trust.items()}


def test_names_and_relations(spark):
    docs = spark.createDataFrame([(1, "The Old Mill uses Ada Quill. Ada Quill and Bela went. Ada slept. Monday came."), (2, None), (3, ""), (4, "Every Ada Quill")], "id int, t string")
    got = [(r["id"], r["name"], r["rank"]) for r in graph.entity_mentions(docs, "id", "t").orderBy("id", "rank").collect()]
    assert got == [(1, "Old Mill", 1), (1, "Ada Quill", 2), (1, "Bela", 3), (4, "Ada Quill", 1)]
    edges = {(r["name_a"], r["name_b"]): r["relation"] for r in graph.sentence_edges(docs, "id", "t").collect()}
    assert edges == {("ada quill", "old mill"): "uses", ("ada quill", "bela"): "co_occurs"}
    assert column(spark, ["api box", "Ada", None], graph.entity_type) == ["service", None, None]


def test_graph_search(spark):
    memories = spark.createDataFrame([("m1", "x", "active", T0), ("m2", "x", "active", None), ("m3", "x", "forgotten", T0), ("m4", "y", "active", T0), ("m5", "x", "active", T0 + timedelta(1))], "id string, agent string, status string, updated_at timestamp")
    links = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "b"), ("m2", "c"), ("m5", "d"), ("m5", "c"), ("m3", "z"), ("m3", "a"), ("m4", "a"), ("m4", "q")], "memory_id string, entity_id string")
    entities = spark.createDataFrame([("a", "x", "ada"), ("z", "x", "zoe"), ("q", "y", "quill")], "id string, agent string, name_key string")
    ask = spark.createDataFrame([(1, "x", "ada"), (2, "x", "zoe"), (3, "x", "quill"), (4, "x", "none")], "query_id int, agent string, name_key string")
    got = [(r["query_id"], r["id"], r["rank"]) for r in graph.searched(ask, entities, links, memories).orderBy("query_id", "rank").collect()]
    assert got == [(1, "m5", 1), (1, "m1", 2), (1, "m2", 3)]  # an entity of forgotten or other agents' memories alone is no seed
    assert graph.searched(ask, entities, links.limit(0), memories).count() == 0


def test_recall_keeps_to_the_owner(spark):
    m = spark.createDataFrame([("a", "x", "private", "note", None, None, "copper kettle boils", ["stove"]), ("b", "y", "private", "note", None, None, "copper kettle boils", None), ("c", "x", "fleet", "note", None, None, "copper kettle boils", []), ("d", "x", "shared", "vault", None, "in/kettle", "copper kettle", ["boils"]), ("e", "x", None, "vault", None, "out", "copper kettle boils", None), ("f", "x", "private", None, None, None, None, None)],
                              "id string, agent string, visibility string, source string, type string, source_id string, content string, tags array<string>")
    q = spark.createDataFrame([("q", "x", ["kettle", "boils"]), ("r", "z", ["kettle"]), ("s", "x", ["stove"])], "query_id string, owner string, terms array<string>")
    got = {(r["query_id"], r["id"]) for r in recall.keyword_lane(m, q, paths=["in"]).collect()}
    assert got == {("q", "a"), ("q", "d"), ("s", "a")}
    said = spark.createDataFrame([("Copper  kettle boils!",), (None,)], "content string")
    assert {r["id"] for r in recall.unsaid(m.where("content IS NOT NULL"), said).collect()} == {"d"}


def test_vectors_meet_in_blocks(spark, monkeypatch):
    """Many blocks, with the shuffled form as well, against every pair compared."""
    r = random.Random(3)
    rows = [(f"v{k:03d}", "m" if k % 5 else "n", [r.gauss(0, 1) for _ in range(4)]) for k in range(300)]
    v = spark.createDataFrame(rows, "id string, g string, v array<double>")
    q = v.where("substring(id, 4, 1) = '7'").select(F.col("id").alias("query_id"), "g", F.col("v").alias("vec"))
    norm = lambda x: sum(c * c for c in x) ** 0.5
    want = set()
    for i, g, x in rows:
        if i[3] == "7":
            near = sorted(((-sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), j) for j, h, y in rows if h == g and j != i))[:5]
            want |= {(i, j) for s, j in near if -s >= 0.3}
    monkeypatch.setattr(search, "BLOCK", 16)
    for size in (64 << 20, 0):
        monkeypatch.setattr(search, "BROADCAST_BYTES", size)
        assert {(x["query_id"], x["id"]) for x in search.semantic(v, "id", "v", q, 5, 0.3, ["g"]).collect()} == want


def test_pages(spark):
    df = spark.createDataFrame([(k,) for k in range(7)], "id int")
    for size, want in ((3, [(0, True), (1, True), (2, True)]), (7, [(k, False) for k in range(7)])):
        assert [(r["id"], r["has_more"]) for r in history.page(df, ["id"], size).orderBy("id").collect()] == want
    assert history.page(df.limit(0), ["id"], 3).count() == 0


def test_jobs_are_forgotten(spark, tmp_path):
    rows = [("a", T0, 1, "failed"), ("a", T0 + timedelta(minutes=1), 2, "done"), ("a", T0 + timedelta(minutes=2), 3, "failed"), ("b", T0, 4, "claimed")]
    spark.createDataFrame(rows, "job string, at timestamp, seq bigint, event string").coalesce(1).write.parquet(str(tmp_path / "log"))
    got = jobs.drained(jobs.retry_transitions(jobs.file_stream(spark, str(tmp_path / "log"))))
    assert {(r["seq"], r["state"]) for r in got.collect()} == {(1, "retry_wait"), (2, "ready"), (4, "running")}


def test_names_and_aliases(spark):
    entities = spark.createDataFrame([("e1", "x", "Old Mill", ["The Mill", "the mill", ""]), ("e2", None, "old mill", None), ("e3", None, "Kiln", []), ("e4", "y", "Mill", None), ("e5", "x", " ", ["Mill"])], "id string, agent string, name string, aliases array<string>")
    links = spark.createDataFrame([("m1", "e3"), ("m2", "e2")], "memory_id string, entity_id string")
    memories = spark.createDataFrame([("m1", "x"), ("m2", "x")], "id string, agent string")
    got = {(r["agent"], r["key"]): r["id"] for r in graph.named(entities, links, memories).collect()}
    assert got == {("x", "old mill"): "e1", ("x", "the mill"): "e1", ("x", "kiln"): "e3", ("y", "mill"): "e4", ("x", "mill"): "e5"}
    edges = spark.createDataFrame([("x", "e1", "e3")], "agent string, entity_a string, entity_b string")
    ask = spark.createDataFrame([(1, "x", ["go to the mill", "the mill"]), (2, "x", ["nothing"]), (3, "y", ["Mill"]), (4, "x", [])], "query_id int, agent string, phrases array<string>")
    out = graph.expanded(ask, graph.named(entities, links, memories), entities, edges).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["name"]) for r in out] == [(1, "Old Mill"), (1, "Kiln"), (3, "Mill")]


def test_moments_and_identities(spark):
    got = column(spark, ["2025-01-02T03:04:05Z", "2025-01-02 03:04:05+02:00", "2025-01-02", "on 2025-01-02", None, "2025-13-02T00:00:00Z"], lambda c: F.unix_seconds(text.iso_time(c)))
    assert got == [1735787045, 1735779845, 1735776000, None, None, None]
    same = column(spark, ["Ada prefers tea.", "Ada  now prefers Tea", "Ada prefers milk", "Ada sleeps", None], lambda c: text.claim_identity(F.lit("Ada"), c))
    assert same[0] != same[2] and same[0] != same[3]
    assert column(spark, ["Ada prefers tea.", "Ada now prefers Tea!"], lambda c: text.claim_identity(F.lit("Ada"), c))[0] == column(spark, ["Ada now prefers Tea!"], lambda c: text.claim_identity(F.lit("Ada"), c))[0]


def test_older_tables(spark):
    rows = spark.createDataFrame([("m1", "old"), ("m9", "old"), (None, "old")], "memory_id string, agent string")
    memories = spark.createDataFrame([("m1", "x")], "id string, agent string")
    got = migrate.with_columns(migrate.re_owned(rows, "memory_id", memories), {"strength": ("double", 1.0), "agent": ("string", "no")}).collect()
    assert sorted((r["agent"], r["strength"]) for r in got) == [("", 1.0), ("", 1.0), ("x", 1.0)]
    facts = spark.createDataFrame([(1, None, None), (2, True, None), (3, False, "Hypothetical"), (4, False, "asserted")], "id int, discard boolean, modality string")
    assert [r["id"] for r in migrate.kept_facts(facts).orderBy("id").collect()] == [1, 4]


def test_packed_vectors_round_trip(spark):
    rows = [(1, [0.5, -2.0, 1e-3]), (2, None), (3, []), (4, [float("nan")]), (5, [None, 1.0])]
    got = {r["k"]: r["packed"] for r in migrate.packed(spark.createDataFrame(rows, "k int, v array<float>"), "k", "v").collect()}
    assert migrate.unpacked(bytes(got[1])) == pytest.approx([0.5, -2.0, 1e-3]) and {k for k, v in got.items() if v is None} == {2, 3, 4, 5}
    with pytest.raises(ValueError):
        migrate.unpacked(b"abc")
    assert migrate.unpacked(None) is None


def test_utilities_by_kind(spark):
    s = spark.createDataFrame([("m", "a", 1, 1.0, True, T0), ("m", "b", -1, 2.0, False, T0)], "memory_id string, kind string, direction int, weight double, explicit boolean, created_at timestamp")
    got = {r["kind"]: (r["pos"], r["neg"]) for r in feedback.mixed(s, "memory_id", "kind", F.lit("2025-01-01 00:00:00").cast("timestamp")).collect()}
    assert got == {"a": (pytest.approx(1.25), pytest.approx(0.5)), "b": (pytest.approx(0.25), pytest.approx(2.5))}


def test_scenarios(spark, tmp_path):
    turn = lambda label, user: {"user": user, "assistant": "", "label": label}
    case = lambda i, ask, stale=None: {"schema_version": 1, "case_id": i, "persona": "p", "category": "historical_query", "sessions": [{"observed_at": "2025-01-01T00:00:00Z", "turns": [turn("new", "The copper kettle is in the shed"), turn("old", "The tin kettle was sold"), turn("x", "Nothing of note")]}],
                                       "query": {"text": ask, "at": "2025-01-02T00:00:00Z"}, "expected": {"supporting_memory_labels": ["new"], "stale_memory_labels": stale or []}}
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in [case("a", "Where is the copper kettle?"), case("b", "Where is the kettle?", ["old"]), case("c", "Where is the pan?")]))
    good, bad = files.cases(spark, str(tmp_path / "c.jsonl"))
    got = {r["query_id"]: (r["recall_5"], r["stale"], r["passed"]) for r in evaluate.scenarios(good).collect()}
    assert bad.count() == 0 and got == {"a": (1.0, 0, True), "b": (1.0, 1, False), "c": (0.0, 0, False)}


def test_upsert_by_buckets(spark, tmp_path):
    rows = [(k % 7, T0 + timedelta(minutes=k), k) for k in range(30)]
    for part in range(5):  # files come one a batch
        spark.createDataFrame(rows[part * 6 : part * 6 + 6], "k int, at timestamp, seq bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    jobs.buckets_upserted(jobs.file_stream(spark, str(tmp_path / "log"), 1), str(tmp_path / "t"), ["k"], ["seq"], 4)
    got = {r["k"]: r["seq"] for r in jobs.newest(spark, str(tmp_path / "t")).collect()}
    assert got == {k: max(s for j, _, s in rows if j == k) for k in range(7)}
    assert jobs.newest(spark, str(tmp_path / "none")) is None
