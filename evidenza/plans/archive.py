"""Queries on the graph, the conversation archive, feedback, health, documents and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidenza.functions import text
from evidenza.operators import consolidate, evaluate, feedback, graph, health, history, lifecycle, vault
from evidenza.plans.sql import KEY, LINK_CTE, MEM, MEM_CTE, MSG_CTE, SES_CTE, SIG_CTE, TOKENS, TURN_CTE
from evidenza.runtime import numbered, table
from evidenza.sources import tables

NOW_EVENTS = "2024-02-01 00:00:00"


# graph
def entity_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir).where("status = 'active'").select(F.col("id").alias("memory_id"))
    n = tables.links(spark, sf_dir).join(m, "memory_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "entity_id").limit(10)


def sighting_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "memory_entities").where("entity_id IS NOT NULL AND memory_id IS NOT NULL")
    return graph.promoted(raw, ["entity_id", "agent"], "memory_id", 3)


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrences(tables.links(spark, sf_dir))


def graph_bfs_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.cooccurrences(tables.links(spark, sf_dir)).where("strength >= 3")
    seeds = table(spark, sf_dir, "entities").select("id").distinct().orderBy("id").limit(20).select(F.col("id").alias("seed"))
    return graph.reachable(edges, seeds, 2)


def graph_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.noise(tables.latest(table(spark, sf_dir, "entities"), "id", "name"), tables.links(spark, sf_dir), 2)


def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").select("id").distinct().join(tables.links(spark, sf_dir).select(F.col("entity_id").alias("id")), "id", "left_anti")


def orphan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.links(spark, sf_dir).join(tables.memories(spark, sf_dir).select(F.col("id").alias("memory_id")), "memory_id", "left_anti")


def relation_upsert_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "memory_entities").where("memory_id IS NOT NULL AND entity_id IS NOT NULL")
    role = F.when(F.col("relation_role") == "subject", 1.0).when(F.col("relation_role") == "object", 0.7).otherwise(0.4)
    return graph.strongest(e.withColumn("s", role), ["entity_id", "agent"], "s")


def relation_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many relations of names within one sentence are of which type."""
    e = graph.sentence_edges(tables.memories(spark, sf_dir).where("content IS NOT NULL"), "id", "content")
    return e.groupBy("relation").agg(F.count("*").alias("n_pairs"), F.countDistinct("id").alias("n_memories"))


def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir).where("content IS NOT NULL")
    return graph.entity_mentions(m, "id", "content").select("id", "name", "rank")


def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").where("name IS NOT NULL").withColumns({"name_key": text.entity_key(F.col("name")), "agent": F.coalesce("agent", F.lit("")), "n": F.lit(1)})
    return graph.resolved(e, ["agent", "name_key"]).select("agent", "name_key", "entity_id")


# history
_START, _END = "2025-02-01 00:00:00", "2025-03-01 00:00:00"


def session_candidates_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.candidates(tables.sessions(spark, sf_dir), tables.messages(spark, sf_dir), _START, _END, ("2025-01-25 00:00:00", "")).select("id", "started_at")


def message_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.messages(spark, sf_dir)
    anchors = g.where(history.visible_message() & (F.col("id") % 20 == 0)).select(F.col("id").alias("anchor"))
    return history.windows(g, anchors)


def session_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.sample(tables.messages(spark, sf_dir))


def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.round_robin(tables.messages(spark, sf_dir).where("timestamp IS NOT NULL"))


def history_terms_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.matching(tables.messages(spark, sf_dir), ["lantern", "kettle"]).select("session_id", "id")


def matching_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.matching(tables.messages(spark, sf_dir), ["lantern", "kettle"]).groupBy("session_id").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("lantern")))
    return d.select("doc_id", F.md5(text.excerpt(F.col("text"), F.lit("lantern"))).alias("excerpt_md5"))


def session_version_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.version_digest(tables.messages(spark, sf_dir))


def unextracted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are neither done nor the source of a memory."""
    m = tables.memories(spark, sf_dir).where("source_id IS NOT NULL").select(F.col("source_id").alias("key"))
    t = tables.turns(spark, sf_dir).where("coalesce(extraction_status, '') <> 'done'").withColumn("key", F.col("id").cast("string"))
    return t.join(m, "key", "left_anti").select("id", "extraction_status")


def pending_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's newest three turns that aren't extracted yet, while they fit 4,000 characters together."""
    t = tables.turns(spark, sf_dir).where("coalesce(extraction_status, '') <> 'done' AND session_id IS NOT NULL")
    w = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    size = F.length(F.coalesce("user_text", F.lit(""))) + F.length(F.coalesce("assistant_text", F.lit("")))
    t = t.withColumn("n", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where("n <= 3 AND used <= 4000").select("session_id", "id", "n", "used")


# feedback
def utility_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = feedback.utilities(tables.signals(spark, sf_dir), ["agent", "memory_id"], F.lit(NOW_EVENTS).cast("timestamp"))
    return u.select("agent", "memory_id", "n", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "mean", "confidence", "harm")])


def utility_rank_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = feedback.utilities(tables.signals(spark, sf_dir), ["memory_id"], F.lit(NOW_EVENTS).cast("timestamp"))
    r = u.select("memory_id", ((F.col("memory_id") % 97) / 97.0).alias("score"))
    return feedback.adjusted(r, u, "memory_id").select("memory_id", F.round("adjusted", 6).alias("adjusted"))


def pair_synergy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.synergies(tables.signals(spark, sf_dir), ["user_id"], "memory_id").select("a", "b", F.round("synergy", 6).alias("synergy"), F.round("confidence", 6).alias("confidence"))


def signal_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.signals(spark, sf_dir)
    return s.groupBy(F.to_date("created_at").alias("day"), "agent", "signal_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"), F.max("weight").alias("top"))


def receipt_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    return feedback.closed_receipts(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id")


def retention_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.kept_newest(tables.signals(spark, sf_dir), ["agent"], [F.desc("created_at"), F.desc("id")], 50).select("agent", "id")


def sampling_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(text.sampled(F.col("event_id").cast("string"), 0.05)).select("event_id")


def retry_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "claimed").otherwise("enqueued")
    return feedback.job_states(e.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("event")), "user_id")


# health
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).groupBy("status", "type").agg(F.count("*").alias("n"), F.count_if("verified").alias("n_verified"))


def operation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    return health.operation_stats(e, ["event_type"], "value", "failed")


def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.95, 0.99], 1000, [F.desc("ts"), F.desc("event_id")])


def coverage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir).select("id")
    v = table(spark, sf_dir, "memory_vectors").where("embedding IS NOT NULL").select(F.col("memory_id").alias("id"), F.lit(1).alias("v")).distinct()
    e = tables.links(spark, sf_dir).select(F.col("memory_id").alias("id"), F.lit(1).alias("e")).distinct()
    return m.join(v, "id", "left").join(e, "id", "left").agg(F.count("*").alias("n"), F.round(F.try_divide(F.count("v"), F.count("*")), 6).alias("embedded"), F.round(F.try_divide(F.count("e"), F.count("*")), 6).alias("linked"))


def pending_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.turns(spark, sf_dir)
    done = F.coalesce("extraction_status", F.lit("")) == "done"
    return t.agg(F.min(F.when(~done, F.col("created_at"))).alias("oldest_pending"), F.max(F.when(done, F.col("id"))).alias("last_done"), F.count_if(~done).alias("n_pending"))


def hygiene_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of agent-1's active memories looks like a credential or points to one."""
    m = tables.memories(spark, sf_dir).where("status = 'active' AND agent = 'agent-1'").withColumn("tags", F.array_join("tags", " "))
    return health.findings(m, "id", ["content", "metadata", "source_id", "tags"]).withColumn("excerpt", F.md5("excerpt"))


def approval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved changes to memories in order of id: a stale hash stops the batch."""
    m = tables.memories(spark, sf_dir).where("content IS NOT NULL")
    return health.first_conflict(m.withColumn("stale", F.col("content_hash").isNull()), "id", "stale").select("id", "state")


# documents
def passage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.passages(table(spark, sf_dir, "documents"), "doc_id", "text")


def frontmatter_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", text.frontmatter(F.col("text")).isNotNull().alias("has_frontmatter"), text.title(F.col("text"), F.col("path")).alias("title"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of even and odd creation days as two snapshots of the vault."""
    d = table(spark, sf_dir, "documents").where("path IS NOT NULL AND agent IS NOT NULL").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    one = lambda p: d.where(F.col("doc_id") % 2 == p).groupBy("agent", "path").agg(F.max_by("hash", "doc_id").alias("hash"))
    return vault.snapshot_diff(one(0), one(1), ["agent", "path"], "hash")


def memory_file_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of memory files: bullet and numbered lines outside frontmatter, headings and fenced code."""
    from evidenza.sources.files import entry_lines

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return entry_lines(d, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


# consolidation and evaluation
def dream_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest shareable memories beside the 500 newest, of one agent and model."""
    v = table(spark, sf_dir, "memory_vectors").where(F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions"))).groupBy("memory_id", "model").agg(F.min("embedding").alias("vec"))
    m = tables.memories(spark, sf_dir).where("status = 'active' AND visibility IN ('shared', 'fleet')").join(v.select(F.col("memory_id").alias("id")), "id", "left_semi").select(F.col("id").alias("memory_id"), "agent", "created_at")
    newest = [F.desc_nulls_last("created_at"), "memory_id"]
    corpus, recent = m.orderBy(*newest).limit(500), m.orderBy(*newest).limit(200)
    rows = v.join(corpus.select("memory_id", "agent"), "memory_id")
    return consolidate.candidate_pairs(rows, "memory_id", "vec", recent, 0.6, 5, 30, ["model", "agent"]).withColumn("similarity", F.round("similarity", 6))


def same_fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each superseding memory merged with those that it supersedes."""
    m = tables.memories(spark, sf_dir)
    members = m.where("superseded_by IS NOT NULL AND superseded_by <> id").withColumn("merged_id", F.col("superseded_by"))
    targets = m.withColumn("merged_id", F.col("id")).join(members.select("merged_id"), "merged_id", "left_semi")
    out = lifecycle.merged(members.unionByName(targets), "merged_id", "id", "content", "tags", "created_at")
    return out.select("merged_id", F.md5("content").alias("content_md5"), F.size("tags").alias("n_tags"), F.col("n").cast("int").alias("n"))


def edit_event_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories after edits derived from events: each event edits the memory of its agent and number."""
    m = numbered(tables.memories(spark, sf_dir), ["agent"], ["id"])
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("agent-"), (F.col("user_id") % 8).cast("string")).alias("agent"), (F.col("event_id") % 40 + 1).alias("n"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), "event_type")
    e = e.join(m.select("agent", "n", "id"), ["agent", "n"])
    action = F.when(F.col("event_type") == "error", "forget").when(F.col("event_type") == "signup", "restore").when(F.col("event_type") == "view", "share").when(F.col("event_type") == "purchase", "unshare").otherwise("feedback")
    e = e.select("id", "at", "seq", action.alias("action"), F.when(F.col("seq") % 3 == 0, -0.2).otherwise(0.1).alias("amount"))
    return lifecycle.edited(m.select("id", "status", "visibility", "trust"), e).withColumn("trust", F.round("trust", 6))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidenza.plans.retrieval import semantic_topk

    e = table(spark, sf_dir, "embeddings")
    judged = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id <> id").select("query_id", "id")
    return evaluate.ranking_metrics(semantic_topk(spark, sf_dir), judged)


def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("category"))
    return evaluate.by_category(retrieval_metrics(spark, sf_dir).join(e, "query_id"), "category", ["recall_5", "mrr", "ndcg_5"])


# batch twins of the streams
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp").alias("start"), "event_type", "n", "total")


def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "30 minutes", "10 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp").alias("start"), "n")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


QUERIES = {f.__name__: f for f in (
    entity_link_counts, sighting_gate, cooccurrence_edges, graph_bfs_2hop, graph_noise, orphan_entities, orphan_links, relation_upsert_max, relation_typing, entity_extract, entity_resolve,
    session_candidates_keyset, message_window, session_sample, round_robin_sample, history_terms_search, matching_sessions, excerpt_window, session_version_digest, unextracted_turns, pending_overlay,
    utility_aggregate, utility_rank_adjust, pair_synergy, signal_daily_rollup, receipt_close, retention_newest, sampling_hash, retry_state_machine,
    health_counts, operation_stats, percentile_nearest_rank, coverage_ratios, pending_watermark, hygiene_findings, approval_conflicts,
    passage_windows, frontmatter_title, snapshot_diff, memory_file_parse, dream_candidate_pairs, same_fact_merge, edit_event_reduce, retrieval_metrics, metrics_by_category, tumbling_events, sliding_events, session_events,
)}

_VIS = "(coalesce(active, true) OR coalesce(compacted, false)) AND coalesce(display_kind, '') <> 'hidden' AND NOT coalesce(_compressed_summary, false) AND coalesce(role IN ('user', 'assistant'), false)"
_SEEN = f"WITH {MSG_CTE}, v AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp NULLS FIRST, id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC NULLS LAST, id DESC) AS back FROM g WHERE {_VIS} AND session_id IS NOT NULL)"
_EDGES = "e AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS k, min(x.memory_id) AS f FROM k x JOIN k y ON x.memory_id = y.memory_id AND x.entity_id < y.entity_id GROUP BY 1, 2)"
_LINKED = f"WITH RECURSIVE {LINK_CTE}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY entity_id) AS r FROM l) WHERE r <= 15), {_EDGES}"
_UTIL = f"""WITH {SIG_CTE}, w AS (SELECT *, weight * pow(0.5, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 86400000000.0 / 90) AS d FROM g),
u AS (SELECT @KEY, count(*) AS n, sum(CASE WHEN direction > 0 THEN d ELSE 0 END) AS pos, sum(CASE WHEN direction < 0 THEN d ELSE 0 END) AS neg FROM w GROUP BY @KEY)"""
_HAS = f"list_has_any({TOKENS('content')}, ['lantern', 'kettle'])"
_METRICS = """, j AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
h AS (SELECT j.query_id, count(*) AS n, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) FILTER (WHERE rank <= 3) AS h3, count(*) FILTER (WHERE rank <= 5) AS h5, min(rank) AS f, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
      FROM j LEFT JOIN sem USING (query_id, id) GROUP BY 1),
x AS (SELECT query_id, round(h1 / n, 6) AS recall_1, round(h3 / n, 6) AS recall_3, round(h5 / n, 6) AS recall_5, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(5, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_5 FROM h)"""


def _sem() -> str:
    from evidenza.plans.retrieval import _SEM

    return "WITH " + _SEM + _METRICS


# No text of the tables holds a literal credential, so an excerpt is the text itself.
_ASSIGN = r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\"'']?\s*(?:=|:|is)\s*[\"'']?[A-Za-z0-9+/_.-]{6,}"
_SECRET_ROWS = "r AS (" + " UNION ALL ".join([
    *[f"SELECT *, 'secret-like' AS class, '{n}' AS subclass, len(regexp_extract_all(x, '{p}')) AS n FROM f WHERE x IS NOT NULL" for n, p in (("assignment", _ASSIGN), ("key", "sk-[A-Za-z0-9]{16,}"), ("credentials", "://[^/ :@]+:[^/ @]+@"))],
    "SELECT *, 'secret-like', 'token', len(list_filter(regexp_extract_all(x, '[A-Za-z0-9_+/=-]{24,}'), lambda w: regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') AND NOT starts_with(w, '/'))) FROM f WHERE x IS NOT NULL",
    rf"SELECT *, 'review-pointer', 'pointer', greatest(0, len(regexp_extract_all(x, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:passwords?|passwd|secrets?|api[ _-]?keys?|credentials?)')) - len(regexp_extract_all(x, '{_ASSIGN}'))) FROM f WHERE x IS NOT NULL",
]) + ")"
ORACLE = {
    "entity_link_counts": MEM + f", {LINK_CTE} SELECT entity_id, count(*) AS n FROM l WHERE memory_id IN (SELECT id FROM m WHERE status = 'active') GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 10",
    "sighting_gate": "SELECT entity_id, agent, count(DISTINCT memory_id) AS n FROM memory_entities WHERE entity_id IS NOT NULL AND memory_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT memory_id) >= 3",
    "cooccurrence_edges": _LINKED + " SELECT a AS entity_a, b AS entity_b, k AS strength, f AS first_group FROM e",
    "graph_bfs_2hop": _LINKED + """, b2 AS (SELECT a, b FROM e WHERE k >= 3 UNION SELECT b, a FROM e WHERE k >= 3), s AS (SELECT DISTINCT id FROM entities ORDER BY id LIMIT 20),
      r(seed, node, hops) AS (SELECT id, id, 0 FROM s UNION SELECT r.seed, b2.b, r.hops + 1 FROM r JOIN b2 ON b2.a = r.node WHERE r.hops < 2) SELECT seed, node, min(hops) AS hops FROM r GROUP BY 1, 2""",
    "graph_noise": f"""WITH {LINK_CTE}, n AS (SELECT entity_id, count(*) AS k FROM l GROUP BY 1), e AS (SELECT id, any_value(trim(coalesce(name, ''), ' ')) AS name FROM entities WHERE id IS NOT NULL GROUP BY id)
      SELECT id, reason FROM (SELECT id, CASE WHEN name = '' THEN 'empty' WHEN len(name) <= 2 THEN 'short' WHEN NOT regexp_matches(name, '[A-Za-z]') THEN 'no letters' WHEN lower(name) IN ({', '.join(repr(w) for w in graph.NO_NAMES)}) THEN 'common word' WHEN coalesce(k, 0) < 2 THEN 'few links' END AS reason
      FROM e LEFT JOIN n ON n.entity_id = e.id) WHERE reason IS NOT NULL""",
    "orphan_entities": "SELECT DISTINCT id FROM entities WHERE id NOT IN (SELECT entity_id FROM memory_entities WHERE entity_id IS NOT NULL AND memory_id IS NOT NULL)",
    "orphan_links": f"WITH {LINK_CTE} SELECT memory_id, entity_id FROM l WHERE memory_id NOT IN (SELECT id FROM memories WHERE id IS NOT NULL)",
    "relation_upsert_max": "SELECT entity_id, agent, max(CASE relation_role WHEN 'subject' THEN 1.0 WHEN 'object' THEN 0.7 ELSE 0.4 END)::DOUBLE AS strength, count(*) AS n_evidence FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2",
    "entity_resolve": r"""SELECT agent, name_key, 'ent-' || sha256(agent || '|' || name_key)[1:12] AS entity_id FROM (SELECT DISTINCT coalesce(agent, '') AS agent, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}. ]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS name_key FROM entities WHERE name IS NOT NULL)""",
    "session_candidates_keyset": f"""WITH {MSG_CTE}, {SES_CTE} SELECT id, started_at FROM s WHERE NOT coalesce(hidden, false) AND NOT coalesce(source IN ('kanban', 'subagent', 'tool'), false) AND started_at >= TIMESTAMPTZ '2025-01-25 00:00:00+00'
      AND id IN (SELECT session_id FROM g WHERE {_VIS} AND timestamp >= TIMESTAMPTZ '{_START}+00' AND timestamp < TIMESTAMPTZ '{_END}+00')""",
    "message_window": _SEEN + " SELECT a.id AS anchor, b.id, (b.n - a.n)::INT AS \"offset\" FROM v a JOIN v b ON a.session_id = b.session_id AND b.n BETWEEN a.n - 2 AND a.n + 2 WHERE a.id % 20 = 0",
    "session_sample": _SEEN + " SELECT session_id, id, n AS position FROM v WHERE n <= 3 OR back <= 3",
    "round_robin_sample": _SEEN.replace("AND session_id IS NOT NULL)", "AND session_id IS NOT NULL AND timestamp IS NOT NULL)") + " SELECT v.session_id, id, n AS turn FROM v JOIN (SELECT session_id, min(timestamp) AS began FROM v GROUP BY 1) f USING (session_id) ORDER BY n, began, v.session_id LIMIT 80",
    "history_terms_search": _SEEN.replace(" AND session_id IS NOT NULL)", ")") + f" SELECT session_id, id FROM v WHERE {_HAS}",
    "matching_sessions": _SEEN.replace(" AND session_id IS NOT NULL)", ")") + f" SELECT session_id, min(id) AS first_id, count(*) AS n FROM v WHERE {_HAS} GROUP BY 1",
    "excerpt_window": "SELECT doc_id, md5(substring(text, greatest(1, instr(lower(text), 'lantern') - 1000)::BIGINT, 2001)) AS excerpt_md5 FROM documents WHERE contains(lower(text), 'lantern')",
    "session_version_digest": _SEEN + """, p AS (SELECT session_id, count(*) AS n, max(id) AS last, sum(('0x' || sha256(id || '|' || coalesce(role, '') || '|' || coalesce(content, ''))[1:12])::HUGEINT) AS mark FROM v GROUP BY 1)
      SELECT session_id, n, sha256(n || '|' || last || '|' || mark) AS version FROM p""",
    "unextracted_turns": MEM + f", {TURN_CTE} SELECT id, extraction_status FROM t WHERE coalesce(extraction_status, '') <> 'done' AND id::VARCHAR NOT IN (SELECT source_id FROM m WHERE source_id IS NOT NULL)",
    "pending_overlay": f"""WITH {TURN_CTE} SELECT session_id, id, n, used::BIGINT AS used FROM (SELECT session_id, id, row_number() OVER w AS n, sum(len(coalesce(user_text, '')) + len(coalesce(assistant_text, ''))) OVER (w ROWS UNBOUNDED PRECEDING) AS used
      FROM t WHERE coalesce(extraction_status, '') <> 'done' AND session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id DESC)) WHERE n <= 3 AND used <= 4000""",
    "utility_aggregate": _UTIL.replace("@KEY", "agent, memory_id") + " SELECT agent, memory_id, n, round(pos, 6) AS pos, round(neg, 6) AS neg, round((2 + pos) / (4 + pos + neg), 6) AS mean, round(1 - exp(-(pos + neg) / 10), 6) AS confidence, round(CASE WHEN pos + neg > 0 THEN neg / (pos + neg) ELSE 0 END, 6) AS harm FROM u",
    "utility_rank_adjust": _UTIL.replace("@KEY", "memory_id") + " SELECT memory_id, round((memory_id % 97) / 97.0::DOUBLE + CASE WHEN pos + neg >= 3 THEN greatest(-0.15, least(0.15, 0.15 * (1 - exp(-(pos + neg) / 10)) * 2 * ((2 + pos) / (4 + pos + neg) - 0.5))) ELSE 0 END, 6) AS adjusted FROM u",
    "pair_synergy": f"""WITH {SIG_CTE}, p AS (SELECT *, lead(memory_id) OVER (PARTITION BY user_id ORDER BY created_at, id) AS nx FROM g), q AS (SELECT least(memory_id, nx) AS a, greatest(memory_id, nx) AS b, sum(CASE WHEN direction > 0 THEN weight ELSE 0 END) AS pos, sum(CASE WHEN direction < 0 THEN weight ELSE 0 END) AS neg
      FROM p WHERE nx IS NOT NULL AND nx <> memory_id GROUP BY 1, 2) SELECT a, b, round((pos - neg) / greatest(1, pos + neg), 6) AS synergy, round(1 - exp(-(pos + neg) / 6), 6) AS confidence FROM q""",
    "signal_daily_rollup": f"WITH {SIG_CTE} SELECT created_at::DATE AS day, agent, signal_type, count(*) AS n, round(sum(weight), 6) AS total, max(weight) AS top FROM g GROUP BY 1, 2, 3",
    "receipt_close": "SELECT c.event_id AS closing_id, arg_max(o.event_id, (o.ts, o.event_id)) AS opened_id FROM events c JOIN events o ON c.user_id = o.user_id AND o.event_type = 'view' AND c.event_type = 'purchase' AND o.ts <= c.ts AND c.ts - o.ts <= INTERVAL 300 SECOND GROUP BY 1",
    "retention_newest": f"WITH {SIG_CTE} SELECT agent, id FROM (SELECT agent, id, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id DESC) AS r FROM g) WHERE r <= 50",
    "sampling_hash": "SELECT event_id FROM events WHERE ('0x' || sha256(event_id::VARCHAR)[1:13])::BIGINT / pow(16, 13) < 0.05",
    "retry_state_machine": """WITH l AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'claimed' ELSE 'enqueued' END AS e FROM events),
      s AS (SELECT user_id, arg_max(e, (ts, event_id)) AS e, count(*) FILTER (WHERE e = 'failed') AS failures FROM l GROUP BY 1), z AS (SELECT user_id, CASE WHEN e = 'done' THEN 'ready' WHEN e = 'failed' AND failures >= 3 THEN 'dead_letter' WHEN e = 'failed' THEN 'retry_wait' WHEN e = 'claimed' THEN 'running' ELSE 'pending' END AS state, failures FROM s)
      SELECT user_id, state, failures, CASE WHEN state = 'retry_wait' THEN least(300.0, pow(2, failures - 1)) END AS wait_s FROM z""",
    "health_counts": MEM + " SELECT status, type, count(*) AS n, count(*) FILTER (WHERE verified) AS n_verified FROM m GROUP BY 1, 2",
    "operation_stats": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) FILTER (WHERE event_type = 'error') AS n_failed FROM events GROUP BY 1",
    "percentile_nearest_rank": """WITH r AS (SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1000),
      k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r) SELECT event_type, s.share::DOUBLE AS share, value FROM k, (VALUES (0.5), (0.95), (0.99)) s(share) WHERE i = round_even((n - 1) * s.share::DOUBLE, 0)""",
    "coverage_ratios": MEM + f", {LINK_CTE} SELECT count(*) AS n, round(count(*) FILTER (WHERE id IN (SELECT memory_id FROM memory_vectors WHERE embedding IS NOT NULL)) / count(*), 6) AS embedded, round(count(*) FILTER (WHERE id IN (SELECT memory_id FROM l)) / count(*), 6) AS linked FROM m",
    "pending_watermark": f"WITH {TURN_CTE} SELECT min(created_at) FILTER (WHERE coalesce(extraction_status, '') <> 'done') AS oldest_pending, max(id) FILTER (WHERE extraction_status = 'done') AS last_done, count(*) FILTER (WHERE coalesce(extraction_status, '') <> 'done') AS n_pending FROM t",
    "hygiene_findings": MEM + ", f AS (SELECT id, unnest(['content', 'metadata', 'source_id', 'tags']) AS field, unnest([content, metadata, source_id, array_to_string(tags, ' ')]) AS x FROM m WHERE status = 'active' AND agent = 'agent-1'), " + _SECRET_ROWS + " SELECT id, field, class, subclass, n, md5(substring(x, 1, 1000)) AS excerpt FROM r WHERE n > 0",
    "approval_conflicts": MEM + ", c AS (SELECT id, content_hash IS NULL AS stale FROM m WHERE content IS NOT NULL), s AS (SELECT min(id) AS stop FROM c WHERE stale) SELECT id, CASE WHEN stop IS NULL OR id < stop THEN 'apply' WHEN id = stop THEN 'conflict' ELSE 'not run' END AS state FROM c, s",
    "snapshot_diff": """WITH d AS (SELECT agent, path, doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE path IS NOT NULL AND agent IS NOT NULL), o AS (SELECT agent, path, arg_max(h, doc_id) AS h FROM d WHERE doc_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT agent, path, arg_max(h, doc_id) AS h FROM d WHERE doc_id % 2 = 1 GROUP BY 1, 2)
      SELECT coalesce(o.agent, n.agent) AS agent, coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.agent = n.agent AND o.path = n.path""",
    "frontmatter_title": r"""SELECT doc_id, regexp_matches(text, '^---[ \t]*\r?\n[\s\S]+?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)') AS has_frontmatter, coalesce(nullif(trim(regexp_extract(text, '(?m)^# ([^\r\n]+)', 1), ' '), ''), regexp_replace(list_extract(string_split(path, '/'), -1), '\.[^.]*$', '')) AS title FROM documents WHERE text IS NOT NULL""",
    "dream_candidate_pairs": MEM + """, u AS (SELECT memory_id, model, min(embedding) AS e FROM memory_vectors WHERE embedding IS NOT NULL AND len(embedding) = dimensions AND memory_id IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT id, agent, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS r FROM m WHERE status = 'active' AND visibility IN ('shared', 'fleet') AND id IN (SELECT memory_id FROM u)),
      g AS (SELECT u.*, c.agent, c.r FROM u JOIN c ON c.id = u.memory_id WHERE c.r <= 500 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
      s AS (SELECT a.memory_id AS q, b.memory_id AS id, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS sim FROM g a JOIN g b ON a.r <= 200 AND a.model = b.model AND a.agent = b.agent AND len(a.e) = len(b.e) AND a.memory_id <> b.memory_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) AS r FROM s WHERE sim >= 0.6), p AS (SELECT least(q, id) AS a, greatest(q, id) AS b, max(sim) AS similarity FROM k WHERE r <= 5 GROUP BY 1, 2)
      SELECT a, b, round(similarity, 6) AS similarity FROM p ORDER BY round(p.similarity, 9) DESC, a, b LIMIT 30""",
    "same_fact_merge": MEM + """, x AS (SELECT superseded_by AS g, id, content, tags, created_at FROM m WHERE superseded_by IS NOT NULL AND superseded_by <> id), y AS (SELECT * FROM x UNION ALL SELECT id, id, content, tags, created_at FROM m WHERE id IN (SELECT g FROM x)),
      o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY created_at NULLS FIRST, id) AS n FROM y), c AS (SELECT g, content, min(n) AS n FROM o WHERE content IS NOT NULL GROUP BY 1, 2), t AS (SELECT g, count(DISTINCT t) AS k FROM (SELECT g, unnest(tags) AS t FROM o) GROUP BY 1)
      SELECT a.g AS merged_id, md5(coalesce(c.s, '')) AS content_md5, coalesce(t.k, 0) AS n_tags, a.n FROM (SELECT g, count(*) AS n FROM o GROUP BY 1) a LEFT JOIN (SELECT g, string_agg(content, ' | ' ORDER BY n) AS s FROM c GROUP BY 1) c ON c.g = a.g LEFT JOIN t ON t.g = a.g""",
    "edit_event_reduce": "WITH RECURSIVE " + MEM_CTE + """, k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY id) AS n FROM m),
      e AS (SELECT k.id, ts, event_id, CASE event_type WHEN 'error' THEN 'forget' WHEN 'signup' THEN 'restore' WHEN 'view' THEN 'share' WHEN 'purchase' THEN 'unshare' ELSE 'feedback' END AS a, CASE WHEN event_id % 3 = 0 THEN -0.2 ELSE 0.1 END::DOUBLE AS d FROM events v JOIN k ON k.agent = 'agent-' || (v.user_id % 8) AND k.n = v.event_id % 40 + 1),
      f AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS i FROM e WHERE a = 'feedback'), r(id, i, t) AS (SELECT id, 0::BIGINT, coalesce(trust, 0.5)::DOUBLE FROM m UNION ALL SELECT r.id, f.i, least(1.0, greatest(0.0, r.t + f.d)) FROM r JOIN f ON f.id = r.id AND f.i = r.i + 1),
      z AS (SELECT id, arg_max(t, i) AS trust FROM r GROUP BY 1), s AS (SELECT id, arg_max(a, (ts, event_id)) FILTER (WHERE a IN ('forget', 'restore')) AS st, arg_max(a, (ts, event_id)) FILTER (WHERE a IN ('share', 'unshare')) AS vi FROM e GROUP BY 1)
      SELECT m.id, CASE st WHEN 'forget' THEN 'forgotten' WHEN 'restore' THEN 'active' ELSE m.status END AS status, CASE vi WHEN 'share' THEN 'shared' WHEN 'unshare' THEN 'private' ELSE m.visibility END AS visibility, round(z.trust, 6) AS trust FROM m JOIN z ON z.id = m.id LEFT JOIN s ON s.id = m.id""",
    "tumbling_events": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_events": "SELECT time_bucket(INTERVAL 10 MINUTE, ts) - o * INTERVAL 10 MINUTE AS start, count(*) AS n FROM events, range(0, 3) AS r(o) GROUP BY 1",
    "session_events": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, k",
    "retrieval_metrics": _sem() + " SELECT * FROM x",
    "metrics_by_category": _sem() + " SELECT coalesce(label::VARCHAR, '(all)') AS category, count(*) AS n, round(avg(recall_5), 4) AS recall_5, round(avg(mrr), 4) AS mrr, round(avg(ndcg_5), 4) AS ndcg_5 FROM x JOIN embeddings e ON e.vec_id = x.query_id GROUP BY ROLLUP (label)",
}
