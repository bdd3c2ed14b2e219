"""Queries on the quality, versions, trust and packing of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidenza.functions import scoring, text
from evidenza.operators import claims, context, lifecycle, ranking
from evidenza.plans.sql import CLAIM_CTE, KEY, LINK_CTE, MEM, NOW
from evidenza.runtime import table
from evidenza.sources import tables

_AGE = f"(epoch_us({NOW}::TIMESTAMPTZ) - epoch_us(%s)) / 86400000000.0"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent's memories as its result list: the lane is the type, the score the confidence."""
    return tables.memories(spark, sf_dir).where(F.col("content").isNotNull()).withColumn("score", F.coalesce("confidence", F.lit(0.0)))


def lane_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.lane_normalized(_scored(spark, sf_dir), ["agent", "type"]).select("id", F.round("relevance", 6).alias("relevance"))


def duplicate_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.duplicate_penalty(_scored(spark, sf_dir), ["agent"], "content", [F.desc("score"), "id"]).select("id", "diversity")


def quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.duplicate_penalty(ranking.lane_normalized(_scored(spark, sf_dir), ["agent", "type"]), ["agent"], "content", [F.desc("score"), "id"])
    rows = rows.withColumn("applicability", ranking.applicability(F.col("status"))).withColumn("signal", ranking.signal(F.col("trust"), F.col("confidence"), F.col("verified"), F.col("seen_count"), F.col("source")))
    return ranking.quality_ranked(rows, "agent", "id", 20).select("agent", "id", F.round("quality", 6).alias("quality"), "rank")


_AUTH = "CASE source WHEN 'manual' THEN 1.0 WHEN 'conversation' THEN 0.9 WHEN 'import' THEN 0.8 WHEN 'vault' THEN 0.85 WHEN 'hindsight' THEN 0.7 WHEN 'dream' THEN 0.55 WHEN 'cron' THEN 0.6 WHEN 'sensor' THEN 0.65 WHEN 'email' THEN 0.7 ELSE 0.65 END::DOUBLE"
_LANE = MEM + f""", r AS (SELECT *, coalesce(confidence, 0) AS score FROM m WHERE content IS NOT NULL),
n AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN 0.05 + 0.95 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN score > 0 THEN 1.0 ELSE 0.01 END::DOUBLE AS relevance,
  CASE WHEN row_number() OVER (PARTITION BY agent, {KEY('content')} ORDER BY score DESC, id) > 1 THEN 0.65 ELSE 1.0 END::DOUBLE AS diversity FROM r WINDOW w AS (PARTITION BY agent, type))"""


def best_per_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_per_content(_scored(spark, sf_dir), [], "content", [F.desc("score"), "id"]).select("id", "agent")


def claim_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.versions(tables.claims(spark, sf_dir), ["subject", "predicate"], "observed_at", "id", "object").select("id", "version", "changed", F.col("valid_to").cast("timestamp").alias("valid_to"))


def active_claim_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.latest_active(tables.claims(spark, sf_dir), ["subject", "predicate"], "observed_at", "id").select("subject", "predicate", "id", "object")


def claim_validity_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = claims.versions(tables.claims(spark, sf_dir), ["subject", "predicate"], "observed_at", "id", "object")
    t = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return v.where(claims.valid_at(F.lit(None).cast("timestamp_ntz"), F.col("observed_at"), F.col("valid_to"), t)).select("subject", "predicate", "id", "object")


def claim_conflict_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("subject", "predicate").orderBy("observed_at", "id")
    c = tables.claims(spark, sf_dir).withColumn("before", F.lag("object").over(w))
    kind = claims.conflict_class(F.coalesce(F.col("before") == F.col("object"), F.lit(False)), F.col("predicate") == "signup", F.col("predicate") == "purchase", F.col("predicate") == "view", F.col("before").isNotNull())
    return c.select("id", kind.alias("conflict"))


def reconcile_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("subject", "predicate").orderBy("observed_at", "id")
    c = tables.claims(spark, sf_dir).withColumn("before", F.lag("object").over(w)).withColumn("held", F.coalesce(F.lag("verified").over(w), F.lit(False)))
    kind = F.when(F.col("before").isNull(), "compatible").when(F.col("before") == F.col("object"), "duplicate").otherwise("update")
    yes = claims.supersedes(kind, F.col("confidence"), F.col("held"), F.lit(False), F.col("verified"), F.col("confidence"), F.col("seen_count"))
    return c.select("id", yes.alias("supersedes"))


def reconcile_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.reconciled(tables.claims(spark, sf_dir), ["subject", "predicate"])


def claim_group_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.claims(spark, sf_dir).withColumns({"uncertain": F.col("confidence") < 0.75, "score": F.col("seen_count").cast("double"), "at": F.col("observed_at")})
    return ranking.claim_winners(c, ["subject", "predicate"], "id").select("subject", "predicate", "id", "n_alternatives", "resolution")


def content_dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of memories of one content, and how many of their stored hashes are stale."""
    m = tables.memories(spark, sf_dir).where(F.col("content").isNotNull())
    stale = F.count_if(~F.lower("content_hash").eqNullSafe(F.sha2(F.col("content"), 256)))
    return m.groupBy(text.content_hash(F.col("content")).alias("hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), stale.alias("n_stale")).where("n > 1")


def seen_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each memory was delivered and in how many versions, against the count it states."""
    raw = table(spark, sf_dir, "memories").where(F.col("id").isNotNull())
    return raw.groupBy("id").agg(F.count("*").alias("n_rows"), F.countDistinct(F.coalesce(F.unix_micros("updated_at"), F.lit(0))).alias("n_versions"), F.max("seen_count").alias("stated"))


def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.contradictions(tables.memories(spark, sf_dir).where("status = 'active'"), tables.links(spark, sf_dir)).select("a", "b")


def corroboration_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lifecycle.corroborated(tables.memories(spark, sf_dir).where("status = 'active'"), tables.links(spark, sf_dir))
    return out.select("id", "n_raises", F.round("boosted", 6).alias("boosted"))


def trust_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir).where("status = 'active'")
    age = scoring.age_days(F.coalesce("updated_at", "created_at"), tables.NOW)
    return m.select("id", F.round(scoring.decayed_trust(F.coalesce("trust", F.lit(0.5)), age), 6).alias("decayed"))


def trust_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir).where("status = 'active'")
    age = scoring.age_days(F.coalesce("updated_at", "created_at"), tables.NOW)
    return m.select("id", scoring.calibrated_trust(F.col("source"), F.col("confidence"), F.col("verified"), age).alias("calibrated"))


def trust_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir).where(F.col("trust").isNotNull())
    return m.groupBy(F.bround("trust", 1).alias("bucket")).agg(F.count("*").alias("n"))


def transient_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).where(text.transient(F.col("content"))).select("id")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of each class and kind the contents and metadata of all memories give."""
    m = tables.memories(spark, sf_dir)
    rows = m.select("id", F.explode(F.array("content", "metadata")).alias("x")).where("x IS NOT NULL").select("id", F.explode(text.secret_counts(F.col("x"))).alias("h"))
    return rows.groupBy("h.class", "h.subclass").agg(F.sum("h.n").alias("n"), F.countDistinct("id").alias("n_memories"))


def statement_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).groupBy(text.statement_kind(F.col("content")).alias("kind"), "type").agg(F.count("*").alias("n"))


def archetype_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.turns(spark, sf_dir).select("id", text.query_archetype(F.col("user_text")).alias("archetype"), text.needs_memory(F.col("user_text")).alias("needs_memory"))


def visibility_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).where("content IS NOT NULL").select("id", text.visibility_guess(F.col("content")).alias("guess"))


def claim_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split(F.col("content"), " ")[0]
    m = tables.memories(spark, sf_dir).where("content IS NOT NULL")
    return m.select("id", text.claim_parts(first, F.col("content")).alias("p")).select("id", "p.predicate", F.md5("p.object").alias("object_md5"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", text.token_estimate(F.col("text")).alias("n"), F.length(text.fit_tokens(F.col("text"), 50)).alias("fitted"), F.length(text.head_tail(F.col("text"), 200)).alias("head_tail"))


def greedy_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _scored(spark, sf_dir).withColumn("cost", text.token_estimate(F.col("content")))
    return context.greedy_packed(m, "agent", [F.desc("score"), "id"], "id", "cost", 400)


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _scored(spark, sf_dir).withColumn("cost", text.token_estimate(F.col("content")))
    kind = F.when(F.col("status") != "active", "uncertainty").when(F.col("source").isin("vault", "import"), "provenance").when(F.col("type") == "conversation", "recent").otherwise("current")
    return context.context_packed(m.withColumn("kind", kind), "agent", [F.desc("score"), "id"], "id", "cost", "kind", 600)


QUERIES = {f.__name__: f for f in (lane_normalize, duplicate_penalty, quality_rank, best_per_content, claim_versions, active_claim_latest, claim_validity_asof, claim_conflict_class, reconcile_decision, reconcile_sequence, claim_group_winner, content_dedup_hash, seen_count_rollup, contradiction_pairs, corroboration_boost, trust_decay, trust_calibration, trust_histogram, transient_filter, secret_scan, statement_kind, archetype_classify, visibility_heuristic, claim_parts, token_estimates, greedy_budget_pack, context_pack)}

_WHOLE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:%s)(?:[^\p{L}\p{N}_]|$)"


def _classes(column: str, classes: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{_WHOLE % w}') THEN '{n}'" for n, w in classes) + f" ELSE '{otherwise}' END"


_CLAIM = "WITH " + CLAIM_CTE
_PACK = MEM + """, r AS (SELECT agent, id, greatest(1, ceil(len(content) / 3))::INT AS cost, row_number() OVER (PARTITION BY agent ORDER BY coalesce(confidence, 0) DESC, id) AS n FROM m WHERE content IS NOT NULL),"""
ORACLE = {
    "lane_normalize": _LANE + " SELECT id, round(relevance, 6) AS relevance FROM n",
    "duplicate_penalty": _LANE + " SELECT id, diversity FROM n",
    "quality_rank": _LANE + f""", q AS (SELECT agent, id, relevance * diversity * CASE WHEN status IN ('superseded', 'historical') THEN 0.45 WHEN status IN ('contradicted', 'unresolved') THEN 0.85 ELSE 1.0 END
      * (0.8 + 0.4 * (0.35 * coalesce(nullif(trust, 0), 0.5) + 0.3 * coalesce(nullif(confidence, 0), 0.5) + 0.15 * CASE WHEN verified THEN 1 ELSE 0 END + 0.1 * least(1.0, (greatest(coalesce(seen_count, 1), 1) - 1) / 4) + 0.1 * {_AUTH})) AS quality FROM n)
      SELECT agent, id, round(quality, 6) AS quality, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY round(quality, 9) DESC, id) AS rank FROM q) WHERE rank <= 20""",
    "best_per_content": MEM + f" SELECT id, agent FROM (SELECT id, agent, row_number() OVER (PARTITION BY {KEY('content')} ORDER BY coalesce(confidence, 0) DESC, id) AS r FROM m WHERE content IS NOT NULL) WHERE r = 1",
    "claim_versions": _CLAIM + " SELECT id, row_number() OVER w AS version, coalesce(lag(object) OVER w <> object, true) AS changed, lead(observed_at) OVER w AS valid_to FROM c WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, id)",
    "active_claim_latest": _CLAIM + " SELECT subject, predicate, id, object FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY observed_at DESC, id DESC) AS r FROM c) WHERE r = 1",
    "claim_validity_asof": _CLAIM + " SELECT subject, predicate, id, object FROM (SELECT *, lead(observed_at) OVER (PARTITION BY subject, predicate ORDER BY observed_at, id) AS e FROM c) WHERE observed_at <= TIMESTAMP '2024-01-15' AND (e IS NULL OR e > TIMESTAMP '2024-01-15')",
    "claim_conflict_class": _CLAIM + """ SELECT id, CASE WHEN predicate = 'signup' AND NOT coalesce(b = object, false) THEN 'update' WHEN b IS NULL THEN 'compatible' WHEN b = object AND predicate = 'view' THEN 'conditional' WHEN b = object THEN 'duplicate'
      WHEN predicate = 'purchase' THEN 'update' WHEN predicate = 'view' THEN 'conditional' ELSE 'unresolved' END AS conflict FROM (SELECT *, lag(object) OVER (PARTITION BY subject, predicate ORDER BY observed_at, id) AS b FROM c)""",
    "reconcile_decision": _CLAIM + """ SELECT id, b IS NOT NULL AND b <> object AND confidence >= 0.75 AND (NOT h OR (verified AND confidence >= 0.85 AND seen_count >= 2)) AS supersedes
      FROM (SELECT *, lag(object) OVER w AS b, coalesce(lag(verified) OVER w, false) AS h FROM c WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, id))""",
    "reconcile_sequence": "WITH RECURSIVE " + CLAIM_CTE + """, n AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY observed_at, id) AS i FROM c),
      f AS (SELECT subject, predicate, i, id, 'first' AS decision, id AS active_id, object AS o, verified AS v FROM n WHERE i = 1
      UNION ALL SELECT n.subject, n.predicate, n.i, n.id, CASE WHEN n.object = f.o THEN 'duplicate' WHEN n.confidence >= 0.75 AND (NOT f.v OR n.verified) THEN 'update' ELSE 'unresolved' END,
        CASE WHEN n.object <> f.o AND n.confidence >= 0.75 AND (NOT f.v OR n.verified) THEN n.id ELSE f.active_id END, CASE WHEN n.object <> f.o AND n.confidence >= 0.75 AND (NOT f.v OR n.verified) THEN n.object ELSE f.o END,
        CASE WHEN n.object <> f.o AND n.confidence >= 0.75 AND (NOT f.v OR n.verified) THEN n.verified ELSE f.v END
      FROM f JOIN n ON n.subject = f.subject AND n.predicate = f.predicate AND n.i = f.i + 1) SELECT id, decision, active_id FROM f""",
    "claim_group_winner": _CLAIM + """, k AS (SELECT *, confidence < 0.75 AS u FROM c) SELECT subject, predicate, id, n - 1 AS n_alternatives, CASE WHEN hi AND NOT lo THEN 'unresolved' ELSE 'resolved' END AS resolution FROM (
      SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY u, confidence DESC, seen_count DESC, observed_at DESC, id) AS r, count(*) OVER w AS n, max(u) OVER w AS hi, min(u) OVER w AS lo FROM k WINDOW w AS (PARTITION BY subject, predicate)) WHERE r = 1""",
    "content_dedup_hash": MEM + f" SELECT sha256({KEY('content')}) AS hash, count(*) AS n, min(id) AS first_id, count(*) FILTER (WHERE lower(content_hash) IS DISTINCT FROM sha256(content)) AS n_stale FROM m WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "seen_count_rollup": "SELECT id, count(*) AS n_rows, count(DISTINCT coalesce(epoch_us(updated_at), 0)) AS n_versions, max(seen_count) AS stated FROM memories WHERE id IS NOT NULL GROUP BY id",
    "trust_decay": MEM + f" SELECT id, round(greatest(CASE WHEN coalesce(trust, 0.5) > 0 THEN coalesce(trust, 0.5) * pow(0.5, {_AGE % 'coalesce(updated_at, created_at)'} / 30) ELSE 0 END, 0.3), 6) AS decayed FROM m WHERE status = 'active'",
    "trust_histogram": MEM + " SELECT round_even(trust, 1) AS bucket, count(*) AS n FROM m WHERE trust IS NOT NULL GROUP BY 1",
    "transient_filter": MEM + r" SELECT id FROM m WHERE regexp_matches(content, '(?:^|[^\p{L}\p{N}_])[0-9]{1,3}\s*%') OR regexp_matches(content, '(?:^|[^\p{L}\p{N}_])[0-9]{1,2}:[0-9]{2}(?:\s*[aApP][mM])?(?:[^\p{L}\p{N}_]|$)')"
      + " OR regexp_matches(content, '" + _WHOLE % "percent|currently|now|is at|today|tonight|this morning|right now" + "')",
    "secret_scan": "@SECRETS",
    "statement_kind": MEM + " SELECT " + _classes("coalesce(content, '')", [("correction", r"correct(?:ion|ed)?|actually|not\s+[\p{L}\p{N}_]+\s+but|wrong"), ("abandoned", "abandon(?:ed|ing)?|withdrawn|dropped|rejected|no longer"), ("unresolved", "unresolved|open question|still need to decide|undecided|tbd"),
      ("conflict", "conflict|contradict(?:ion|s|ory)?|disagree|both options"), ("decision", "decid(?:e|ed|ing)|agreed|selected|adopted|we will|choose|chosen"), ("proposal", "propos(?:e|ed|al)|suggest(?:ed|ion)?|could|might|should")], "discussion") + " AS kind, type, count(*) AS n FROM m GROUP BY 1, 2",
    "archetype_classify": "SELECT id, " + _classes("x", [("historical", r"when|before|previously|used to|historical|history|at that time|last time|in [0-9]{4}|[0-9]{4}-[01][0-9]-[0-3][0-9]"), ("document_lookup", "file|document|note|vault|markdown|folder|path"),
      ("troubleshooting", "error|failure|broken|bug|issue|traceback|exception|doesn''t work|not working"), ("preference", "prefer|preference|like|likes|favorite|favourite|usually"), ("project_state", "status|state|progress|milestone|todo|blocked|project"), ("delegation", "delegate|delegated|subagent|hand off|child task"),
      ("procedure", "how do|how to|configure|setup|install|steps|procedure"), ("person_or_entity", "who is|person|user|team|colleague|friend|owner"), ("general_recall", "remember|recall|what did|tell me|according to")], "unknown")
      + " AS archetype, x <> '' AND (regexp_matches(x, '" + _WHOLE % "remember|recall|did we|do we|what did|what do|decide|decided|status of|last time|previously|before|earlier|who is|what is|where is|how many|which|configure|setup|preference|prefers|policy|policies"
      + "') OR NOT regexp_matches(x, '(?i)^(?:hey|hi|hello|yo|sup|howdy|thanks|thank you|ok|okay|sure|yes|no|cool|nice|got it|bye|good night|how are you|how''s it going|what''s up|whats up)[!?.]*$')) AS needs_memory FROM (SELECT id, trim(coalesce(any_value(user_text), ''), ' ') AS x FROM turns WHERE id IS NOT NULL GROUP BY id)",
    "visibility_heuristic": MEM + " SELECT id, CASE WHEN regexp_matches(lower(content), 'timezone|name|email|prefers|hates|wants|language|region|location') THEN 'fleet' WHEN regexp_matches(lower(content), 'project|repo|hardware|server|network|decision|agreed|plan|build') THEN 'shared' ELSE 'private' END AS guess FROM m WHERE content IS NOT NULL",
    "token_estimates": "SELECT doc_id, greatest(1, ceil(len(text) / 3))::INT AS n, CASE WHEN greatest(1, ceil(len(text) / 3)) <= 50 THEN len(text) ELSE len(rtrim(substring(text, 1, 149), ' ')) + 1 END AS fitted, CASE WHEN len(text) <= 200 THEN len(text) ELSE 200 END AS head_tail FROM documents WHERE text IS NOT NULL",
    "greedy_budget_pack": "WITH RECURSIVE " + _PACK[len("WITH "):] + """ f AS (SELECT agent, n, id, cost, CASE WHEN cost <= 400 THEN cost ELSE 0 END AS used, cost <= 400 AS kept FROM r WHERE n = 1
      UNION ALL SELECT r.agent, r.n, r.id, r.cost, f.used + CASE WHEN f.used + r.cost <= 400 THEN r.cost ELSE 0 END, f.used + r.cost <= 400 FROM f JOIN r ON r.agent = f.agent AND r.n = f.n + 1 WHERE r.n <= 100)
      SELECT agent, id, row_number() OVER (PARTITION BY agent ORDER BY n) AS position, cost FROM f WHERE kept""",
    "context_pack": "WITH RECURSIVE " + MEM[len("WITH "):] + """, r AS (SELECT * FROM (SELECT agent, id, greatest(1, ceil(len(content) / 3))::INT AS cost, CASE WHEN status <> 'active' THEN 'uncertainty' WHEN source IN ('vault', 'import') THEN 'provenance' WHEN type = 'conversation' THEN 'recent' ELSE 'current' END AS kind,
        row_number() OVER (PARTITION BY agent ORDER BY coalesce(confidence, 0) DESC, id) AS n FROM m WHERE content IS NOT NULL) WHERE n <= 100),
      k AS (SELECT *, row_number() OVER (PARTITION BY agent, kind ORDER BY n) AS i, CASE kind WHEN 'current' THEN 360 WHEN 'uncertainty' THEN 120 WHEN 'provenance' THEN 90 ELSE 30 END AS q FROM r),
      a AS (SELECT agent, kind, i, n, id, cost, CASE WHEN cost <= q THEN cost ELSE 0 END AS used, cost <= q AS kept FROM k WHERE i = 1
        UNION ALL SELECT k.agent, k.kind, k.i, k.n, k.id, k.cost, a.used + CASE WHEN a.used + k.cost <= k.q THEN k.cost ELSE 0 END, a.used + k.cost <= k.q FROM a JOIN k ON k.agent = a.agent AND k.kind = a.kind AND k.i = a.i + 1),
      u AS (SELECT agent, 600 - coalesce(sum(cost) FILTER (WHERE kept), 0) AS q FROM a GROUP BY 1), l AS (SELECT a.agent, a.n, a.id, a.cost, u.q, row_number() OVER (PARTITION BY a.agent ORDER BY a.n) AS i FROM a JOIN u ON u.agent = a.agent WHERE NOT kept),
      b AS (SELECT agent, i, n, id, cost, q, CASE WHEN cost <= q THEN cost ELSE 0 END AS used, cost <= q AS kept FROM l WHERE i = 1
        UNION ALL SELECT l.agent, l.i, l.n, l.id, l.cost, l.q, b.used + CASE WHEN b.used + l.cost <= l.q THEN l.cost ELSE 0 END, b.used + l.cost <= l.q FROM b JOIN l ON l.agent = b.agent AND l.i = b.i + 1),
      o AS (SELECT agent, min(n) FILTER (WHERE NOT kept) AS n, max(q) - coalesce(sum(cost) FILTER (WHERE kept), 0) AS rest FROM b GROUP BY 1)
      SELECT agent, id, cost AS granted, false AS cut FROM a WHERE kept UNION ALL SELECT agent, id, cost, false FROM b WHERE kept UNION ALL SELECT b.agent, b.id, o.rest, true FROM b JOIN o ON o.agent = b.agent AND o.n = b.n WHERE o.rest >= 8""",
    "corroboration_boost": MEM + """, """ + LINK_CTE + """, a AS (SELECT id, agent, coalesce(nullif(trust, 0), 0.5) AS t, {'t': coalesce(epoch_us(created_at), 0), 'id': id} AS at FROM m WHERE status = 'active'),
      k AS (SELECT l.memory_id, l.entity_id, a.agent, a.at, row_number() OVER (PARTITION BY memory_id ORDER BY entity_id) AS r FROM l JOIN a ON a.id = l.memory_id),
      n AS (SELECT x.memory_id AS id, count(DISTINCT y.memory_id) AS n FROM k x JOIN k y ON x.agent = y.agent AND x.entity_id = y.entity_id AND y.r <= 5 AND y.at > x.at GROUP BY 1),
      o AS (SELECT DISTINCT y.memory_id AS id FROM k x JOIN k y ON x.agent = y.agent AND x.entity_id = y.entity_id AND y.r <= 5 AND y.at > x.at)
      SELECT id, k AS n_raises, round(CASE WHEN k > 0 THEN least(0.95, t + 0.05 * k) ELSE t END, 6) AS boosted FROM (SELECT a.id, a.t, least(19, coalesce(n.n, 0) + CASE WHEN o.id IS NULL THEN 0 ELSE 1 END) AS k FROM a LEFT JOIN n ON n.id = a.id LEFT JOIN o ON o.id = a.id)""",
    "trust_calibration": MEM + f""", a AS (SELECT *, {_AGE % 'coalesce(updated_at, created_at)'} AS age FROM m WHERE status = 'active') SELECT id, round_even(least(0.95::DOUBLE, coalesce(nullif(confidence, 0), 0.5)
      + CASE source WHEN 'vault' THEN 0.15 WHEN 'import' THEN 0.05 WHEN 'manual' THEN 0.10 WHEN 'hindsight' THEN -0.05 ELSE 0.0 END::DOUBLE + CASE WHEN verified THEN 0.1 ELSE 0.0 END::DOUBLE
      + CASE WHEN age < 1 THEN 0.05 WHEN age < 7 THEN 0.03 WHEN age < 30 THEN 0.01 ELSE 0.0 END::DOUBLE), 2) AS calibrated FROM a""",
    "contradiction_pairs": MEM + f", {LINK_CTE}" + r""", t AS (SELECT id, agent, list_transform(list_filter(regexp_split_to_array(content, '[ \t\r\n\f\x0b]+'), lambda x: x <> ''), lambda x: trim(lower(x), '.,!?;:"''()[]')) AS t FROM m WHERE status = 'active' AND content IS NOT NULL),
      w AS (SELECT id, agent, t, list_distinct(list_filter(t, lambda x: NOT list_contains(@NEG, x))) AS p, len(list_filter(t, lambda x: list_contains(@NEG, x))) AS n FROM t),
      c AS (SELECT DISTINCT x.memory_id AS a, y.memory_id AS b FROM l x JOIN l y ON x.entity_id = y.entity_id AND x.memory_id < y.memory_id),
      s AS (SELECT a, b, x.t AS ta, y.t AS tb, x.n AS na, y.n AS nb, len(list_intersect(x.p, y.p)) AS both_, least(len(x.p), len(y.p)) AS small FROM c JOIN w x ON x.id = a JOIN w y ON y.id = b AND x.agent = y.agent)
      SELECT a, b FROM s WHERE (na <> nb AND both_ >= 1 AND both_ >= small - 1) OR (both_ >= greatest(1, small - 2) AND len(list_filter(@ANT, lambda p: (list_contains(ta, p[1]) AND list_contains(tb, p[2])) OR (list_contains(ta, p[2]) AND list_contains(tb, p[1])))) > 0)"""
    .replace("@NEG", "['not','no','never','none','n''t','cannot','cant','without','isn''t','wasn''t','aren''t','weren''t','don''t','doesn''t','didn''t','won''t','wouldn''t','shouldn''t','couldn''t','isn','wasn','aren']")
    .replace("@ANT", "[['on','off'],['online','offline'],['up','down'],['open','closed'],['enabled','disabled'],['yes','no'],['true','false'],['active','inactive'],['private','shared'],['light','dark'],['start','stop'],['allow','block'],['accept','reject'],['pass','fail']]"),
    "claim_parts": MEM + r""", c AS (SELECT id, split_part(content, ' ', 1) AS s, rtrim(regexp_replace(trim(content, ' '), '[.?!]+$', ''), ' ') AS b FROM m WHERE content IS NOT NULL),
      o AS (SELECT *, CASE WHEN starts_with(lower(b), lower(s)) AND len(s) > 0 AND regexp_matches(substring(b, len(s) + 1, 1), '\s') THEN regexp_replace(substring(b, len(s) + 1), '^\s+', '') ELSE b END AS r0 FROM c),
      r AS (SELECT *, regexp_replace(r0, '(?i)^(?:now|currently|still)\s+', '') AS r FROM o),
      v AS (SELECT *, CASE WHEN r <> b THEN regexp_replace(lower(regexp_extract(r, @P, 1)), '\s+', '_', 'g') ELSE '' END AS v FROM r)
      SELECT id, CASE WHEN v <> '' THEN v ELSE 'states' END AS predicate, md5(CASE WHEN v <> '' THEN trim(regexp_extract(r, @P, 2), ' ') ELSE b END) AS object_md5 FROM v""".replace("@P", r"'(?i)^(prefers?|likes?|uses?|works on|owns?|lives in|is named)\s+([^\n]+)\z'"),
}


def _late() -> None:
    from evidenza.plans.archive import _SECRET_ROWS

    ORACLE["secret_scan"] = MEM + ", f AS (SELECT id, unnest([content, metadata]) AS x FROM m), " + _SECRET_ROWS + " SELECT class, subclass, sum(n)::BIGINT AS n, count(DISTINCT id) AS n_memories FROM r WHERE n > 0 GROUP BY 1, 2"


_late()
