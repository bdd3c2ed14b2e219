"""Queries on ownership, names and aliases, prefetching, imports and feedback by kind of question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidenza.functions import scoring, text
from evidenza.operators import claims, context, evaluate, feedback, graph, history, lifecycle, recall, vault
from evidenza.plans.recall import _LANE, _W
from evidenza.plans.archive import _SEEN, _VIS
from evidenza.plans.sql import KEY, LINK_CTE, MEM, MEM_CTE, MSG_CTE, SES_CTE, SIG_CTE, TOKENS, TURN_CTE
from evidenza.plans.upkeep import _EKEY, _MADE, _NAMES
from evidenza.runtime import numbered, table
from evidenza.sources import migrate, tables

_NOW = "2024-02-01 00:00:00"


# names
def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, each once, with the words of their name behind the first as an alias."""
    e = tables.latest(table(spark, sf_dir, "entities"), "id", "name").where("name IS NOT NULL")
    tail = F.regexp_replace(F.trim("name"), r"^\S+ +", "")
    return e.select("id", "agent", "name", F.when(tail != F.trim("name"), F.array(tail)).otherwise(F.array().cast("array<string>")).alias("aliases"))


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.named(_entities(spark, sf_dir), tables.links(spark, sf_dir), tables.memories(spark, sf_dir))


def graph_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's name as a question of its agent: what else to search for."""
    e, m, l = _entities(spark, sf_dir), tables.memories(spark, sf_dir), tables.links(spark, sf_dir)  # noqa: E741
    words = F.split(F.trim("name"), " +")
    runs = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    q = e.where("agent IS NOT NULL").select(F.col("id").alias("query_id"), "agent", F.slice(F.array_distinct(F.concat(runs(3), runs(2), runs(1))), 1, 8).alias("phrases"))
    return graph.expanded(q, graph.named(e, l, m), e, graph.owned_edges(l, m)).select("query_id", "name", "place")


def entity_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of each memory by how often and how fully they are named."""
    n = graph.entity_mentions(tables.memories(spark, sf_dir).where("content IS NOT NULL"), "id", "content")
    worth = F.col("n") * (1 + 0.5 * F.size(F.split("name", " ")))
    order = Window.partitionBy("id").orderBy(F.desc(worth), "rank")
    return n.select("id", "name", F.round(worth, 6).alias("salience"), F.row_number().over(order).alias("place"))


def relation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which active memories are evidence for which relation of names."""
    e = graph.sentence_edges(tables.memories(spark, sf_dir).where("content IS NOT NULL AND status = 'active'"), "id", "content")
    return e.select("name_a", "name_b", F.col("id").alias("memory_id")).distinct()


# claims
def claim_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir).where("content IS NOT NULL")
    return m.select("id", text.claim_identity(F.split("content", " ")[0], F.col("content")).alias("identity"))


def near_identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active facts of one agent and visibility that state the same: the first is kept and has been seen as often as all."""
    m = tables.memories(spark, sf_dir).where("content IS NOT NULL AND status = 'active'").withColumn("identity", text.claim_identity(F.split("content", " ")[0], F.col("content")))
    g = m.groupBy("agent", "visibility", "identity").agg(F.min_by("id", F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(0)), "id")).alias("kept_id"), F.count("*").alias("n"), F.sum(F.coalesce("seen_count", F.lit(1))).alias("seen"))
    return g.where("n > 1").select("agent", "visibility", "kept_id", "n", "seen")


def claims_from_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain claims for active memories that no claim was made of: the first tag is the subject."""
    m = tables.memories(spark, sf_dir).where("status = 'active' AND content IS NOT NULL AND size(tags) > 0")
    rest = m.join(claims.projected(m).select(F.col("memory_id").alias("id")), "id", "left_anti")
    return rest.select("id", "agent", F.element_at("tags", 1).alias("subject"), F.lit("states").alias("predicate"), F.md5(F.rtrim(F.regexp_replace(F.trim("content"), r"[.?!]+$", ""))).alias("object_md5"))


def migrated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with their memory's owner, and the columns that older tables lack."""
    rows = migrate.re_owned(table(spark, sf_dir, "memory_entities").where("memory_id IS NOT NULL"), "memory_id", tables.memories(spark, sf_dir))
    rows = migrate.with_columns(rows, {"strength": ("double", 1.0), "agent": ("string", "")})
    return rows.groupBy("agent", "strength").agg(F.count("*").alias("n"))


# recall
def recall_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled memories with the newest claim each gave."""
    from evidenza.plans.recall import recall_memories

    c = claims.latest_active(claims.projected(tables.memories(spark, sf_dir)), ["memory_id"], "observed_at", "claim_id").select(F.col("memory_id").alias("id"), "claim_id", "predicate")
    return recall_memories(spark, sf_dir).select("query_id", "id", "rank").join(c, "id", "left").select("query_id", "id", "rank", "claim_id", "predicate")


def prefetch_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn worth it would be given: the best memories by keywords of its expansions, in order, packed into 200 tokens, and a digest of it."""
    t = tables.turns(spark, sf_dir).where(text.needs_memory(F.col("user_text")) & F.col("agent_id").isNotNull())
    each = t.select("id", "agent_id", F.posexplode(text.expansions(F.col("user_text"))).alias("at", "term"))
    q = each.select(F.concat_ws("#", F.col("id").cast("string"), F.col("at").cast("string")).alias("query_id"), F.col("agent_id").alias("owner"), text.tokens(F.col("term")).alias("terms"))
    m = tables.memories(spark, sf_dir).where("status = 'active'")
    found = recall.keyword_lane(m, q, 5).withColumn("turn", F.split_part("query_id", F.lit("#"), F.lit(1))).withColumn("at", F.split_part("query_id", F.lit("#"), F.lit(2)).cast("int"))
    costs = tables.memories(spark, sf_dir, cost=text.token_estimate(F.col("content"))).where("status = 'active'").select("id", "cost")
    first = found.select("turn", "at", "id", "rank").join(costs, "id").repartition("turn")  # a turn has few rows; all that follows stays with it
    first = first.groupBy("turn", "id", "cost").agg(F.min(F.struct("at", "rank")).alias("f"))
    packed = context.greedy_packed(first, "turn", ["f", "id"], "id", "cost", 200)
    return packed.groupBy("turn").agg(F.count("*").alias("n"), F.sum("cost").alias("tokens"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]), ",")).alias("digest"))  # at most 100 a turn


# imports and windows
_BANK = ["project", "preference", "decision", "person", "tool"]


def bank_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 new entries of the memory banks that hold any of five words: no states of the moment, each content once, none that is stored."""
    d = table(spark, sf_dir, "documents").where(F.startswith("source", F.lit("import:bank"))).where(F.arrays_overlap(text.tokens(F.col("text")), F.array(*[F.lit(w) for w in _BANK])) & ~text.transient(F.col("text"), allow_temporal=True))
    one = d.groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"))
    stored = tables.memories(spark, sf_dir).where("content IS NOT NULL").select(text.content_hash(F.col("content")).alias("hash"))
    return one.join(stored, "hash", "left_anti").orderBy("doc_id").limit(200).select("doc_id", "hash")


def dream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shareable active memories of the last day before each agent's newest."""
    m = tables.memories(spark, sf_dir).where("status = 'active' AND visibility IN ('shared', 'fleet') AND created_at IS NOT NULL")
    newest = m.groupBy("agent").agg(F.max("created_at").alias("newest"))
    return m.join(newest, "agent").where(F.unix_micros("newest") - F.unix_micros("created_at") <= 86_400_000_000).select("id", "agent")


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments written in four ways, read back."""
    d = table(spark, sf_dir, "documents").where("created_at IS NOT NULL")
    plain = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(plain, F.lit("Z"))).when(F.col("doc_id") % 4 == 1, F.concat(plain, F.lit("+02:00"))).when(F.col("doc_id") % 4 == 2, plain).otherwise(F.concat(F.lit("on "), plain))
    return d.select("doc_id", text.iso_time(said).alias("at"))


def vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "memory_vectors").where("memory_id IS NOT NULL AND embedding IS NOT NULL").select("memory_id", "embedding").distinct()
    return migrate.packed(v, "memory_id", "embedding").select("memory_id", migrate.packed_length(F.col("packed")).alias("n"))


# feedback
_KINDS = {"purchase": "explicit_useful", "error": "explicit_wrong", "click": "tool_supported", "signup": "counterfactual_support", "view": "support_assessment"}


def signal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the outcomes of each user weigh, by their kind."""
    kind = scoring.lookup(_KINDS, F.col("event_type"), None)
    e = table(spark, sf_dir, "events").withColumn("signal", kind)
    weight = scoring.lookup({k: d * w for k, (d, w, _) in scoring.SIGNALS.items()}, F.col("signal"), 0.0)
    explicit = scoring.lookup({k: x == "explicit" for k, (_, _, x) in scoring.SIGNALS.items()}, F.col("signal"), False)
    return e.groupBy("user_id").agg(F.round(F.sum(weight), 6).alias("total"), F.count_if(explicit).alias("n_explicit"))


def utility_by_archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = feedback.mixed(tables.signals(spark, sf_dir), "memory_id", "signal_type", F.lit(_NOW).cast("timestamp"))
    return u.select("memory_id", "signal_type", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "mean", "confidence")])


def insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories after their later versions came in: the newest of each id, and how many ids came anew."""
    raw = table(spark, sf_dir, "memories").where("id IS NOT NULL").select("id", F.coalesce(F.unix_micros("updated_at"), F.lit(0)).alias("at"), F.coalesce("status", F.lit("active")).alias("status")).distinct()
    early = raw.where((F.col("at") % 2) == 0)
    out = lifecycle.upserted(early, raw.where((F.col("at") % 2) == 1), ["id"], ["at", "status"])
    new = lifecycle.new_only(raw, early, ["id"]).select("id", F.lit(True).alias("new"))
    return out.join(new, "id", "left").select("id", "at", "status", F.coalesce("new", F.lit(False)).alias("new"))


def turn_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue row for each turn that says something, however often it was delivered."""
    t = tables.turns(spark, sf_dir)
    says = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    status = F.when(F.col("extraction_status") == "done", "done").when(F.coalesce("extraction_attempts", F.lit(0)) >= 3, "dead_letter").otherwise("pending")
    return t.where(says("user_text") | says("assistant_text")).select("id", status.alias("status"), F.coalesce("extraction_attempts", F.lit(0)).cast("int").alias("attempts"))


def reference_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was known of each session at some time still holds: its visible messages are the same now."""
    g = tables.messages(spark, sf_dir)
    was = history.version_digest(g.where(F.col("timestamp") < F.lit("2025-03-01 00:00:00").cast("timestamp"))).select("session_id", F.col("version").alias("was"))
    return was.join(history.version_digest(g), "session_id", "left").select("session_id", F.coalesce(F.col("was") == F.col("version"), F.lit(False)).alias("valid"))


def telemetry_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each kind retention drops: those older than 20 days, and all but the newest 1,500."""
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL")
    rows = numbered(e.select("event_type", "ts", "event_id"), ["event_type"], [F.desc("ts"), F.desc("event_id")])
    old = F.col("ts") < F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")
    return rows.groupBy("event_type").agg(F.count_if(old).alias("n_old"), F.count_if(~old & (F.col("n") > 1500)).alias("n_beyond"))


def reextract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names a memory's newest version gained and lost against its oldest."""
    raw = table(spark, sf_dir, "memories").where("id IS NOT NULL AND content IS NOT NULL").withColumn("at", F.coalesce(F.unix_micros("updated_at"), F.lit(0)))
    ends = raw.groupBy("id").agg(F.max(F.struct("at", "content")).alias("new"), F.min(F.struct("at", "content")).alias("old"))
    names = lambda c: graph.entity_mentions(ends.select("id", F.col(f"{c}.content").alias("content")), "id", "content").select("id", "name_key", F.lit(True).alias(c))
    both = names("old").distinct().join(names("new").distinct(), ["id", "name_key"], "full")
    change = F.when(F.col("old").isNull(), "gained").when(F.col("new").isNull(), "lost").otherwise("kept")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_memories"))


def vault_index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What indexing does for each path whose text changed between two snapshots: passages to write and to trim."""
    d = table(spark, sf_dir, "documents").where("path IS NOT NULL AND agent IS NOT NULL")
    one = lambda p: d.where(F.col("doc_id") % 2 == p).groupBy("agent", "path").agg(F.max("doc_id").alias("doc_id"))
    counts = vault.passages(d, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))
    side = lambda p, c: one(p).join(counts, "doc_id", "left").select("agent", "path", F.coalesce("n", F.lit(0)).alias(c))
    both = side(0, "was").join(side(1, "now"), ["agent", "path"], "full").na.fill(0, ["was", "now"])
    return both.select("agent", "path", F.col("now").alias("n_written"), F.greatest(F.lit(0), F.col("was") - F.col("now")).cast("bigint").alias("n_trimmed"))


def field_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of changes to memories: only some fields may be changed, and only to something else."""
    m = numbered(tables.memories(spark, sf_dir), ["agent"], ["id"]).select("agent", "n", "id", "visibility", "status", "type")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("agent-"), (F.col("user_id") % 8).cast("string")).alias("agent"), (F.col("event_id") % 40 + 1).alias("n"), "event_id", "event_type")
    field = F.when(F.col("event_type") == "view", "visibility").when(F.col("event_type") == "signup", "status").when(F.col("event_type") == "click", "type").otherwise("id")
    value = F.when(F.col("event_type") == "view", "shared").when(F.col("event_type") == "signup", "archived").when(F.col("event_type") == "click", "fact").otherwise("x")
    rows = e.join(m, ["agent", "n"]).withColumn("field", field).withColumn("value", value)
    old = F.when(F.col("field") == "visibility", F.col("visibility")).when(F.col("field") == "status", F.col("status")).when(F.col("field") == "type", F.col("type"))
    outcome = F.when(F.col("field") == "id", "rejected").when(old.eqNullSafe(F.col("value")), "unchanged").otherwise("applied")
    return rows.groupBy("field", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_memories"))


def claim_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that take another's place, with what stood there before and after."""
    c = claims.projected(tables.memories(spark, sf_dir).where("status = 'active'"))
    w = Window.partitionBy("agent", text.claim_value(F.col("subject")), "predicate").orderBy("observed_at", "claim_id")
    c = c.select("claim_id", "object", F.lag("claim_id").over(w).alias("replaced"), F.lag("object").over(w).alias("before"))
    return c.where(F.col("replaced").isNotNull() & (text.claim_value(F.col("before")) != text.claim_value(F.col("object")))).select("claim_id", "replaced", F.md5("before").alias("before_md5"), F.md5("object").alias("after_md5"))


def sessions_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the archive, with how many visible sessions spoke on each and how much."""
    s = tables.sessions(spark, sf_dir).where(history.visible_session()).select(F.col("id").alias("session_id"))
    g = tables.messages(spark, sf_dir).where(history.visible_message() & F.col("timestamp").isNotNull()).join(s, "session_id", "left_semi")
    return g.groupBy(F.to_date("timestamp").alias("day")).agg(F.countDistinct("session_id").alias("n_sessions"), F.count("*").alias("n_messages"))


def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well recall finds each asking memory itself, and texts equal to it."""
    from evidenza.plans.recall import _active, _asked, recall_memories

    m = _active(spark, sf_dir)
    judged = _asked(m).select(F.col("id").alias("query_id"), "id")
    return evaluate.ranking_metrics(recall_memories(spark, sf_dir), judged)


QUERIES = {f.__name__: f for f in (turn_queue, reference_validation, telemetry_retention, reextract_diff, vault_index_plan, field_updates, claim_replacements, sessions_by_day, recall_metrics, entity_lookup, graph_expansions, entity_salience, relation_evidence, claim_identities, near_identity_dedup, claims_from_tags, migrated_links, recall_claims, prefetch_context, bank_import, dream_window, iso_times, vector_pack, signal_weights, utility_by_archetype, insert_or_replace)}

_ENT = f"""en AS (SELECT id, agent, name, {_EKEY} AS key, regexp_replace(trim(name, ' '), '^\\S+ +', '') AS tail FROM (SELECT id, any_value(agent) AS agent, any_value(name) AS name FROM entities WHERE id IS NOT NULL GROUP BY id) WHERE name IS NOT NULL),
  ek AS (SELECT id, agent, key, 0 AS alias FROM en UNION ALL SELECT id, agent, {_EKEY.replace('lower(name)', 'lower(tail)')}, 1 FROM en WHERE tail <> trim(name, ' ')), us AS (SELECT DISTINCT l.entity_id AS id, m.agent FROM l JOIN m ON m.id = l.memory_id),
  ea AS (SELECT id, agent, key, alias, 0 AS free FROM ek WHERE agent IS NOT NULL UNION ALL SELECT ek.id, us.agent, key, alias, 1 FROM ek JOIN us ON us.id = ek.id WHERE ek.agent IS NULL), nm AS (SELECT agent, key, arg_min(id, (alias, free, id)) AS id FROM ea WHERE key <> '' GROUP BY 1, 2)"""
_PARTS = r"""ci AS (SELECT *, split_part(content, ' ', 1) AS sb, rtrim(regexp_replace(trim(content, ' '), '[.?!]+$', ''), ' ') AS bd FROM m WHERE content IS NOT NULL),
  cj AS (SELECT *, regexp_replace(CASE WHEN starts_with(lower(bd), lower(sb)) AND len(sb) > 0 AND regexp_matches(substring(bd, len(sb) + 1, 1), '\s') THEN regexp_replace(substring(bd, len(sb) + 1), '^\s+', '') ELSE bd END, '(?i)^(?:now|currently|still)\s+', '') AS rs FROM ci),
  ck AS (SELECT *, CASE WHEN rs <> bd THEN regexp_replace(lower(regexp_extract(rs, @V, 1)), '\s+', '_', 'g') ELSE '' END AS vb FROM cj),
  cl AS (SELECT *, sha256(@N(sb) || chr(1) || @N(CASE WHEN vb <> '' THEN vb ELSE 'states' END) || chr(1) || @N(CASE WHEN vb <> '' THEN trim(regexp_extract(rs, @V, 2), ' ') ELSE bd END)) AS identity FROM ck)"""
_PARTS = _PARTS.replace("@V", r"'(?i)^(prefers?|likes?|uses?|works on|owns?|lives in|is named)\s+([^\n]+)\z'")
for _c in ("sb", "CASE WHEN vb <> '' THEN vb ELSE 'states' END", "CASE WHEN vb <> '' THEN trim(regexp_extract(rs, " + r"'(?i)^(prefers?|likes?|uses?|works on|owns?|lives in|is named)\s+([^\n]+)\z'" + ", 2), ' ') ELSE bd END"):
    _PARTS = _PARTS.replace(f"@N({_c})", rf"regexp_replace(lower(trim({_c}, ' .!?')), '\s+', ' ', 'g')")
_UT = f"WITH {SIG_CTE}, w AS (SELECT *, weight * pow(0.5, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 86400000000.0 / 90) AS d FROM g)"


def _named_edges() -> str:
    from evidenza.plans.upkeep import ORACLE as upkeep

    return upkeep["sentence_edges"]


_EDGE_SQL = _named_edges()
_SEEN_DIGEST = _SEEN + """, p AS (SELECT session_id, count(*) AS n, max(id) AS last, sum(('0x' || sha256(id || '|' || coalesce(role, '') || '|' || coalesce(content, ''))[1:12])::HUGEINT) AS mark FROM v GROUP BY 1) SELECT session_id, n, sha256(n || '|' || last || '|' || mark) AS version FROM p"""
ORACLE = {
    "turn_queue": f"WITH {TURN_CTE} SELECT id, CASE WHEN extraction_status = 'done' THEN 'done' WHEN coalesce(extraction_attempts, 0) >= 3 THEN 'dead_letter' ELSE 'pending' END AS status, coalesce(extraction_attempts, 0)::INT AS attempts FROM t WHERE trim(coalesce(user_text, ''), ' ') <> '' OR trim(coalesce(assistant_text, ''), ' ') <> ''",
    "telemetry_retention": "SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-11') AS n_old, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-11' AND n > 1500) AS n_beyond FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IS NOT NULL) GROUP BY 1",
    "field_updates": MEM + """, k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY id) AS n FROM m), x AS (SELECT k.id, CASE event_type WHEN 'view' THEN 'visibility' WHEN 'signup' THEN 'status' WHEN 'click' THEN 'type' ELSE 'id' END AS field, CASE event_type WHEN 'view' THEN 'shared' WHEN 'signup' THEN 'archived' WHEN 'click' THEN 'fact' ELSE 'x' END AS value,
      CASE event_type WHEN 'view' THEN visibility WHEN 'signup' THEN status WHEN 'click' THEN type END AS old FROM events v JOIN k ON k.agent = 'agent-' || (v.user_id % 8) AND k.n = v.event_id % 40 + 1)
      SELECT field, CASE WHEN field = 'id' THEN 'rejected' WHEN old IS NOT DISTINCT FROM value THEN 'unchanged' ELSE 'applied' END AS outcome, count(*) AS n, count(DISTINCT id) AS n_memories FROM x GROUP BY 1, 2""",
    "claim_replacements": _MADE + r""", o AS (SELECT claim_id, object, lag(claim_id) OVER w AS replaced, lag(object) OVER w AS b FROM c WHERE status = 'active' WINDOW w AS (PARTITION BY agent, key, predicate ORDER BY observed_at NULLS FIRST, claim_id))
      SELECT claim_id, replaced, md5(b) AS before_md5, md5(object) AS after_md5 FROM o WHERE replaced IS NOT NULL AND regexp_replace(lower(trim(b, ' .!?')), '\s+', ' ', 'g') <> regexp_replace(lower(trim(object, ' .!?')), '\s+', ' ', 'g')""",
    "sessions_by_day": f"WITH {MSG_CTE}, {SES_CTE} SELECT (timestamp AT TIME ZONE 'UTC')::DATE AS day, count(DISTINCT session_id) AS n_sessions, count(*) AS n_messages FROM g WHERE {_VIS} AND timestamp IS NOT NULL AND session_id IN (SELECT id FROM s WHERE NOT coalesce(hidden, false) AND NOT coalesce(source IN ('kanban', 'subagent', 'tool'), false)) GROUP BY 1",
    "reextract_diff": "WITH vv AS (SELECT id, coalesce(epoch_us(updated_at), 0) AS a, content FROM memories WHERE id IS NOT NULL AND content IS NOT NULL), no_ AS (@OLD), nn_ AS (@NEW), f AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'gained' WHEN n.id IS NULL THEN 'lost' ELSE 'kept' END AS change FROM no_ o FULL JOIN nn_ n ON o.id = n.id AND o.k = n.k) SELECT change, count(*) AS n, count(DISTINCT id) AS n_memories FROM f GROUP BY 1",
    "entity_lookup": MEM + f", {LINK_CTE}, {_ENT} SELECT * FROM nm",
    "graph_expansions": MEM + f", {LINK_CTE}, {_ENT}" + r""", wd AS (SELECT id, agent, regexp_split_to_array(trim(name, ' '), ' +') AS w FROM en WHERE agent IS NOT NULL),
      ph AS (SELECT id AS query_id, agent, list_concat(list_concat(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) ELSE [] END), w) AS p FROM wd),
      pd AS (SELECT query_id, agent, list_slice(list_filter(p, lambda x, i: list_position(p, x) = i), 1, 8) AS p FROM ph), pe AS (SELECT query_id, agent, i AS pos, p[i] AS name FROM pd, unnest(range(1, len(p) + 1)) AS r(i)), sd AS (SELECT query_id, pe.agent, nm.id, min(pos) AS pos FROM pe JOIN nm ON nm.agent = pe.agent AND nm.key = @K GROUP BY 1, 2, 3),
      ac AS (SELECT l.memory_id, l.entity_id, m.agent FROM l JOIN m ON m.id = l.memory_id WHERE m.status = 'active'), kk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY entity_id) AS r FROM ac) WHERE r <= 15), eg AS (SELECT DISTINCT x.agent, x.entity_id AS a, y.entity_id AS b FROM kk x JOIN kk y ON x.memory_id = y.memory_id AND x.entity_id <> y.entity_id),
      al AS (SELECT query_id, id, 0 AS hop, pos FROM sd UNION ALL SELECT query_id, eg.b, 1, pos FROM sd JOIN eg ON eg.agent = sd.agent AND eg.a = sd.id), ff AS (SELECT query_id, min((hop, pos, lower(name), name)) AS f FROM al JOIN en ON en.id = al.id GROUP BY query_id, lower(name))
      SELECT query_id, f[4] AS name, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS place FROM ff) WHERE place <= 5""".replace("@K", _EKEY.replace("lower(name)", "lower(pe.name)")),
    "entity_salience": MEM + _NAMES + ", ct AS (SELECT id, lower(name) AS low, count(*) AS c FROM nx WHERE len(name) >= 3 GROUP BY 1, 2), sl AS (SELECT nt.id, f[3] AS name, c * (1 + 0.5 * len(string_split(f[3], ' ')))::DOUBLE AS s, rank FROM nt JOIN ct ON ct.id = nt.id AND ct.low = nt.low) SELECT id, name, round(s, 6) AS salience, row_number() OVER (PARTITION BY id ORDER BY s DESC, rank) AS place FROM sl",
    "relation_evidence": _EDGE_SQL[: _EDGE_SQL.rindex("SELECT a AS name_a")] + "SELECT DISTINCT a AS name_a, b AS name_b, z.id AS memory_id FROM z JOIN m ON m.id = z.id WHERE m.status = 'active'",
    "claim_identities": MEM + ", " + _PARTS + " SELECT id, identity FROM cl",
    "near_identity_dedup": MEM + ", " + _PARTS + " SELECT agent, visibility, arg_min(id, (coalesce(epoch_us(created_at), 0), id)) AS kept_id, count(*) AS n, sum(coalesce(seen_count, 1))::BIGINT AS seen FROM cl WHERE status = 'active' GROUP BY agent, visibility, identity HAVING count(*) > 1",
    "claims_from_tags": _MADE + " SELECT id, agent, tags[1] AS subject, 'states' AS predicate, md5(rtrim(regexp_replace(trim(content, ' '), '[.?!]+$', ''), ' ')) AS object_md5 FROM m WHERE status = 'active' AND content IS NOT NULL AND len(tags) > 0 AND id NOT IN (SELECT memory_id FROM c)",
    "migrated_links": MEM + " SELECT coalesce(m.agent, '') AS agent, 1.0::DOUBLE AS strength, count(*) AS n FROM memory_entities e LEFT JOIN m ON m.id = e.memory_id WHERE e.memory_id IS NOT NULL GROUP BY 1",
    "prefetch_context": "@PREFETCH",
    "bank_import": MEM + f" SELECT doc_id, hash FROM (SELECT sha256({KEY('text')}) AS hash, min(doc_id) AS doc_id FROM documents WHERE starts_with(source, 'import:bank') AND list_has_any({TOKENS('text')}, ['project', 'preference', 'decision', 'person', 'tool'])" + r" AND NOT (regexp_matches(text, '(?:^|[^\p{L}\p{N}_])[0-9]{1,3}\s*%') OR regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])percent(?:[^\p{L}\p{N}_]|$)') OR regexp_matches(text, '(?:^|[^\p{L}\p{N}_])[0-9]{1,2}:[0-9]{2}(?:\s*[aApP][mM])?(?:[^\p{L}\p{N}_]|$)'))"
      + f" GROUP BY 1) WHERE hash NOT IN (SELECT sha256({KEY('content')}) FROM m WHERE content IS NOT NULL) ORDER BY doc_id LIMIT 200",
    "dream_window": MEM + ", k AS (SELECT * FROM m WHERE status = 'active' AND visibility IN ('shared', 'fleet') AND created_at IS NOT NULL) SELECT id, agent FROM k JOIN (SELECT agent, max(created_at) AS n FROM k GROUP BY 1) USING (agent) WHERE n - created_at <= INTERVAL 1 DAY",
    "iso_times": "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE date_trunc('second', created_at) - CASE WHEN doc_id % 4 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS at FROM documents WHERE created_at IS NOT NULL",
    "vector_pack": "SELECT memory_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 THEN len(embedding)::INT END AS n FROM (SELECT DISTINCT memory_id, embedding FROM memory_vectors WHERE memory_id IS NOT NULL AND embedding IS NOT NULL)",
    "signal_weights": "SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.0 WHEN 'click' THEN 0.6 WHEN 'signup' THEN 0.4 WHEN 'view' THEN 0.2 ELSE 0 END::DOUBLE), 6) AS total, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS n_explicit FROM events GROUP BY 1",
    "utility_by_archetype": _UT + """, a AS (SELECT memory_id, signal_type, sum(CASE WHEN direction > 0 THEN d ELSE 0 END) AS p, sum(CASE WHEN direction < 0 THEN d ELSE 0 END) AS n FROM w GROUP BY 1, 2), b AS (SELECT memory_id, sum(p) AS gp, sum(n) AS gn FROM a GROUP BY 1), c AS (SELECT memory_id, signal_type, p + 0.25 * gp AS pos, n + 0.25 * gn AS neg FROM a JOIN b USING (memory_id))
      SELECT memory_id, signal_type, round(pos, 6) AS pos, round(neg, 6) AS neg, round((2 + pos) / (4 + pos + neg), 6) AS mean, round(1 - exp(-(pos + neg) / 10), 6) AS confidence FROM c""",
    "insert_or_replace": "WITH r AS (SELECT DISTINCT id, coalesce(epoch_us(updated_at), 0) AS a, coalesce(status, 'active') AS status FROM memories WHERE id IS NOT NULL) SELECT id, max(a) AS at, arg_max(status, (a, status)) AS status, count(*) FILTER (WHERE a % 2 = 0) = 0 AS new FROM r GROUP BY id",
}


def _late() -> None:
    from evidenza.plans import evidence
    from evidenza.plans import recall as plans

    digest = _SEEN_DIGEST
    early = digest.replace("AND session_id IS NOT NULL)", "AND session_id IS NOT NULL AND timestamp < TIMESTAMPTZ '2025-03-01 00:00:00+00')")
    ORACLE["reference_validation"] = f"WITH w AS ({early}), n AS ({digest}) SELECT w.session_id, coalesce(w.version = n.version, false) AS valid FROM w LEFT JOIN n ON n.session_id = w.session_id"
    key = _EKEY.replace("lower(name)", "lower(f[3])")
    of = lambda pick: f"WITH m AS (SELECT id, {pick}(content, (a, content)) AS content FROM vv GROUP BY 1)" + _NAMES + f" SELECT DISTINCT id, {key} AS k FROM nt"
    ORACLE["reextract_diff"] = ORACLE["reextract_diff"].replace("@OLD", of("arg_min")).replace("@NEW", of("arg_max"))
    ORACLE["recall_metrics"] = f"WITH MEMR AS ({plans.ORACLE['recall_memories']}), q AS ({MEM} SELECT id FROM m WHERE status = 'active' AND ('0x' || md5(id)[1:4])::INT % 20 = 0) SELECT q.id AS query_id, @R(1) AS recall_1, @R(3) AS recall_3, @R(5) AS recall_5, round(coalesce(1.0::DOUBLE / rank, 0), 6) AS mrr, round(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END, 6) AS ndcg_5 FROM q LEFT JOIN MEMR ON MEMR.query_id = q.id AND MEMR.id = q.id"
    for k in (1, 3, 5):
        ORACLE["recall_metrics"] = ORACLE["recall_metrics"].replace(f"@R({k})", f"round(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE, 6)")
    base, made = plans.ORACLE["recall_memories"], _MADE
    from evidenza.plans import upkeep

    # the terms of each turn, found by the words of each, then the greedy packing of the best five of each term
    terms = upkeep.ORACLE["query_expansions"]
    gate = evidence.ORACLE["archetype_classify"]
    lane = plans._bm25("status = 'active'", "content || ' ' || coalesce(array_to_string(tags, ' '), '')", "true", 5, "visibility IN ('private', 'shared')")
    first = lane.index("q AS (SELECT id AS query_id")
    lane = lane[: lane.index("qw AS (")] + "q AS (SELECT query_id, agent, unnest(list_distinct(regexp_extract_all(lower(term), '[a-z0-9]+'))) AS term FROM ex)," + lane[lane.index(" st AS (", first) :]
    ORACLE["prefetch_context"] = "WITH RECURSIVE " + MEM[len("WITH ") :] + f""", ts AS ({terms}), gt AS ({gate}), ag AS (SELECT id, any_value(agent_id) AS agent FROM turns WHERE id IS NOT NULL GROUP BY id),
      ex AS (SELECT id || '#' || (i - 1) AS query_id, id AS turn, i - 1 AS pos, agent, l[i] AS term FROM (SELECT ts.id, agent, string_split(terms, '|') AS l FROM ts JOIN gt ON gt.id = ts.id AND gt.needs_memory JOIN ag ON ag.id = ts.id WHERE agent IS NOT NULL AND terms <> ''), unnest(range(1, len(l) + 1)) AS r(i)), {lane},
      fo AS (SELECT turn, kw.id, min((pos, rank)) AS f FROM kw JOIN ex ON ex.query_id = kw.query_id GROUP BY 1, 2), co AS (SELECT fo.turn, fo.id, greatest(1, ceil(len(m.content) / 3))::INT AS cost, row_number() OVER (PARTITION BY fo.turn ORDER BY f, fo.id) AS n FROM fo JOIN m ON m.id = fo.id),
      gr AS (SELECT turn, n, id, cost, CASE WHEN cost <= 200 THEN cost ELSE 0 END AS used, cost <= 200 AS kept FROM co WHERE n = 1 UNION ALL SELECT co.turn, co.n, co.id, co.cost, gr.used + CASE WHEN gr.used + co.cost <= 200 THEN co.cost ELSE 0 END, gr.used + co.cost <= 200 FROM gr JOIN co ON co.turn = gr.turn AND co.n = gr.n + 1)
      SELECT turn::VARCHAR AS turn, count(*) AS n, sum(cost)::BIGINT AS tokens, md5(string_agg(id, ',' ORDER BY n)) AS digest FROM gr WHERE kept GROUP BY 1"""
    ORACLE["recall_claims"] = f"WITH rr AS ({base}), cc AS ({made} SELECT memory_id, arg_max(claim_id, (observed_at, claim_id)) AS claim_id, arg_max(predicate, (observed_at, claim_id)) AS predicate FROM c GROUP BY 1) SELECT query_id, rr.id, rank, claim_id, predicate FROM rr LEFT JOIN cc ON cc.memory_id = rr.id"


_late()
