"""Queries on records as they are kept: claims from texts, entities by sentence, pages of the archive, checks and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidenza.functions import scoring, text
from evidenza.operators import claims, graph, history, lifecycle
from evidenza.plans.archive import _SEEN
from evidenza.plans.sql import KEY, LINK_CTE, MEM, NOW
from evidenza.runtime import numbered, table
from evidenza.sources import tables


# claims
def memory_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.projected(tables.memories(spark, sf_dir)).select("claim_id", "agent", "subject", "predicate", F.md5("object").alias("object_md5"))


def _claims_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims.projected(tables.memories(spark, sf_dir).where("status = 'active'"))
    w = Window.partitionBy("agent", text.claim_value(F.col("subject")), "predicate").orderBy("observed_at", "claim_id")
    return c.withColumn("before", F.lag("object").over(w))


def memory_claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims_before(spark, sf_dir)
    return c.select("claim_id", claims.text_conflict(F.col("sentence"), F.col("before"), F.col("object")).alias("conflict"))


def memory_claim_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest claim of each subject and predicate of an agent, of active memories, with its memory's trust."""
    m = tables.memories(spark, sf_dir).where("status = 'active'")
    c = claims.projected(m).withColumn("key", text.claim_value(F.col("subject")))
    best = claims.latest_active(c, ["agent", "key", "predicate"], "observed_at", "claim_id")
    return best.join(m.select(F.col("id").alias("memory_id"), "trust"), "memory_id").select("agent", "key", "predicate", "claim_id", "trust")


def claims_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active memories that no claim was made of."""
    m = tables.memories(spark, sf_dir).where("status = 'active'")
    return m.join(claims.projected(m).select(F.col("memory_id").alias("id")), "id", "left_anti").select("id")


def condition_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a memory's tags, as conditions, are met by its words; no conditions are met by all."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_-]+"), F.lit(0))
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    return tables.memories(spark, sf_dir).select("id", ((tags == "") | F.arrays_overlap(words(tags), words(F.col("content")))).alias("matches"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(content, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), '\n[ \t]*\n', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_VERB = r"'(?i)^(prefers?|likes?|uses?|works on|owns?|lives in|is named)\s+([^\n]+)\z'"
_CLAIMS = r""", sx AS (SELECT id, agent, confidence, created_at, status, s, i FROM (SELECT *, @SENT AS ss FROM m WHERE content IS NOT NULL), unnest(range(1, len(ss) + 1)) AS r(i), LATERAL (SELECT ss[i] AS s)),
c0 AS (SELECT *, split_part(s, ' ', 1) AS subject, rtrim(regexp_replace(trim(s, ' '), '[.?!]+$', ''), ' ') AS b FROM sx),
c1 AS (SELECT *, CASE WHEN starts_with(lower(b), lower(subject)) AND len(subject) > 0 AND regexp_matches(substring(b, len(subject) + 1, 1), '\s') THEN regexp_replace(substring(b, len(subject) + 1), '^\s+', '') ELSE b END AS r0 FROM c0),
c2 AS (SELECT *, regexp_replace(r0, '(?i)^(?:now|currently|still)\s+', '') AS r FROM c1),
c AS (SELECT id || '#' || (i - 1) AS claim_id, id AS memory_id, agent, status, created_at AS observed_at, confidence, s AS sentence, subject, regexp_replace(lower(regexp_extract(r, @V, 1)), '\s+', '_', 'g') AS predicate, trim(regexp_extract(r, @V, 2), ' ') AS object,
  regexp_replace(lower(trim(subject, ' .!?')), '\s+', ' ', 'g') AS key FROM c2 WHERE r <> b AND regexp_extract(r, @V, 1) <> '' AND lower(subject) <> 'general')""".replace("@SENT", _SENTENCES).replace("@V", _VERB)
_MADE = MEM + _CLAIMS


# entities
def sentence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of names within one sentence: how often, in how many memories."""
    e = graph.sentence_edges(tables.memories(spark, sf_dir).where("content IS NOT NULL"), "id", "content")
    return e.groupBy("name_a", "name_b", "relation").agg(F.count("*").alias("strength"), F.countDistinct("id").alias("n_evidence"))


def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").where("name IS NOT NULL")
    return e.select("id", F.coalesce(graph.entity_type(F.col("name")), F.lit("unknown")).alias("guess")).distinct()


def visible_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that agent-2 may see: its own, and those of no agent that a memory of it is linked to."""
    mine = tables.links(spark, sf_dir).join(tables.memories(spark, sf_dir).where("agent = 'agent-2'").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    e = table(spark, sf_dir, "entities").select("id", "agent").distinct()
    own = e.where("agent = 'agent-2'")
    shared = e.where("agent IS NULL").join(mine.select(F.col("entity_id").alias("id")), "id", "left_semi")
    return own.unionByName(shared).select("id")


def cross_agent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links stated by another agent than the memory's own."""
    m = tables.memories(spark, sf_dir).select(F.col("id").alias("memory_id"), F.col("agent").alias("owner"))
    e = table(spark, sf_dir, "memory_entities").where("entity_id IS NOT NULL")
    return e.join(m, "memory_id").where("agent <> owner").groupBy("owner", "agent").agg(F.count("*").alias("n"))


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's name asked by its agent, over the links of that agent's own active memories."""
    e = tables.latest(table(spark, sf_dir, "entities"), "id", "name").where("name IS NOT NULL AND agent IS NOT NULL").select("id", "agent", text.entity_key(F.col("name")).alias("name_key"))
    q = e.select(F.col("id").alias("query_id"), "agent", "name_key")
    return graph.searched(q, e, tables.links(spark, sf_dir), tables.memories(spark, sf_dir))


_EKEY = r"trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}. ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"
_NAMES = r""", sx AS (SELECT id, i, s FROM (SELECT *, @SENT AS ss FROM m WHERE content IS NOT NULL), unnest(range(1, len(ss) + 1)) AS r(i), LATERAL (SELECT ss[i] AS s)),
nx AS (SELECT id, i, s, p, regexp_replace(regexp_replace(nn[p], '[ \t\r\n]+', ' ', 'g'), '(?i)^(?:(?:@STOP)(?: |$))+', '') AS name FROM (SELECT *, regexp_extract_all(s, '(?:^|[^A-Za-z0-9_])([A-Z][a-zA-Z0-9]+(?:[ \t\r\n]+[A-Z][a-zA-Z0-9]+)*)', 1) AS nn FROM sx), unnest(range(1, len(nn) + 1)) AS r(p)),
nk AS (SELECT id, lower(name) AS low, min((i, p, name)) AS f, len(string_split(lower(name), ' ')) AS w FROM nx WHERE len(name) >= 3 GROUP BY 1, 2),
nr AS (SELECT id, low, f, row_number() OVER (PARTITION BY id ORDER BY w DESC, f) AS rank FROM nk a WHERE NOT EXISTS (SELECT 1 FROM nk b WHERE b.id = a.id AND b.w > a.w AND contains(' ' || b.low || ' ', ' ' || a.low || ' '))),
nt AS (SELECT * FROM nr WHERE rank <= 15)""".replace("@SENT", _SENTENCES).replace("@STOP", "|".join(graph.NO_NAMES))
_REL = [("uses", "uses|utilizes|employs|runs on|relies on|is built on|is powered by|is based on|is running on"), ("depends_on", "depends on|requires|needs|consumes"), ("owns", "owns|has|contains|includes|comprises"), ("manages", "manages|controls|administers|orchestrates|coordinates"),
        ("created", "created|built|developed|wrote|designed|authored|established|set up|configured"), ("interacts_with", "connects to|talks to|sends to|interacts with|communicates with|integrates with|syncs with|pulls from|pushes to"), ("monitors", "monitors|watches|tracks|observes|surveys|scans"),
        ("references", "references|links to|cites|mentions|points to|refers to"), ("part_of", "is part of|belongs to|is a member of|is a component of"), ("uses", "is used by"), ("owns", "is owned by"), ("manages", "is managed by|is controlled by"), ("created", "is created by|is built by|is developed by"),
        ("monitors", "is monitored by"), ("references", "is referenced by"), ("co_occurs", "and|or|with|alongside|beside|plus")]
_TYPES = [("service", "server|daemon|service|api|endpoint|proxy|agent"), ("project", "project|repo|repository|pipeline|migration|build"), ("tool", "tool|cli|editor|ide|framework|library|plugin"), ("place", "lab|datacenter|office|region|rack|site"), ("person", "sister|brother|colleague|friend|manager|wife|husband"), ("concept", "policy|preference|rule|protocol|standard|plan")]


def _case(column: str, classes: list, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{w}') THEN '{n}'" for n, w in classes) + f" ELSE '{otherwise}' END"


# records
def recent_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).where((F.col("status") == "active") & (F.col("created_at") >= F.lit("2025-05-01 00:00:00").cast("timestamp"))).select("id", "agent", "created_at")


def recent_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 newest active memories that have a vector."""
    v = table(spark, sf_dir, "memory_vectors").where("embedding IS NOT NULL").select(F.col("memory_id").alias("id"))
    return tables.memories(spark, sf_dir).where("status = 'active'").join(v, "id", "left_semi").orderBy(F.desc_nulls_last("created_at"), "id").limit(500).select("id")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with what their stored rows say of them, defaults where there is none."""
    v = table(spark, sf_dir, "memory_vectors").where("memory_id IS NOT NULL").select(F.col("memory_id").alias("id")).distinct()
    m = tables.memories(spark, sf_dir).select("id", "agent", "source", "type", "source_id", F.get_json_object("metadata", "$.seen_in").alias("seen_in"))
    return v.join(m, "id", "left").select("id", F.coalesce("agent", F.lit("unknown")).alias("agent"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("type", F.lit("fact")).alias("type"), F.coalesce("source_id", F.lit("")).alias("source_id"), "seen_in")


def shareable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).where(F.lower(F.trim("visibility")).isin("shared", "fleet")).select("id", "agent")


def mutation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether agent-1 may change each memory: its own, active, and unchanged since its hash was taken."""
    stale = ~F.lower("content_hash").eqNullSafe(F.sha2("content", 256))
    verdict = F.when(F.col("agent") != "agent-1", "not owner").when(F.col("status") != "active", "not active").when(stale, "stale").otherwise("ok")
    return tables.memories(spark, sf_dir).select("id", verdict.alias("verdict"))


def contradiction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many memories contradict each, and the trust left: 0.1 less for each, but not less than 0.3."""
    m = tables.memories(spark, sf_dir).where("status = 'active'")
    p = lifecycle.contradictions(m, tables.links(spark, sf_dir))
    n = p.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    t = scoring.or_half(F.col("trust"))
    return m.join(n, "id").select("id", "n", F.round(F.greatest(t - 0.1 * F.col("n"), F.lit(0.3)), 6).alias("trust"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir)
    return m.select("id", text.fingerprint(F.col("content")).alias("fingerprint"), text.fingerprint(F.concat_ws("|", "agent", F.coalesce("source_id", F.lit("")), text.fingerprint(F.col("content")))).alias("activation"))


def fact_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with confidence in 0 to 1 and known types and visibilities only."""
    c = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))))
    known = lambda c, xs, d: F.when(F.col(c).isin(*xs), F.col(c)).otherwise(d)
    return tables.memories(spark, sf_dir).select("id", F.round(c, 6).alias("confidence"), known("type", ("fact", "observation", "document", "conversation"), "fact").alias("type"), known("visibility", ("private", "shared", "fleet"), "private").alias("visibility"))


def json_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object in each memory's metadata, also behind other words."""
    wrapped = F.when(F.pmod(F.length("content"), F.lit(2)) == 0, F.concat(F.lit("Sure: "), F.col("metadata"), F.lit(" ok"))).otherwise(F.col("metadata"))
    return tables.memories(spark, sf_dir).where("content IS NOT NULL").select("id", text.json_slice(wrapped).alias("object"))


def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("block", text.frontmatter(F.col("text"))).where("block IS NOT NULL")
    f = lambda n: text.frontmatter_field(F.col("block"), n)
    return d.select("doc_id", f("type").alias("type"), f("status").alias("status"), f("created").try_cast("date").alias("created"), (f("locked") == "true").alias("locked"), F.array_join(text.frontmatter_tags(F.col("block")), "|").alias("tags"))


def query_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.turns(spark, sf_dir).where("user_text IS NOT NULL")
    return t.select("id", F.array_join(text.expansions(F.col("user_text")), "|").alias("terms"), text.retrieval_words(F.col("user_text")).alias("words"))


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each memory as evidence, and the line it is shown as."""
    m = tables.memories(spark, sf_dir).where("content IS NOT NULL")
    kind = F.when(F.col("status").isin("unresolved", "contradicted"), "uncertainty").when(F.col("source").isin("vault", "document", "import") | (F.col("type") == "document"), "provenance").otherwise("current")
    label = F.when(F.col("status").isin("unresolved", "contradicted"), "Unresolved conflict").otherwise("Memory")
    line = F.concat(F.lit("- ["), F.col("visibility"), F.lit("] "), label, F.lit(" [m:"), F.substring("id", 1, 12), F.lit("]: "), text.safe(F.col("content")))
    return m.select("id", F.coalesce(kind, F.lit("current")).alias("class"), F.md5(line).alias("line_md5"))


def owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).groupBy("agent").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("n_active"), F.max(F.coalesce("updated_at", "created_at")).alias("changed_at"))


def stale_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inactive memories whose source is no document of the vault."""
    d = table(spark, sf_dir, "documents").select(F.col("path").alias("source_id")).where("source_id IS NOT NULL")
    return tables.memories(spark, sf_dir).where("status <> 'active'").join(d, "source_id", "left_anti").select("id", "status")


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory id that any table names, and by how many tables."""
    part = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("id"), F.lit(t).alias("t")).where("id IS NOT NULL").distinct()
    return part("memories", "id").unionByName(part("memory_vectors", "memory_id")).unionByName(part("memory_entities", "memory_id")).groupBy("id").agg(F.count("*").alias("n_tables"))


def shadow_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place each memory of an agent would have by trust alone."""
    m = tables.memories(spark, sf_dir).select("agent", "id", scoring.or_half(F.col("trust")).alias("score"))
    return numbered(m, ["agent"], [F.desc("score"), "id"], "rank").select("agent", "id", "rank")


def import_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of memory files to be taken over: each distinct content once, with the visibility its words suggest, unless stored already."""
    from evidenza.sources.files import entry_lines

    e = entry_lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text").withColumn("hash", text.content_hash(F.col("entry")))
    first = e.groupBy("hash").agg(F.min(F.struct("doc_id", "line", "entry")).alias("f"), F.count("*").alias("n"))
    stored = tables.memories(spark, sf_dir).where("content IS NOT NULL").select(text.content_hash(F.col("content")).alias("hash"))
    return first.join(stored, "hash", "left_anti").select("hash", F.col("f.doc_id").alias("doc_id"), F.col("f.line").alias("line"), "n", text.visibility_guess(F.col("f.entry")).alias("visibility"))


# archive
def session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.candidates(tables.sessions(spark, sf_dir), tables.messages(spark, sf_dir), "2025-02-01 00:00:00", "2025-03-01 00:00:00")
    return history.page(rows, [F.asc_nulls_last("started_at"), "id"], 5).select("id", "has_more")


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.messages(spark, sf_dir).where(history.visible_message() & F.col("session_id").isNotNull())
    return g.groupBy("session_id").agg(F.min("timestamp").alias("first_at"), F.min("id").alias("first_id"), F.count("*").alias("n"))


def message_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pages(tables.messages(spark, sf_dir))


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.scanned(tables.messages(spark, sf_dir), 1000, 1500, "lantern")


def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.merged_hits(tables.messages(spark, sf_dir), ["lantern", "kettle"], "lant")


def topic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = history.topic_evidence(tables.messages(spark, sf_dir), ["lantern", "kettle"])
    return e.select("session_id", "id", "turn", "kind", F.md5("excerpt").alias("excerpt_md5"))


def delivery_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a session whose context is the same as that of the turn before, which need not be delivered again."""
    t = tables.turns(spark, sf_dir).where("session_id IS NOT NULL").select("session_id", "id", "created_at", text.fingerprint(F.col("user_text")).alias("hash"))
    n = numbered(t, ["session_id"], [F.asc_nulls_first("created_at"), "id"])
    before = n.select("session_id", (F.col("n") + 1).alias("n"), F.col("hash").alias("before"))
    return n.join(before, ["session_id", "n"], "left").select("session_id", "id", "n", F.coalesce(F.col("hash") == F.col("before"), F.lit(False)).alias("suppressed"))


# feedback and rollups
def receipt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts opened by views: closed by a purchase of the same user within 300 s, else expired."""
    from evidenza.operators import feedback

    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    closed = feedback.closed_receipts(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id").groupBy("opened_id").agg(F.min("closing_id").alias("closing_id"))
    return e.where("event_type = 'view'").join(closed, F.col("id") == F.col("opened_id"), "left").select("id", F.when(F.col("closing_id").isNull(), "expired").otherwise("closed").alias("state"), "closing_id")


def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three jobs of each agent: highest priority first, then the oldest."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("agent", F.concat(F.lit("agent-"), (F.col("user_id") % 8).cast("string"))).withColumn("priority", F.floor(F.col("value") / 10).cast("bigint"))
    w = Window.partitionBy("agent").orderBy(F.desc("priority"), "event_id")
    return e.withColumn("n", F.row_number().over(w)).where("n <= 3").select("agent", "event_id", "priority", "n")


def percentile_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles at index int(n * share) - 1, but not below 0, over all values."""
    n = numbered(table(spark, sf_dir, "events").where("value IS NOT NULL AND event_type IS NOT NULL").select("event_type", "value", "event_id"), ["event_type"], ["value", "event_id"])
    sizes = n.groupBy("event_type").agg(F.count("*").alias("all"))
    want = sizes.select("event_type", "all", F.explode(F.array(F.lit(0.5), F.lit(0.95))).alias("share"))
    want = want.withColumn("n", F.least(F.col("all"), F.greatest(F.lit(1), F.floor(F.col("all") * F.col("share")))).cast("bigint"))
    return want.join(n, ["event_type", "n"]).select("event_type", "share", "value")


def evidence_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of each agent that changes with any change of its evidence."""
    raw = table(spark, sf_dir, "memories").where("id IS NOT NULL AND agent IS NOT NULL")
    return raw.groupBy("agent").agg(F.countDistinct("id", F.coalesce(F.unix_micros("updated_at"), F.lit(0)), F.coalesce("status", F.lit(""))).alias("generation"))


def scale_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published benchmark recipe in closed form: 5,000 vectors of 768 elements, seven probes, ten nearest each."""
    from evidenza.operators import search

    return search.semantic(recipe_vectors(spark), "id", "vec", recipe_probes(spark), 10, -1.0).withColumn("score", F.round("score", 6))


def recipe_vectors(spark: SparkSession, n: int = 5000, dims: int = 768) -> DataFrame:
    each = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: (F.pmod(j * 73 + F.col("id") * 37, F.lit(997)) + 1).cast("double") / 997)
    return spark.range(n).select("id", each.alias("vec"))


def recipe_probes(spark: SparkSession, n: int = 7, dims: int = 768) -> DataFrame:
    each = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: (F.pmod(j * 73 + F.col("p"), F.lit(199)) + 1).cast("double") / 199)
    return spark.range(n).select((-1 - F.col("id")).alias("query_id"), F.col("id").alias("p")).select("query_id", each.alias("vec"))


QUERIES = {f.__name__: f for f in (
    memory_claims, memory_claim_conflicts, memory_claim_active, claims_missing, condition_match, sentence_edges, entity_types, visible_entities, cross_agent_links, graph_search, recent_since, recent_vectors, enriched, shareable, mutation_guard, contradiction_flags,
    fingerprints, fact_normalized, json_slices, frontmatter_fields, query_expansions, evidence_lines, owner_counts, stale_inactive, known_ids, shadow_rank, import_entries, session_page, session_rollup, message_pages, raw_scan, merged_hits, topic_evidence, delivery_suppression,
    receipt_states, job_claims, percentile_truncated, evidence_generation, scale_recipe,
)}
_BLOCK = r"nullif(regexp_extract(text, '^---[ \t]*\r?\n([\s\S]*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)', 1), '')"
_FIELD = r"nullif(trim(regexp_extract(block, '(?m)^%s:[ \t]*([^\r\n]*)', 1), ' ' || chr(9) || '\"'''), '')"
_STOPS = "('" + "','".join("the a an is are was were be of to in on for and or what who where how why did do does i you we they my your our me us".split()) + "')"
_ASKS = "('" + "','".join("a an and are can did does do for from how i in is it me my of on please the according another based computer mention mentioned say says tell told their then they to was we what when where which who why would you your".split()) + "')"
_NOQ = r"regexp_replace(user_text, '(?i)(?:^|[^\p{L}\p{N}_])(?:when|then|before|previously|used to|historical|history|at that time)(?:[^\p{L}\p{N}_]|$)', ' ', 'g')"
ORACLE = {
    "memory_claims": _MADE + " SELECT claim_id, agent, subject, predicate, md5(object) AS object_md5 FROM c",
    "memory_claim_conflicts": _MADE + r""", o AS (SELECT *, lag(object) OVER (PARTITION BY agent, key, predicate ORDER BY observed_at NULLS FIRST, claim_id) AS b FROM c WHERE status = 'active'),
      v AS (SELECT *, regexp_replace(lower(trim(b, ' .!?')), '\s+', ' ', 'g') = regexp_replace(lower(trim(object, ' .!?')), '\s+', ' ', 'g') AS same FROM o)
      SELECT claim_id, CASE WHEN b IS NULL THEN 'compatible' WHEN regexp_matches(sentence, '(?i)(?:^|[^\p{L}\p{N}_])(?:switched|changed|updated|now prefers?|no longer|instead of|correction)(?:[^\p{L}\p{N}_]|$)') AND NOT same THEN 'update' WHEN same THEN 'duplicate'
        WHEN regexp_matches(sentence, '(?i)(?:^|[^\p{L}\p{N}_])(?:switched|changed|updated|now prefer|no longer|instead of|from [^\n]+ to)(?:[^\p{L}\p{N}_]|$)') THEN 'update' ELSE 'unresolved' END AS conflict FROM v""",
    "memory_claim_active": _MADE + " SELECT x.agent, key, predicate, claim_id, m.trust FROM (SELECT *, row_number() OVER (PARTITION BY agent, key, predicate ORDER BY observed_at DESC NULLS LAST, claim_id DESC) AS r FROM c WHERE status = 'active') x JOIN m ON m.id = x.memory_id WHERE r = 1",
    "claims_missing": _MADE + " SELECT id FROM m WHERE status = 'active' AND id NOT IN (SELECT memory_id FROM c)",
    "condition_match": MEM + " SELECT id, coalesce(array_to_string(tags, ' '), '') = '' OR list_has_any(regexp_extract_all(lower(array_to_string(tags, ' ')), '[a-z0-9_-]+'), regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9_-]+')) AS matches FROM m",
    "sentence_edges": MEM + _NAMES + r""", w AS (SELECT DISTINCT n.id, n.i, n.s, lower(n.name) AS low FROM nx n JOIN nt t ON t.id = n.id AND t.low = lower(n.name)), p AS (SELECT x.id, x.i, x.low AS a, y.low AS b, lower(regexp_replace(x.s, '[ \t\r\n]+', ' ', 'g')) AS s FROM w x JOIN w y ON x.id = y.id AND x.i = y.i AND x.low < y.low),
      q AS (SELECT *, least(instr(s, a), instr(s, b)) AS h, greatest(instr(s, a), instr(s, b)) AS t, CASE WHEN instr(s, a) < instr(s, b) THEN len(a) ELSE len(b) END AS f FROM p), z AS (SELECT *, trim(substring(s, h + f, greatest(0, t - h - f)), ' ') AS g FROM q)
      SELECT a AS name_a, b AS name_b, """ + _case("g", _REL, "related_to") + " AS relation, count(*) AS strength, count(DISTINCT id) AS n_evidence FROM z GROUP BY 1, 2, 3",
    "entity_extract": MEM + _NAMES + " SELECT id, f[3] AS name, rank FROM nt",
    "entity_types": "SELECT DISTINCT id, " + _case("lower(name)", _TYPES, "unknown") + " AS guess FROM entities WHERE name IS NOT NULL",
    "visible_entities": MEM + " SELECT DISTINCT id FROM entities WHERE agent = 'agent-2' OR (agent IS NULL AND id IN (SELECT entity_id FROM memory_entities e JOIN m ON m.id = e.memory_id WHERE m.agent = 'agent-2' AND entity_id IS NOT NULL))",
    "cross_agent_links": MEM + " SELECT m.agent AS owner, e.agent, count(*) AS n FROM memory_entities e JOIN m ON m.id = e.memory_id WHERE e.entity_id IS NOT NULL AND e.agent <> m.agent GROUP BY 1, 2",
    "graph_search": MEM + f", {LINK_CTE}, o AS (SELECT l.memory_id, l.entity_id, m.agent, m.updated_at FROM l JOIN m ON m.id = l.memory_id WHERE m.status = 'active'), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY entity_id) AS r FROM o) WHERE r <= 15)," + f"""
      e AS (SELECT DISTINCT x.agent, x.entity_id AS a, y.entity_id AS b FROM k x JOIN k y ON x.memory_id = y.memory_id AND x.entity_id <> y.entity_id), n AS (SELECT id, agent, {_EKEY} AS key FROM (SELECT id, any_value(agent) AS agent, any_value(name) AS name FROM entities WHERE id IS NOT NULL GROUP BY id) WHERE name IS NOT NULL AND agent IS NOT NULL),
      s AS (SELECT DISTINCT q.id AS query_id, q.agent, n.id AS node FROM n q JOIN n ON q.agent = n.agent AND q.key = n.key WHERE EXISTS (SELECT 1 FROM o WHERE o.agent = q.agent AND o.entity_id = n.id)),
      h AS (SELECT s.query_id, s.agent, e.b AS node FROM s JOIN e ON e.agent = s.agent AND e.a = s.node UNION SELECT * FROM s), h2 AS (SELECT h.query_id, h.agent, e.b AS node FROM h JOIN e ON e.agent = h.agent AND e.a = h.node UNION SELECT * FROM h),
      f AS (SELECT DISTINCT h2.query_id, o.memory_id, o.updated_at FROM h2 JOIN o ON o.agent = h2.agent AND o.entity_id = h2.node)
      SELECT query_id, memory_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC NULLS LAST, memory_id) AS rank FROM f) WHERE rank <= 20""",
    "recent_since": MEM + " SELECT id, agent, created_at FROM m WHERE status = 'active' AND created_at >= TIMESTAMPTZ '2025-05-01 00:00:00+00'",
    "recent_vectors": MEM + " SELECT id FROM m WHERE status = 'active' AND id IN (SELECT memory_id FROM memory_vectors WHERE embedding IS NOT NULL) ORDER BY created_at DESC NULLS LAST, id LIMIT 500",
    "enriched": MEM + " SELECT v.id, coalesce(agent, 'unknown') AS agent, coalesce(source, 'unknown') AS source, coalesce(type, 'fact') AS type, coalesce(source_id, '') AS source_id, metadata->>'$.seen_in' AS seen_in FROM (SELECT DISTINCT memory_id AS id FROM memory_vectors WHERE memory_id IS NOT NULL) v LEFT JOIN m ON m.id = v.id",
    "shareable": MEM + " SELECT id, agent FROM m WHERE lower(trim(visibility, ' ')) IN ('shared', 'fleet')",
    "mutation_guard": MEM + " SELECT id, CASE WHEN agent <> 'agent-1' THEN 'not owner' WHEN status <> 'active' THEN 'not active' WHEN lower(content_hash) IS DISTINCT FROM sha256(content) THEN 'stale' ELSE 'ok' END AS verdict FROM m",
    "fingerprints": MEM + f" SELECT id, f AS fingerprint, sha256({KEY('x')}) AS activation FROM (SELECT id, f, agent || '|' || coalesce(source_id, '') || '|' || f AS x FROM (SELECT *, sha256({KEY(chr(99) + 'oalesce(content, chr(39) || chr(39))')}) AS f FROM m))".replace("chr(39) || chr(39)", "''"),
    "fact_normalized": MEM + " SELECT id, round(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.5 ELSE least(1.0, greatest(0.0, confidence)) END, 6) AS confidence, CASE WHEN type IN ('fact', 'observation', 'document', 'conversation') THEN type ELSE 'fact' END AS type, CASE WHEN visibility IN ('private', 'shared', 'fleet') THEN visibility ELSE 'private' END AS visibility FROM m",
    "json_slices": MEM + " SELECT id, CASE WHEN json_valid(metadata) AND starts_with(ltrim(metadata, ' '), '{') THEN metadata END AS object FROM m WHERE content IS NOT NULL",
    "frontmatter_fields": f"WITH b AS (SELECT doc_id, {_BLOCK} AS block FROM documents) SELECT doc_id, {_FIELD % 'type'} AS type, {_FIELD % 'status'} AS status, TRY_CAST({_FIELD % 'created'} AS DATE) AS created, {_FIELD % 'locked'} = 'true' AS locked, array_to_string(list_filter(list_transform(string_split(trim(coalesce({_FIELD % 'tags'}, ''), '[] '), ','), lambda x: trim(x, ' \"''')), lambda x: x <> ''), '|') AS tags FROM b WHERE block IS NOT NULL",
    "query_expansions": r"WITH t AS (SELECT id, any_value(user_text) AS user_text FROM turns WHERE id IS NOT NULL GROUP BY id), x AS (SELECT id, user_text, list_filter(list_concat(list_filter(list_transform(regexp_extract_all(user_text, '(?:^|[^A-Za-z0-9_])([A-Z][a-zA-Z0-9]+(?:[ \t\r\n]+[A-Z][a-zA-Z0-9]+)*)', 1), lambda n: trim(n, ' ')), lambda n: lower(n) NOT IN " + _STOPS
      + r"), [array_to_string(list_filter(regexp_split_to_array(user_text, '[ \t\r\n,.;:!?]+'), lambda w: w <> '' AND lower(w) NOT IN " + _STOPS + "), ' ')]), lambda z: z <> '') AS l, list_transform(regexp_extract_all(" + _NOQ + r", '[\p{L}\p{N}_''’-]+'), lambda w: regexp_replace(w, '[''’]s$', '')) AS w FROM t WHERE user_text IS NOT NULL)"
      + " SELECT id, array_to_string(list_slice(list_filter(l, lambda z, i: list_position(l, z) = i), 1, 3), '|') AS terms, coalesce(nullif(trim(array_to_string(list_filter(w, lambda v: v <> '' AND lower(v) NOT IN " + _ASKS + "), ' '), ' ?.,'), ''), trim(user_text, ' ')) AS words FROM x",
    "evidence_lines": MEM + " SELECT id, CASE WHEN status IN ('unresolved', 'contradicted') THEN 'uncertainty' WHEN source IN ('vault', 'document', 'import') OR type = 'document' THEN 'provenance' ELSE 'current' END AS class, md5('- [' || visibility || '] ' || CASE WHEN status IN ('unresolved', 'contradicted') THEN 'Unresolved conflict' ELSE 'Memory' END || ' [m:' || id[1:12] || ']: ' || regexp_replace(replace(content, chr(0), ''), '(?i)</?memory[-_]context[^>]*>', '', 'g')) AS line_md5 FROM m WHERE content IS NOT NULL",
    "owner_counts": MEM + " SELECT agent, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS n_active, max(coalesce(updated_at, created_at)) AS changed_at FROM m GROUP BY 1",
    "stale_inactive": MEM + " SELECT id, status FROM m WHERE status <> 'active' AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.path = m.source_id)",
    "known_ids": "SELECT id, count(*) AS n_tables FROM (SELECT DISTINCT id, 'm' AS t FROM memories UNION ALL SELECT DISTINCT memory_id, 'v' FROM memory_vectors UNION ALL SELECT DISTINCT memory_id, 'e' FROM memory_entities) WHERE id IS NOT NULL GROUP BY 1",
    "shadow_rank": MEM + " SELECT agent, id, row_number() OVER (PARTITION BY agent ORDER BY coalesce(nullif(trust, 0), 0.5) DESC, id) AS rank FROM m",
    "session_page": f"SELECT id, n > 5 AS has_more FROM (SELECT id, row_number() OVER (ORDER BY started_at NULLS LAST, id) AS r, count(*) OVER () AS n FROM (@CAND)) WHERE r <= 5",
    "session_rollup": _SEEN + " SELECT session_id, min(timestamp) AS first_at, min(id) AS first_id, count(*) AS n FROM v GROUP BY 1",
    "message_pages": _SEEN + " SELECT session_id, id, (n - 1) // 80 + 1 AS page, (n - 1) % 80 + 1 AS place FROM v",
    "raw_scan": _SEEN.replace(" AND session_id IS NOT NULL)", ")") + ", p AS (SELECT * FROM v WHERE id > 1000 ORDER BY id LIMIT 1500) SELECT id, (SELECT max(id) FROM p) AS watermark FROM p WHERE contains(lower(content), 'lantern')",
    "merged_hits": _SEEN.replace(" AND session_id IS NOT NULL)", ")") + ", h AS (SELECT session_id, id, list_has_any(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'), ['lantern', 'kettle']) AS by_word, contains(lower(coalesce(content, '')), 'lant') AS by_piece FROM v) SELECT * FROM h WHERE by_word OR by_piece",
    "topic_evidence": _SEEN.replace(" AND session_id IS NOT NULL)", ")") + """, h AS (SELECT * EXCLUDE (n, back) FROM v WHERE session_id IS NOT NULL AND timestamp IS NOT NULL AND list_has_any(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'), ['lantern', 'kettle'])),
      w AS (SELECT session_id, max(timestamp) AS newest FROM h GROUP BY 1 ORDER BY newest DESC, session_id LIMIT 10), t AS (SELECT h.*, newest, row_number() OVER (PARTITION BY h.session_id ORDER BY timestamp, id) AS turn FROM h JOIN w USING (session_id)),
      l AS (SELECT * FROM t ORDER BY turn, newest DESC, session_id LIMIT 80), x AS (SELECT *, CASE WHEN instr(lower(content), 'lantern') > 0 AND instr(lower(content), 'kettle') > 0 THEN least(instr(lower(content), 'lantern'), instr(lower(content), 'kettle')) ELSE greatest(instr(lower(content), 'lantern'), instr(lower(content), 'kettle')) END AS f FROM l)
      SELECT session_id, id, turn, """ + "@KIND" + """ AS kind, md5(substring(content, greatest(1, f - 1000)::BIGINT, 2001)) AS excerpt_md5 FROM x""",
    "delivery_suppression": f"WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS vr FROM turns WHERE id IS NOT NULL) WHERE vr = 1 AND session_id IS NOT NULL), k AS (SELECT session_id, id, created_at, sha256({KEY('user_x')}) AS h FROM (SELECT *, coalesce(user_text, '') AS user_x FROM t)) SELECT session_id, id, row_number() OVER w AS n, coalesce(h = lag(h) OVER w, false) AS suppressed FROM k WINDOW w AS (PARTITION BY session_id ORDER BY created_at NULLS FIRST, id)",
    "import_entries": MEM + r""", d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^---[ \t]*\r?\n[\s\S]*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)', ''), '(?m)^[ \t]*```[\s\S]*?(?:^[ \t]*```[ \t]*\r?$|\z)', '', 'g') AS p FROM documents WHERE text IS NOT NULL),
      l AS (SELECT doc_id, i - 1 AS line, ls[i] AS raw FROM (SELECT doc_id, regexp_split_to_array(p, '\r?\n') AS ls FROM d), unnest(range(1, len(ls) + 1)) AS r(i)),
      e AS (SELECT doc_id, line, trim(regexp_replace(raw, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+', ''), ' ') AS entry FROM l WHERE NOT regexp_matches(raw, '^[ \t]*(#{1,6} |[-*_]{3,}[ \t]*$|\|)') AND trim(raw, ' ') <> '')
      SELECT hash, f[1] AS doc_id, f[2]::INT AS line, n, CASE WHEN regexp_matches(lower(f[3]), 'timezone|name|email|prefers|hates|wants|language|region|location') THEN 'fleet' WHEN regexp_matches(lower(f[3]), 'project|repo|hardware|server|network|decision|agreed|plan|build') THEN 'shared' ELSE 'private' END AS visibility
      FROM (SELECT sha256(""" + KEY("entry") + r""") AS hash, min((doc_id, line, entry)) AS f, count(*) AS n FROM e GROUP BY 1) WHERE hash NOT IN (SELECT sha256(""" + KEY("content") + """) FROM m WHERE content IS NOT NULL)""",
    "memory_file_parse": r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^---[ \t]*\r?\n[\s\S]*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)', ''), '(?m)^[ \t]*```[\s\S]*?(?:^[ \t]*```[ \t]*\r?$|\z)', '', 'g') AS p FROM documents WHERE text IS NOT NULL),
      l AS (SELECT doc_id, i - 1 AS line, ls[i] AS raw FROM (SELECT doc_id, regexp_split_to_array(p, '\r?\n') AS ls FROM d), unnest(range(1, len(ls) + 1)) AS r(i))
      SELECT doc_id, count(*) AS n, max(line)::INT AS last_line FROM l WHERE NOT regexp_matches(raw, '^[ \t]*(#{1,6} |[-*_]{3,}[ \t]*$|\|)') AND trim(raw, ' ') <> '' GROUP BY 1""",
    "receipt_states": "WITH c AS (SELECT c.event_id AS c, arg_max(o.event_id, (o.ts, o.event_id)) AS o FROM events c JOIN events o ON c.user_id = o.user_id AND o.event_type = 'view' AND c.event_type = 'purchase' AND o.ts <= c.ts AND c.ts - o.ts <= INTERVAL 300 SECOND GROUP BY 1), d AS (SELECT o, min(c) AS c FROM c GROUP BY 1) SELECT event_id AS id, CASE WHEN c IS NULL THEN 'expired' ELSE 'closed' END AS state, c AS closing_id FROM events LEFT JOIN d ON o = event_id WHERE event_type = 'view'",
    "job_claims": "SELECT agent, event_id, priority, n FROM (SELECT 'agent-' || (user_id % 8) AS agent, event_id, floor(value / 10)::BIGINT AS priority, row_number() OVER (PARTITION BY user_id % 8 ORDER BY floor(value / 10) DESC, event_id) AS n FROM events WHERE event_type = 'click') WHERE n <= 3",
    "percentile_truncated": "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL) SELECT event_type, s.share::DOUBLE AS share, value FROM k, (VALUES (0.5), (0.95)) s(share) WHERE n = least(c, greatest(1, floor(c * s.share::DOUBLE)))",
    "evidence_generation": "SELECT agent, count(DISTINCT (id, coalesce(epoch_us(updated_at), 0), coalesce(status, ''))) AS generation FROM memories WHERE id IS NOT NULL AND agent IS NOT NULL GROUP BY 1",
    "scale_recipe": """WITH v AS (SELECT i AS id, list_transform(range(0, 768), lambda j: ((j * 73 + i * 37) % 997 + 1) / 997.0::DOUBLE) AS vec FROM range(0, 5000) r(i)), q AS (SELECT -1 - p AS query_id, list_transform(range(0, 768), lambda j: ((j * 73 + p) % 199 + 1) / 199.0::DOUBLE) AS vec FROM range(0, 7) r(p)),
      s AS (SELECT query_id, id, list_cosine_similarity(q.vec, v.vec) AS score FROM q, v) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 10""",
}


def _late() -> None:
    """SQL that is built on other queries' SQL."""
    from evidenza.plans import archive, evidence

    base = archive.ORACLE["session_candidates_keyset"].replace(" AND started_at >= TIMESTAMPTZ '2025-01-25 00:00:00+00'", "")
    ORACLE["session_page"] = ORACLE["session_page"].replace("@CAND", base)
    edges = ORACLE["sentence_edges"]
    ORACLE["relation_typing"] = edges[: edges.rindex("SELECT a AS name_a")] + "SELECT " + _case("g", _REL, "related_to") + " AS relation, count(*) AS n_pairs, count(DISTINCT id) AS n_memories FROM z GROUP BY 1"
    kinds = evidence.ORACLE["statement_kind"]
    ORACLE["topic_evidence"] = ORACLE["topic_evidence"].replace("@KIND", kinds[kinds.index("CASE WHEN regexp_matches(coalesce(content") : kinds.index(" AS kind")])
    pairs = evidence.ORACLE["contradiction_pairs"]
    ORACLE["contradiction_flags"] = f"WITH p AS ({pairs}), n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY 1), mm AS ({MEM} SELECT id, trust, status FROM m) SELECT n.id, n.n, round(greatest(coalesce(nullif(trust, 0), 0.5) - 0.1 * n.n, 0.3), 6) AS trust FROM n JOIN mm ON mm.id = n.id"


_late()
