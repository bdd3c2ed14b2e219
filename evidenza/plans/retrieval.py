"""Search queries: keyword, vector and hybrid lanes, and the filters around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenza.functions import scoring, text
from evidenza.operators import scope, search
from evidenza.plans.sql import MEM, TOKENS
from evidenza.runtime import table
from evidenza.sources import tables


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 asks for the first three longer words it has."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    long = F.filter(F.array_distinct(text.tokens(F.col("text"))), lambda w: F.length(w) >= 6)
    return docs.select(F.col("doc_id").alias("query_id"), F.slice(long, 1, 3).alias("terms")).where(F.size("terms") > 0)


_Q = f"""q AS (SELECT doc_id AS query_id, unnest(list_slice(w, 1, 3)) AS term FROM (
  SELECT doc_id, list_filter(list_distinct_ordered, lambda x: len(x) >= 6) AS w FROM (
    SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, {TOKENS('text')} AS t FROM documents WHERE doc_id % 20 = 0))))"""
_BM25 = f"""WITH {_Q},
d AS (SELECT doc_id AS id, source, lang, {TOKENS('text')} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT id, len(t) AS dl, x.term, count(*) AS tf FROM d, unnest(t) AS x(term) WHERE x.term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nq AS (SELECT query_id, count(*) AS k FROM q GROUP BY query_id),
sc AS (SELECT q.query_id, tf.id, sum(greatest(ln((s.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / s.avgdl))) AS score, count(*) AS found
       FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN s GROUP BY 1, 2)"""
_KEYWORD = _BM25 + """, kw AS (SELECT * FROM (SELECT sc.query_id, sc.id, score, row_number() OVER (PARTITION BY sc.query_id ORDER BY round(score, 9) DESC, sc.id) AS rank
  FROM sc JOIN nq ON nq.query_id = sc.query_id AND nq.k = sc.found) WHERE rank <= 10)"""


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _questions(spark, sf_dir)).withColumn("score", F.round("score", 6))


def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.bm25(docs, "doc_id", "text", _questions(spark, sf_dir), 5, F.coalesce(F.startswith("source", F.lit("vault:")), F.lit(False))).withColumn("score", F.round("score", 6))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search.semantic(v, "vec_id", "embedding", v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))).withColumn("score", F.round("score", 6))


_SEM = """sem AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE score >= 0.3) WHERE rank <= 10)"""


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bm25_topk(spark, sf_dir), semantic_topk(spark, sf_dir)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fused(list(_lanes(spark, sf_dir)), 10).withColumn("score", F.round("score", 9))


_RRF = _KEYWORD + ", " + _SEM + """, f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM kw UNION ALL SELECT query_id, id, rank FROM sem) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f)"""


def hybrid_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split("source", ":")[0].alias("source"))
    return search.weighted(search.fused(list(_lanes(spark, sf_dir))), sources, 10).withColumn("score", F.round("score", 9))


_W = "CASE split_part(d.source, ':', 1) WHEN 'conversation' THEN 1.3 WHEN 'manual' THEN 1.3 WHEN 'import' THEN 1.3 WHEN 'hindsight' THEN 1.3 WHEN 'dream' THEN 1.1 WHEN 'cron' THEN 1.1 WHEN 'sensor' THEN 1.1 WHEN 'email' THEN 1.1 WHEN 'vault' THEN 0.7 ELSE 1.0 END::DOUBLE"


def hybrid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.strategy("auto", *_lanes(spark, sf_dir), 5).select("query_id", "id", "rank")


def visibility_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir)
    return m.where(scope.visible(F.col("visibility"), F.lit("shared"))).select("id", "agent", "visibility")


def path_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents below three folders, and rows that are no documents."""
    d = table(spark, sf_dir, "documents").withColumn("kind", F.when(F.startswith("source", F.lit("vault:")), "document").otherwise("note"))
    return d.where(scope.document_allowed(F.lit(None).cast("string"), F.col("kind"), F.col("path"), ["noisy", "calm/", "faint\\screen-62782.md"])).select("doc_id", "path")


def locked_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    locked = F.coalesce(text.frontmatter(F.col("text")).rlike(r"(?m)^locked:[ \t]*true"), F.lit(False))
    shown = scope.masked(F.col("text"), locked, F.col("agent"), F.lit("agent-1"))
    return d.select("doc_id", locked.alias("locked"), F.md5(shown).alias("shown_md5"))


def authorize_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir)
    cand = table(spark, sf_dir, "memory_vectors").select(F.col("memory_id").alias("id")).distinct()
    return scope.authorized(cand, m, agent="agent-2", ceiling="shared").select("id", "agent", "visibility", "status")


def historical_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.turns(spark, sf_dir)
    past = text.historical_intent(F.col("user_text"))
    return t.select("id", past.alias("historical"), F.when(past, "active,superseded").otherwise("active").alias("statuses"))


def active_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest active memories of each agent."""
    from pyspark.sql import Window

    m = tables.memories(spark, sf_dir).where("status = 'active' AND created_at IS NOT NULL")
    w = Window.partitionBy("agent").orderBy(F.desc("created_at"), "id")
    return m.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("agent", "id", "rank")


def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories whose vector is missing, of the wrong length, or unusable."""
    v = table(spark, sf_dir, "memory_vectors")
    good = F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions")) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return tables.memories(spark, sf_dir).join(v.where(good).select(F.col("memory_id").alias("id")), "id", "left_anti").select("id", "status")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic embeddings of the entities' names by hashed words, and the norm of each."""
    e = table(spark, sf_dir, "entities").select("id", F.explode(text.tokens(F.col("name"))).alias("w"))
    e = e.select("id", (F.conv(F.substring(F.sha2("w", 256), 1, 4), 16, 10).cast("int") % 16).alias("at"))
    return e.groupBy("id", "at").agg(F.count("*").alias("n")).groupBy("id").agg(F.sum("n").alias("n_words"), F.round(F.sqrt(F.sum(F.col("n") * F.col("n"))), 6).alias("norm"), F.max("at").alias("last_at"))


_GOOD = "embedding IS NOT NULL AND len(embedding) = dimensions AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

QUERIES = {f.__name__: f for f in (hybrid_search_top10, bm25_topk, bm25_scoped, semantic_topk, rrf_fusion, hybrid_fallback, visibility_ceiling, path_scope_filter, locked_mask, authorize_candidates, historical_status, active_by_agent, missing_embeddings, hash_embedding)}
ORACLE = {
    "bm25_topk": _KEYWORD + " SELECT query_id, id, round(score, 6) AS score, rank FROM kw",
    "bm25_scoped": _BM25 + """ SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT sc.query_id, sc.id, score, row_number() OVER (PARTITION BY sc.query_id ORDER BY round(score, 9) DESC, sc.id) AS rank
      FROM sc JOIN nq ON nq.query_id = sc.query_id AND nq.k = sc.found JOIN d ON d.id = sc.id WHERE d.source LIKE 'vault:%') WHERE rank <= 5""",
    "semantic_topk": "WITH " + _SEM + " SELECT query_id, id, round(score, 6) AS score, rank FROM sem",
    "rrf_fusion": _RRF + " SELECT query_id, id, round(score, 9) AS score, rank FROM r WHERE rank <= 10",
    "hybrid_search_top10": _RRF + f""" SELECT query_id, id, round(score, 9) AS score, rank FROM (SELECT f.query_id, f.id, f.score * {_W} AS score, row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.score * {_W}, 9) DESC, f.id) AS rank
      FROM f JOIN documents d ON d.doc_id = f.id) WHERE rank <= 10""",
    "hybrid_fallback": _RRF + """ SELECT query_id, id, rank FROM r WHERE rank <= 5 AND query_id IN (SELECT query_id FROM sem) UNION ALL SELECT query_id, id, rank FROM kw WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM sem)""",
    "visibility_ceiling": MEM + " SELECT id, agent, visibility FROM m WHERE visibility IN ('private', 'shared')",
    "path_scope_filter": "SELECT doc_id, path FROM documents WHERE NOT coalesce(starts_with(source, 'vault:'), false) OR " + " OR ".join(f"trim(replace(path, '\\', '/'), '/') = '{p}' OR starts_with(trim(replace(path, '\\', '/'), '/'), '{p}/')" for p in ("noisy", "calm", "faint/screen-62782.md")),
    "locked_mask": r"""SELECT doc_id, locked, md5(CASE WHEN locked AND agent IS DISTINCT FROM 'agent-1' THEN '[locked]' ELSE text END) AS shown_md5 FROM (
      SELECT *, coalesce(regexp_matches(nullif(regexp_extract(text, '^---[ \t]*\r?\n([\s\S]*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)', 1), ''), '(?m)^locked:[ \t]*true'), false) AS locked FROM documents WHERE text IS NOT NULL)""",
    "authorize_candidates": MEM + " SELECT id, agent, visibility, status FROM m WHERE id IN (SELECT memory_id FROM memory_vectors) AND status = 'active' AND (agent = 'agent-2' OR visibility = 'shared')",
    "historical_status": r"""SELECT id, h AS historical, CASE WHEN h THEN 'active,superseded' ELSE 'active' END AS statuses FROM (SELECT id, coalesce(regexp_matches(any_value(user_text), '(?i)(?:^|[^\p{L}\p{N}_])(?:when|then|before|previously|used to|historical|history|at that time|20[0-9]{2}-[01][0-9]-[0-3][0-9])(?:[^\p{L}\p{N}_]|$)'), false) AS h FROM turns WHERE id IS NOT NULL GROUP BY id)""",
    "active_by_agent": MEM + " SELECT agent, id, rank FROM (SELECT agent, id, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id) AS rank FROM m WHERE status = 'active' AND created_at IS NOT NULL) WHERE rank <= 10",
    "missing_embeddings": MEM + f" SELECT id, status FROM m WHERE id NOT IN (SELECT memory_id FROM memory_vectors WHERE memory_id IS NOT NULL AND {_GOOD})",
    "hash_embedding": f"""SELECT id, sum(n)::BIGINT AS n_words, round(sqrt(sum(n * n)), 6) AS norm, max(pos) AS last_at FROM (SELECT id, (('0x' || sha256(w)[1:4])::INT % 16) AS pos, count(*) AS n FROM (SELECT id, unnest({TOKENS('name')}) AS w FROM entities) GROUP BY 1, 2) GROUP BY id""",
}
