"""Queries that search memories as the engine's users do: by words, by vectors, and both through the whole recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenza.functions import text
from evidenza.operators import recall, search
from evidenza.plans.sql import KEY, MEM
from evidenza.runtime import packed_cut, table
from evidenza.sources import tables


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).where("status = 'active'")


def _asked(m: DataFrame) -> DataFrame:
    """The memories that ask for the like of themselves: those whose id's digest is divisible by 20."""
    return m.where(F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 20 == 0)


def _words() -> Column:
    """The content's distinct words of six signs or more, in order."""
    return F.filter(F.array_distinct(text.tokens(F.col("content"))), lambda w: F.length(w) >= 6)


def _questions(m: DataFrame, terms: Column | None = None) -> DataFrame:
    return m.select(F.col("id").alias("query_id"), F.col("agent").alias("owner"), (F.slice(_words(), 1, 3) if terms is None else terms).alias("terms")).where(F.size("terms") > 0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memory_vectors")


def _keyword(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    m = _active(spark, sf_dir)
    return recall.keyword_lane(m, _questions(_asked(m)), k)


def _semantic(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    m, v = _active(spark, sf_dir), _vectors(spark, sf_dir)
    usable = v.where(F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions"))).groupBy("memory_id", "model").agg(F.min("embedding").alias("vec"))
    q = _asked(m).select(F.col("id").alias("memory_id"), "agent").join(usable, "memory_id").select(F.col("memory_id").alias("query_id"), "agent", "model", "vec")
    return recall.vector_lane(m, v, q, k)


def memory_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


def memory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight likeliest stored facts of the same owner for every active fact, which is asked with all its long words."""
    m = packed_cut(_active(spark, sf_dir).where("type = 'fact'").select("id", "agent", "content"))  # they ask and are found, from one reading
    return search.bm25(m, "id", "content", _questions(m, _words()), 8, owner=F.col("agent")).select("query_id", "id", "rank")


def memory_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


def lanes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.first_wins([_keyword(spark, sf_dir, 10), _semantic(spark, sf_dir, 10)])


def recall_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty candidates of each lane, fused and weighted by source, resolved, ranked by quality, the best ten."""
    fused = search.fused([_keyword(spark, sf_dir, 30), _semantic(spark, sf_dir, 30)])
    m = _active(spark, sf_dir)
    best = search.weighted(fused, m.select("id", "source"), 30)
    return recall.recalled(best, m).withColumn("quality", F.round("quality", 6))


def recall_unsaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active memories that no turn says already."""
    turns = tables.turns(spark, sf_dir)
    said = turns.select(F.col("user_text").alias("content")).unionByName(turns.select(F.col("assistant_text").alias("content"))).where("content IS NOT NULL")
    return recall.unsaid(_active(spark, sf_dir).where("content IS NOT NULL"), said).select("id")


QUERIES = {f.__name__: f for f in (recall_memories, memory_keyword_search, memory_candidates, memory_semantic_search, lanes_union, recall_unsaid)}


def _bm25(where: str, body: str, asked: str, k: int, seen: str = "true", words: str = "list_slice(w, 1, 3)") -> str:
    return f"""d AS (SELECT id, agent, {seen} AS ok, regexp_extract_all(lower(coalesce({body}, '')), '[a-z0-9]+') AS t FROM m WHERE {where}),
    qw AS (SELECT id, agent, list_filter(list_filter(t, lambda x, i: list_position(t, x) = i), lambda x: len(x) >= 6) AS w FROM (SELECT id, agent, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') AS t FROM m WHERE {where} AND {asked})),
    q AS (SELECT id AS query_id, agent, unnest({words}) AS term FROM qw), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    tf AS (SELECT id, agent, ok, len(t) AS dl, x.term, count(*) AS tf FROM d, unnest(t) AS x(term) WHERE x.term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), nq AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1),
    sc AS (SELECT q.query_id, tf.id, sum(greatest(ln((st.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / st.avgdl))) AS score, count(*) AS found FROM q JOIN tf ON q.term = tf.term AND q.agent = tf.agent AND tf.ok JOIN df ON df.term = q.term CROSS JOIN st GROUP BY 1, 2),
    kw AS (SELECT * FROM (SELECT sc.query_id, sc.id, score, row_number() OVER (PARTITION BY sc.query_id ORDER BY round(score, 9) DESC, sc.id) AS rank FROM sc JOIN nq ON nq.query_id = sc.query_id AND nq.k = sc.found) WHERE rank <= {k})"""


_ASK = "('0x' || md5(id)[1:4])::INT % 20 = 0"
_LANE = lambda k: _bm25("status = 'active'", "content || ' ' || coalesce(array_to_string(tags, ' '), '')", _ASK, k, "visibility IN ('private', 'shared')")
_SEM = lambda k: f"""u AS (SELECT memory_id, model, min(embedding) AS e FROM memory_vectors WHERE embedding IS NOT NULL AND len(embedding) = dimensions AND memory_id IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT u.*, m.agent, m.visibility FROM u JOIN m ON m.id = u.memory_id WHERE m.status = 'active' AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    ss AS (SELECT a.memory_id AS query_id, b.memory_id AS id, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS score FROM g a JOIN g b ON a.model = b.model AND a.agent = b.agent AND len(a.e) = len(b.e) AND a.memory_id <> b.memory_id AND b.visibility IN ('private', 'shared') WHERE {_ASK.replace('(id)', '(a.memory_id)')}),
    sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ss WHERE score >= 0.3) WHERE rank <= {k})"""  # noqa: E731
_W = "CASE source WHEN 'conversation' THEN 1.3 WHEN 'manual' THEN 1.3 WHEN 'import' THEN 1.3 WHEN 'hindsight' THEN 1.3 WHEN 'dream' THEN 1.1 WHEN 'cron' THEN 1.1 WHEN 'sensor' THEN 1.1 WHEN 'email' THEN 1.1 WHEN 'vault' THEN 0.7 ELSE 1.0 END::DOUBLE"
_AUTH = "CASE source WHEN 'manual' THEN 1.0 WHEN 'conversation' THEN 0.9 WHEN 'import' THEN 0.8 WHEN 'vault' THEN 0.85 WHEN 'hindsight' THEN 0.7 WHEN 'dream' THEN 0.55 WHEN 'cron' THEN 0.6 WHEN 'sensor' THEN 0.65 WHEN 'email' THEN 0.7 ELSE 0.65 END::DOUBLE"
_PLAIN = lambda c: KEY(f"trim({c}, ' .,!?;:')")
ORACLE = {
    "memory_keyword_search": MEM + ", " + _LANE(10) + " SELECT query_id, id, round(score, 6) AS score, rank FROM kw",
    "memory_candidates": MEM + ", " + _bm25("status = 'active' AND type = 'fact'", "content", "true", 8, words="w") + " SELECT query_id, id, rank FROM kw",
    "memory_semantic_search": MEM + ", " + _SEM(10) + " SELECT query_id, id, round(score, 6) AS score, rank FROM sem",
    "lanes_union": MEM + ", " + _LANE(10) + ", " + _SEM(10) + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY f) AS place FROM (SELECT query_id, id, min(lane * 1000 + rank) AS f FROM (SELECT query_id, id, rank, 0 AS lane FROM kw UNION ALL SELECT query_id, id, rank, 1 FROM sem) GROUP BY 1, 2)",
    "recall_memories": MEM + ", " + _LANE(30) + ", " + _SEM(30) + f""", f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM kw UNION ALL SELECT query_id, id, rank FROM sem) GROUP BY 1, 2),
      w AS (SELECT f.query_id, f.id, f.score * {_W} AS score FROM f JOIN m ON m.id = f.id WHERE m.status = 'active'), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM w) WHERE r <= 30),
      c AS (SELECT b.query_id, b.id, round(b.score, 9) AS score, m.trust, m.confidence, m.verified, m.seen_count, m.source, row_number() OVER (PARTITION BY b.query_id, {KEY('content')} ORDER BY m.confidence DESC NULLS LAST, round(b.score, 9) DESC, b.id) AS r FROM b JOIN m ON m.id = b.id WHERE m.content IS NOT NULL),
      n AS (SELECT *, CASE WHEN max(score) OVER v > min(score) OVER v THEN 0.05 + 0.95 * (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) WHEN score > 0 THEN 1.0 ELSE 0.01 END::DOUBLE AS rel FROM c WHERE r = 1 WINDOW v AS (PARTITION BY query_id)),
      y AS (SELECT query_id, id, rel * (0.8 + 0.4 * least(1, greatest(0, 0.35 * coalesce(nullif(trust, 0), 0.5) + 0.3 * coalesce(nullif(confidence, 0), 0.5) + 0.15 * CASE WHEN verified THEN 1 ELSE 0 END + 0.1 * least(1.0, (greatest(coalesce(seen_count, 1), 1) - 1) / 4) + 0.1 * {_AUTH}))) AS q FROM n)
      SELECT query_id, id, round(q, 6) AS quality, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(q, 9) DESC, id) AS rank FROM y) WHERE rank <= 10""",
    "recall_unsaid": MEM + f", t AS (SELECT {_PLAIN('user_text')} AS k FROM turns UNION SELECT {_PLAIN('assistant_text')} FROM turns) SELECT id FROM m WHERE status = 'active' AND content IS NOT NULL AND {_PLAIN('content')} NOT IN (SELECT k FROM t WHERE k IS NOT NULL)",
}
