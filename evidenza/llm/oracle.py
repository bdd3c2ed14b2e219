"""SQL equivalents of the problems' queries, where SQL can express them over whole tables."""

# Pairs of vectors: every pair compared.
P1 = """
WITH u AS (
  SELECT model, memory_id AS id, min(embedding) AS v FROM memory_vectors
  WHERE embedding IS NOT NULL AND len(embedding) = dimensions AND memory_id IS NOT NULL AND model IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY 1, 2
), s AS (
  SELECT x.id AS a, y.id AS b, x.model, list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]) AS sim
  FROM u x JOIN u y ON x.model = y.model AND x.id <> y.id AND len(x.v) = len(y.v)
), r AS (
  SELECT a, b, sim, row_number() OVER (PARTITION BY model, a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= 0.8
)
SELECT DISTINCT least(a, b) AS memory_a, greatest(a, b) AS memory_b FROM r WHERE r <= 8
"""

# Records by shared pairs of adjacent words, counted for every pair of records that share one.
P2 = r"""
WITH t AS (
  SELECT id, regexp_extract_all(lower(min(content)), '[\p{L}\p{N}]+') AS w FROM memories WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id
), p AS (
  SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS p FROM t, unnest(range(1, len(w))) AS r(i)
), n AS (SELECT id, count(*) AS n FROM p GROUP BY id),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM p x JOIN p y ON x.p = y.p AND x.id < y.id GROUP BY 1, 2)
SELECT b.a AS memory_a, b.b AS memory_b FROM b JOIN n na ON na.id = b.a JOIN n nb ON nb.id = b.b
WHERE 2 * b.k >= na.n + nb.n - b.k
"""

P3 = """
WITH RECURSIVE l AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS r FROM memories WHERE id IS NOT NULL) WHERE r = 1
), e AS (
  SELECT l.id AS a, l.superseded_by AS b FROM l JOIN l m ON m.id = l.superseded_by WHERE l.id <> l.superseded_by
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, x.b FROM reach JOIN both_ways x ON x.a = reach.b),
g AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a),
k AS (
  SELECT g.group_id, l.id, CASE WHEN l.trust_score >= 0 AND l.trust_score <= 1 THEN l.trust_score END AS trust, l.updated_at AS seen,
         l.source IS NOT NULL AND trim(l.source, e' \\t\\r\\n') <> '' AS sourced
  FROM g JOIN l ON l.id = g.id
), t AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC NULLS LAST, seen DESC NULLS LAST, id) AS rt,
    row_number() OVER (PARTITION BY group_id ORDER BY seen DESC NULLS LAST, id) AS rn,
    row_number() OVER (PARTITION BY group_id ORDER BY sourced DESC, trust DESC NULLS LAST, seen DESC NULLS LAST, id) AS rs FROM k
)
SELECT group_id, max(CASE WHEN rt = 1 THEN id END) AS trusted_id, max(CASE WHEN rn = 1 THEN id END) AS newest_id,
       max(CASE WHEN rs = 1 AND sourced THEN id END) AS source_row_id
FROM t GROUP BY group_id
"""

_PAIRS = """
WITH r AS (SELECT DISTINCT memory_id AS m, entity_id AS e FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL),
n AS (SELECT count(DISTINCT m) AS n FROM r),
s AS (SELECT e, count(*) AS k FROM r GROUP BY e),
p AS (SELECT x.e AS a, y.e AS b, count(*) AS k FROM r x JOIN r y ON x.m = y.m AND x.e < y.e GROUP BY 1, 2),
q AS (SELECT p.a, p.b, p.k AS n_ab, sa.k AS n_a, sb.k AS n_b, n.n AS n, p.k * n.n / (sa.k * sb.k) AS lift
      FROM p JOIN s sa ON sa.e = p.a JOIN s sb ON sb.e = p.b CROSS JOIN n)
"""
P4 = _PAIRS + "SELECT a AS entity_a, b AS entity_b FROM q WHERE n_ab >= 5 AND lift >= 3.17"

P5 = r"""
WITH m AS (
  SELECT min(id) AS id, session_id AS s, role, ts, content FROM (
    SELECT id, any_value(session_id) AS session_id, any_value(timestamp) AS ts, any_value(content) AS content,
      CASE WHEN lower(trim(any_value(role))) IN ('user', 'human') THEN 'user' WHEN lower(trim(any_value(role))) IN ('assistant', 'ai', 'model') THEN 'assistant'
           WHEN lower(trim(any_value(role))) IN ('tool', 'system', 'developer') THEN 'passed' ELSE 'unreadable' END AS role
    FROM messages WHERE coalesce(active, true) AND NOT coalesce(_compressed_summary, false) AND regexp_matches(content, '[^ \t\r\n]') GROUP BY id)
  WHERE session_id IS NOT NULL GROUP BY session_id, role, ts, content
), o AS (
  SELECT s, role, ts, lag(role) OVER w AS before, row_number() OVER w AS nth, count(*) OVER (PARTITION BY s) AS n FROM m WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY s ORDER BY ts, id)
), f AS (
  SELECT s, count(*) FILTER (WHERE ts IS NULL) AS undated, count(*) FILTER (WHERE role = 'assistant' AND coalesce(before, 'assistant') = 'assistant') AS aa,
    count(*) FILTER (WHERE (role = 'user' AND before = 'user') OR (role = 'user' AND nth = n)) AS uu FROM o GROUP BY s
), x AS (SELECT s, count(*) FILTER (WHERE role = 'unreadable') AS bad FROM m GROUP BY s),
a AS (SELECT id AS s FROM sessions WHERE id IS NOT NULL UNION SELECT session_id FROM messages WHERE session_id IS NOT NULL),
z AS (SELECT a.s AS session_id, CASE WHEN f.s IS NULL THEN 'empty' WHEN x.bad > 0 OR f.undated > 0 OR f.aa > 0 THEN 'broken' WHEN f.uu > 0 THEN 'no_reply' END AS reason
      FROM a LEFT JOIN f ON f.s = a.s LEFT JOIN x ON x.s = a.s)
SELECT session_id, reason FROM z WHERE reason IS NOT NULL
"""


P3_SURVIVORS = P3[: P3.index("SELECT group_id, max(CASE")].replace("l.updated_at AS seen,", "l.updated_at AS seen, l.source,") + """
SELECT group_id, max(CASE WHEN rt = 1 THEN id END) AS trusted_id, max(CASE WHEN rn = 1 THEN id END) AS newest_id, max(CASE WHEN rs = 1 AND sourced THEN id END) AS source_row_id, count(*) AS n_records,
       max(CASE WHEN rt = 1 THEN trust END) AS built_trust, max(CASE WHEN rn = 1 THEN seen END) AS built_updated_at, max(CASE WHEN rs = 1 AND sourced THEN source END) AS built_source
FROM t GROUP BY group_id
"""

# z ln z of the four cells, the margins and the whole
_Z = lambda z: f"CASE WHEN {z} > 0 THEN ({z}) * ln({z}) ELSE 0 END"
P4_PAIRS = _PAIRS + "SELECT a, b, n_ab, n_a, n_b, n, round(lift, 6) AS lift, round(2 * (" + " + ".join(_Z(z) for z in ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab", "n")) + " - " + " - ".join(_Z(z) for z in ("n_a", "n - n_a", "n_b", "n - n_b")) + "), 3) AS llr FROM q"

# Kept sessions in order. No message without a session quotes another in these tables, so none of them is a kept conversation.
P5_CONVERSATIONS = P5[: P5.index("SELECT session_id, reason FROM z")] + """
SELECT s AS conversation, row_number() OVER (PARTITION BY s ORDER BY ts, id) AS turn, id, role, ts, content FROM m WHERE role IN ('user', 'assistant') AND s IN (SELECT session_id FROM z WHERE reason IS NULL)
"""

ORACLE = {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_survivors": P3_SURVIVORS, "p4_found": P4, "p4_pairs": P4_PAIRS, "p5_found": P5, "p5_conversations": P5_CONVERSATIONS}
