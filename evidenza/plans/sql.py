"""Pieces that the SQL equivalents share."""

from __future__ import annotations


def TOKENS(column: str) -> str:  # noqa: N802
    return f"regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+')"


def KEY(column: str) -> str:  # noqa: N802
    return f"trim(regexp_replace(lower({column}), '[ \\t\\r\\n]+', ' ', 'g'))"


#: m: the newest version of each memory.
MEM_CTE = r"""m AS (SELECT * REPLACE (coalesce(nullif(lower(trim(source, ' ')), ''), 'unknown') AS source, coalesce(agent, '') AS agent, coalesce(visibility, 'private') AS visibility, coalesce(status, 'active') AS status),
  CASE WHEN trust_score >= 0 AND trust_score <= 1 THEN trust_score END AS trust
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS vr FROM memories WHERE id IS NOT NULL) WHERE vr = 1)"""
MEM = "WITH " + MEM_CTE
LINK_CTE = "l AS (SELECT DISTINCT memory_id, entity_id FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL)"
MSG_CTE = "g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp DESC NULLS LAST) AS vr FROM messages WHERE id IS NOT NULL) WHERE vr = 1)"
SES_CTE = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY started_at DESC NULLS LAST) AS vr FROM sessions WHERE id IS NOT NULL) WHERE vr = 1)"
TURN_CTE = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS vr FROM turns WHERE id IS NOT NULL) WHERE vr = 1)"
CLAIM_CTE = """c AS (SELECT event_id AS id, 'user-' || user_id AS subject, event_type AS predicate, floor(value / 10)::BIGINT AS object, ts AS observed_at,
  0.5 + 0.5 * (k % 2) AS confidence, k % 3 = 0 AS verified, k % 5 + 1 AS seen_count FROM (SELECT *, coalesce(json_extract(props, '$.k')::INT, 0) AS k FROM events))"""
SIG_CTE = """g AS (SELECT event_id AS id, event_id % 500 AS memory_id, 'agent-' || (user_id % 8) AS agent, user_id, event_type AS signal_type, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS direction,
  CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'signup' THEN 0.8 WHEN 'error' THEN 1.0 ELSE 0.2 END::DOUBLE AS weight, event_type IN ('purchase', 'error') AS explicit, ts AS created_at FROM events)"""
NOW = "TIMESTAMP '2025-06-30 00:00:00'"
