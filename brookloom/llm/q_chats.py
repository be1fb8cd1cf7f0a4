"""Queries of problem 4."""

from __future__ import annotations

from brookloom.llm import chats


def _path(sf_dir):
    return f"{sf_dir}/chat_history.parquet"


def p4_found(spark, sf_dir):
    """Sessions that the stream's validation leaves out, by reason."""
    return chats.reasons(chats.verdicts(chats.run(spark, _path(sf_dir))))


def p4_sessions(spark, sf_dir):
    return chats.verdicts(chats.run(spark, _path(sf_dir))).select("session_id", "empty", "missing_reply", "broken", "turns")


def p4_conversations(spark, sf_dir):
    """The sound conversations, message by message."""
    return chats.conversations(chats.run(spark, _path(sf_dir)), spark.read.parquet(_path(sf_dir)))


_SESSIONS = """
WITH once AS (
  SELECT session_id, id, min(created_at) AS sent, arg_min(role, created_at) AS role, arg_min(content, created_at) AS content
  FROM chat_history WHERE session_id IS NOT NULL GROUP BY session_id, id
), o AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM once WHERE role IN ('user', 'assistant')
  WINDOW w AS (PARTITION BY session_id ORDER BY sent, CASE role WHEN 'user' THEN 1 ELSE 2 END, id)
), j AS (
  SELECT session_id, NOT coalesce(bool_or(regexp_matches(content, '[\\p{L}\\p{N}]')), false) AS "empty",
    bool_or(role = 'user' AND (after IS NULL OR after = 'user')) AS missing_reply,
    bool_or(role = 'assistant' AND (before IS NULL OR before = 'assistant')) AS broken, count(*) AS turns
  FROM o GROUP BY session_id
), s AS (
  SELECT session_id, coalesce("empty", true) AS "empty", coalesce(missing_reply, false) AS missing_reply, coalesce(broken, false) AS broken, coalesce(turns, 0) AS turns
  FROM (SELECT DISTINCT session_id FROM once) LEFT JOIN j USING (session_id)
)
"""

QUERIES = {"p4_found": p4_found, "p4_sessions": p4_sessions, "p4_conversations": p4_conversations}
SQL = {
    "p4_sessions": _SESSIONS + "SELECT * FROM s",
    "p4_found": _SESSIONS + """SELECT session_id, 'empty' AS reason FROM s WHERE "empty" UNION ALL SELECT session_id, 'missing_reply' FROM s WHERE missing_reply
  UNION ALL SELECT session_id, 'broken' FROM s WHERE broken""",
    "p4_conversations": _SESSIONS + """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY sent, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END, id) AS turn, role, content
FROM once WHERE session_id IN (SELECT session_id FROM s WHERE NOT ("empty" OR missing_reply OR broken))""",
}
