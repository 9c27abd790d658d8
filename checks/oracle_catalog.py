"""DuckDB SQL for the catalog queries."""

from __future__ import annotations

from .oracle import SQL, UNITS, US, model
from .oracle_search import STATE

LIVE = "live AS (SELECT * FROM hdr WHERE num % 17 <> 3)"
GRANTS = "grants AS (SELECT user_id, namespace FROM hdr UNION SELECT user_id, 'spare-' || user_id FROM hdr)"
VERSIONS = f"""
ver AS (SELECT conversation_id, num, turn AS seq, sha256(concat_ws({US}, 'revision', conversation_id, text)) AS revision_id,
   TIMESTAMP '2024-01-01' + to_days((num % 1000)::INTEGER + (CASE WHEN (num + turn) % 4 = 0 THEN -turn ELSE turn END)::INTEGER) AS updated_at FROM msgs),
cur AS (SELECT conversation_id, arg_max(revision_id, (updated_at, seq)) AS revision_id, arg_max(seq, (updated_at, seq)) AS seq
   FROM ver WHERE num % 17 <> 3 GROUP BY conversation_id)
"""
SQL["current_revisions"] = model("SELECT conversation_id, revision_id, seq FROM cur", VERSIONS)
SQL["list_conversations"] = model(
    """SELECT conversation_id, title, namespace, tags, CASE WHEN n > 20 THEN max(conversation_id) OVER () END AS next_cursor
    FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY conversation_id) AS i FROM (
      SELECT conversation_id, title, namespace, 't' || (num % 5) || '|lang' || (num % 2) AS tags FROM live
      WHERE user_id = 'u1' AND namespace IN ('ns0', 'ns1', 'ns3') AND num % 5 IN (1, 2) AND conversation_id > 'c15'
      ORDER BY conversation_id LIMIT 21)) WHERE i <= 20""",
    LIVE,
)
SQL["list_namespaces"] = model(
    """SELECT g.user_id, g.namespace, count(l.conversation_id) AS conversations, g.namespace = 'ns1' AS is_default
    FROM grants g LEFT JOIN live l ON l.user_id = g.user_id AND l.namespace = g.namespace GROUP BY ALL""",
    LIVE, GRANTS,
)
SQL["memory_stats"] = model(
    """SELECT user_id, coalesce(namespace, '(all)') AS namespace, sum(c)::BIGINT AS conversations, sum(m)::BIGINT AS messages FROM (
      SELECT g.user_id, g.namespace, count(DISTINCT l.conversation_id) AS c, count(m.turn) AS m
      FROM grants g LEFT JOIN live l ON l.user_id = g.user_id AND l.namespace = g.namespace
      LEFT JOIN msgs m ON m.conversation_id = l.conversation_id GROUP BY ALL)
    GROUP BY GROUPING SETS ((user_id, namespace), (user_id))""",
    LIVE, GRANTS,
)
SQL["index_health"] = model(
    """SELECT l.user_id, count_if(s.status = 'indexed')::BIGINT AS indexed, count_if(s.status <> 'indexed')::BIGINT AS pending
    FROM st s JOIN live l USING (conversation_id) GROUP BY l.user_id""",
    LIVE, STATE,
)
SQL["context_window"] = model(
    """SELECT conversation_id AS revision_id, branch_key, ordinal AS chunk_ordinal,
        row_number() OVER (PARTITION BY conversation_id, branch_key, ordinal ORDER BY o, node_id) - 1 AS position, node_id, is_match
    FROM (SELECT conversation_id, branch_key, ordinal, o, node_id, is_match FROM near
          UNION ALL SELECT conversation_id, branch_key, ordinal, min(o), node_id, bool_or(is_match) FROM side GROUP BY ALL)""",
    UNITS,
    """
src AS (SELECT p.conversation_id, p.branch_key, g.g AS ordinal, p.node_id, p.sequence,
          row_number() OVER (PARTITION BY p.conversation_id, p.branch_key, g.g ORDER BY p.idx) - 1 AS slot
        FROM placed p JOIN grouped g USING (conversation_id, branch_key, idx)),
span AS (SELECT conversation_id, branch_key, ordinal, min(sequence) AS lo, max(sequence) AS hi, list(node_id) AS own FROM src GROUP BY ALL),
near AS (SELECT s.conversation_id, s.branch_key, s.ordinal, a.sequence AS o, a.node_id, list_contains(s.own, a.node_id) AS is_match
         FROM span s JOIN active a ON a.conversation_id = s.conversation_id AND a.sequence BETWEEN s.lo - 1 AND s.hi + 2),
lone AS (SELECT s.*, x.own FROM src s JOIN span x USING (conversation_id, branch_key, ordinal) WHERE x.lo IS NULL),
side AS (
  SELECT conversation_id, branch_key, ordinal, slot * 3 AS o, node_id, true AS is_match FROM lone
  UNION ALL
  SELECT l.conversation_id, l.branch_key, l.ordinal, l.slot * 3 + 1, n.parent_id, list_contains(l.own, n.parent_id)
  FROM lone l JOIN nodes n ON n.conversation_id = l.conversation_id AND n.node_id = l.node_id WHERE n.parent_id IS NOT NULL
  UNION ALL
  SELECT l.conversation_id, l.branch_key, l.ordinal, l.slot * 3 + 2, n.node_id, list_contains(l.own, n.node_id)
  FROM lone l JOIN nodes n ON n.conversation_id = l.conversation_id AND n.parent_id = l.node_id)""",
)
SQL["context_ranges"] = model(
    """SELECT revision_id, branch_key, chunk_ordinal, node_id, min(char_start) AS char_start, max(char_end) AS char_end
    FROM (SELECT *, sum(CASE WHEN before >= char_start THEN 0 ELSE 1 END) OVER (
            PARTITION BY revision_id, branch_key, chunk_ordinal, node_id ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) AS run
          FROM (SELECT *, max(char_end) OVER (PARTITION BY revision_id, branch_key, chunk_ordinal, node_id
                  ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                FROM (SELECT p.conversation_id AS revision_id, p.branch_key, g.g AS chunk_ordinal, p.node_id, p.char_start, p.char_end
                      FROM placed p JOIN grouped g USING (conversation_id, branch_key, idx)
                      JOIN live l ON l.conversation_id = p.conversation_id
                      WHERE (l.num % 3 <> 0 OR l.namespace IN ('ns0', 'ns1')) AND (l.num % 5 <> 0 OR l.user_id = 'u1'))))
    GROUP BY revision_id, branch_key, chunk_ordinal, node_id, run""",
    UNITS,
    LIVE,
)
SQL["conversation_page"] = model(
    """SELECT l.conversation_id AS request_id, l.conversation_id, a.sequence AS position, a.node_id, t.total,
        CASE WHEN l.num % 3 + 3 < t.total THEN l.num % 3 + 3 ELSE -1 END AS next_offset
    FROM live l JOIN active a USING (conversation_id) JOIN (SELECT conversation_id, count(*) AS total FROM active GROUP BY ALL) t USING (conversation_id)
    WHERE a.sequence >= l.num % 3 AND a.sequence < l.num % 3 + 3""",
    LIVE,
)
SQL["scope_requests"] = model(
    """SELECT request_id, CASE WHEN error <> '' THEN '' WHEN requested IS NOT NULL THEN requested
         ELSE (SELECT string_agg(namespace, '|' ORDER BY namespace) FROM grants g WHERE g.user_id = r.user_id) END AS namespaces, error
    FROM (SELECT *, CASE WHEN user_id = 'nobody' THEN 'unknown user'
            WHEN requested IS NOT NULL AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.user_id = q.user_id AND g.namespace = q.requested)
            THEN 'namespace not accessible' ELSE '' END AS error FROM (
      SELECT conversation_id || ':' || turn AS request_id, CASE WHEN num % 11 = 0 THEN 'nobody' ELSE 'u' || (num % 3) END AS user_id,
             CASE WHEN num % 5 = 0 THEN NULL WHEN num % 5 = 1 THEN 'elsewhere' ELSE 'ns' || (num % 4) END AS requested FROM msgs) q) r""",
    GRANTS,
)
SQL["provision_users"] = model(f"""
SELECT DISTINCT sha256(concat_ws({US}, 'user', email)) AS user_id, email, sha256(concat_ws({US}, 'user', email)) AS namespace
FROM (SELECT 'user' || (num % 50) || '@example.org' AS email, num FROM hdr WHERE num % 6 <> 0) WHERE num % 50 >= 5""")
SQL["namespace_backfill"] = model("SELECT DISTINCT user_id, namespace FROM live WHERE namespace = 'ns2'", LIVE)
SQL["append_conflicts"] = model(
    """SELECT request_id, CASE WHEN live IS NULL THEN 'not_found' WHEN base <> live THEN 'conflict'
         WHEN row_number() OVER (PARTITION BY conv, base = live ORDER BY -turn, request_id) = 1 THEN 'applied' ELSE 'conflict' END AS outcome
    FROM (SELECT a.*, c.revision_id AS live FROM (
      SELECT m.conversation_id || ':' || turn AS request_id, turn,
        CASE WHEN num % 9 = 0 THEN 'x' || m.conversation_id ELSE m.conversation_id END AS conv,
        CASE WHEN (num + turn) % 4 = 1 THEN 'stale' ELSE coalesce(c0.revision_id, 'none') END AS base
      FROM msgs m LEFT JOIN cur c0 USING (conversation_id)) a LEFT JOIN cur c ON c.conversation_id = a.conv)""",
    VERSIONS,
)


def appended(ordinal: str) -> str:
    return f"'append-' || sha256(concat_ws({US}, 'append', 'r' || conversation_id, conversation_id, ({ordinal})::VARCHAR))"


SQL["appended_nodes"] = model(f"""
SELECT conversation_id, sha256(concat_ws({US}, 'message-node', conversation_id, {appended('o')})) AS id, {appended('o')} AS node_id,
  CASE WHEN o = 0 THEN current_node ELSE {appended('o - 1')} END AS parent_id, role, sha256(text) AS text_sha, n + o AS sequence, o = k - 1 AS is_leaf
FROM (SELECT m.*, h.current_node, row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.turn) - 1 AS o,
        count(*) OVER (PARTITION BY m.conversation_id) AS k, (SELECT count(*) FROM msgs x WHERE x.conversation_id = m.conversation_id) AS n
      FROM msgs m JOIN hdr h USING (conversation_id))""")
SQL["tag_updates"] = model(
    """SELECT a.conversation_id, a.tag, min(a.seq * 100 + a.step) // 100 AS seq, min(a.seq * 100 + a.step) % 100 AS step
    FROM op a LEFT JOIN (SELECT conversation_id, tag, max(seq * 100 + step) AS gone FROM op WHERE kind = 'remove' GROUP BY ALL) r
      ON r.conversation_id = a.conversation_id AND r.tag = a.tag
    WHERE a.kind = 'add' AND (r.gone IS NULL OR a.seq * 100 + a.step > r.gone) GROUP BY a.conversation_id, a.tag""",
    """
op AS (SELECT conversation_id, turn AS seq, kind, tag, step::BIGINT AS step FROM (
  SELECT conversation_id, num, turn, unnest(['remove', 'remove', 'add', 'add', 'add']) AS kind, unnest([0, 1, 2, 3, 4]) AS step,
    unnest(['a' || ((turn + 1) % 3), 'b' || (turn % 2), 'a' || (turn % 3), 'b' || (num % 2), 'keep']) AS tag FROM msgs WHERE turn % 6 <> 5))""",
)
SQL["delete_report"] = model("""
SELECT r.request_id, r.conversation_id, CASE WHEN NOT found THEN 'missing' WHEN num2 % 13 = 4 THEN 'failed' ELSE 'deleted' END AS outcome,
  CASE WHEN found AND num2 % 13 = 4 THEN 'vectors' ELSE '' END AS stage
FROM (SELECT q.*, h.num AS num2, h.num IS NOT NULL AND (q.num % 3 <> 0 OR h.namespace IN ('ns0', 'ns1')) AND (q.num % 5 <> 0 OR h.user_id = 'u1') AS found
  FROM (SELECT conversation_id || ':' || turn AS request_id, num,
          CASE WHEN num % 8 = 0 THEN 'x' || conversation_id ELSE conversation_id END AS conversation_id FROM msgs) q
  LEFT JOIN hdr h ON h.conversation_id = q.conversation_id) r""")
ASKED = """
asked AS (SELECT q.*, h.num IS NOT NULL AND (q.num % 3 <> 0 OR h.namespace IN ('ns0', 'ns1')) AND (q.num % 5 <> 0 OR h.user_id = 'u1') AS found
  FROM (SELECT 'r' || conversation_id AS request_id, num,
          CASE WHEN num % 8 = 0 THEN 'x' || conversation_id ELSE conversation_id END AS conversation_id FROM hdr) q
  LEFT JOIN hdr h ON h.conversation_id = q.conversation_id)"""
SQL["deleted_state"] = model(
    """SELECT 'outcome ' || CASE WHEN found THEN 'deleted' ELSE 'missing' END AS name, count(*) AS rows, count(DISTINCT conversation_id) AS conversations
    FROM asked WHERE num % 3 <> 1 GROUP BY 1
    UNION ALL SELECT 'revisions', count(*), count(*) FROM hdr WHERE conversation_id NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'index_state', count(*), count(*) FROM hdr WHERE conversation_id NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'nodes', count(*), count(DISTINCT conversation_id) FROM nodes WHERE conversation_id NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'chunks', count(*), count(DISTINCT conversation_id) FROM chunk WHERE conversation_id NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'import_items', count(*), (SELECT count(*) FROM hdr WHERE conversation_id NOT IN (SELECT * FROM gone)) FROM hdr
    UNION ALL SELECT 'tombstones', count(*), count(*) FROM gone""",
    UNITS, ASKED, "gone AS (SELECT conversation_id FROM asked WHERE found AND num % 3 <> 1)",
)
SQL["load_current"] = model(
    """SELECT request_id, revision_id, node_id, role, sha256(text) AS text_sha
    FROM asked JOIN rev USING (conversation_id) JOIN nodes USING (conversation_id) WHERE found AND num % 17 <> 3""",
    ASKED,
)
SQL["append_revisions"] = model(
    f"""SELECT request_id, CASE WHEN base <> live THEN 'conflict' WHEN live IS NULL THEN 'not_found'
        WHEN row_number() OVER (PARTITION BY conv, base = live ORDER BY -turn, request_id) = 1 THEN 'applied' ELSE 'conflict' END AS outcome,
      CASE WHEN base = live THEN base ELSE '' END AS base_revision_id,
      CASE WHEN base = live THEN 'append-' || sha256(concat_ws({US}, 'append', request_id, conv, '1')) ELSE '' END AS current_node,
      CASE WHEN base = live THEN 't' || (num % 5) || '|lang' || (num % 2) || '|new ' || turn || CASE WHEN num % 2 = 1 THEN '|lang0' ELSE '' END ELSE '' END AS tags,
      CASE WHEN base = live THEN '2024-02-01T00:00:00.000Z' ELSE '' END AS updated_at,
      CASE WHEN base = live THEN n + 2 ELSE 0 END::BIGINT AS nodes,
      CASE WHEN base = live THEN users + CASE WHEN role = 'user' THEN 2 ELSE 0 END ELSE 0 END::BIGINT AS user_nodes
    FROM (SELECT a.*, r.revision_id AS live, s.n, s.users FROM (
      SELECT m.conversation_id || ':' || turn AS request_id, m.num, turn, role,
        CASE WHEN m.num % 9 = 0 THEN 'x' || m.conversation_id ELSE m.conversation_id END AS conv,
        CASE WHEN (m.num + turn) % 4 = 1 THEN 'stale' ELSE r0.revision_id END AS base
      FROM msgs m JOIN rev r0 USING (conversation_id) WHERE turn % 3 = 0) a
      LEFT JOIN rev r ON r.conversation_id = a.conv LEFT JOIN sized s ON s.conversation_id = a.conv)""",
    "sized AS (SELECT conversation_id, count(*) AS n, count_if(role = 'user') AS users FROM msgs GROUP BY ALL)",
)
SQL["delete_scopes"] = model("""
SELECT requested, requested AS deleted, 0::BIGINT AS remaining, true AS complete
FROM (SELECT count(*) AS requested FROM hdr WHERE user_id = 'u1' AND namespace IN ('ns0', 'ns2'))""")
SQL["orphan_segments"] = model("""
SELECT segment_id FROM rev JOIN hdr USING (conversation_id) WHERE num % 17 = 3""")

EVENTS = """
evt AS (SELECT 'c' || user_id AS revision_id, ts, event_id,
          CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'indexed' END AS status
        FROM events),
agg AS (SELECT revision_id, arg_max(status, (ts, event_id)) AS status, count_if(status = 'processing') AS attempts,
    coalesce(max(ts) FILTER (WHERE status = 'queued'), min(ts)) AS queued_at, max(ts) FILTER (WHERE status = 'processing') AS started,
    max(ts) FILTER (WHERE status = 'indexed') AS indexed, max(ts) FILTER (WHERE status = 'failed') AS failed, max(ts) AS updated_at FROM evt GROUP BY revision_id)"""


def iso(value: str) -> str:
    return f"coalesce(strftime(date_trunc('millisecond', {value}), '%Y-%m-%dT%H:%M:%S.%gZ'), '')"


SQL["index_state_latest"] = f"""WITH {EVENTS} SELECT revision_id, status, attempts::BIGINT AS attempts, {iso('queued_at')} AS queued_at,
  {iso('CASE WHEN started >= queued_at THEN started END')} AS started_at, {iso('CASE WHEN indexed >= queued_at THEN indexed END')} AS indexed_at,
  {iso('CASE WHEN failed >= greatest(queued_at, coalesce(started, queued_at)) THEN failed END')} AS failed_at, {iso('updated_at')} AS updated_at FROM agg"""
SQL["index_state_stream"] = SQL["index_state_latest"]
SQL["reindex_worklist"] = model(
    f"""SELECT sha256(concat_ws({US}, 'index-job', conversation_id, 'gen-1')) AS job_id, conversation_id AS revision_id, 'gen-1' AS generation_id
    FROM live WHERE conversation_id NOT IN (SELECT revision_id FROM agg WHERE status = 'indexed')""",
    LIVE, EVENTS,
)
SQL["dead_letters"] = f"WITH {EVENTS} SELECT revision_id, attempts::BIGINT AS attempts FROM agg WHERE status = 'failed' AND attempts >= 8"
SQL["stale_vectors"] = f"""WITH {EVENTS} SELECT 'v' || vec_id AS vector_id FROM embeddings
WHERE vec_id % 2 = 0 OR 'c' || (vec_id % 150) NOT IN (SELECT revision_id FROM agg WHERE status = 'indexed')"""
SQL["removed_derived"] = model(
    "SELECT conversation_id, revision_id, seq AS ordinal FROM ver WHERE revision_id IN (SELECT revision_id FROM cur)", VERSIONS
)
IMPORTS = """
imp AS (SELECT 'i' || lpad(doc_id::VARCHAR, 9, '0') AS import_id, source, text, sha256(text) AS sha, doc_id % 97 AS made,
          doc_id % 4 <> 3 AS accepted FROM documents)"""
SQL["raw_checksums"] = f"WITH {IMPORTS} SELECT import_id, sha AS sha256, strlen(text)::BIGINT AS size_bytes FROM imp"
SQL["duplicate_exports"] = f"""WITH {IMPORTS} SELECT import_id, first_id AS duplicate_of FROM (
  SELECT i.import_id, i.made, arg_min(j.import_id, (j.made, j.import_id)) AS first_id, min((j.made, j.import_id)) AS k
  FROM imp i JOIN imp j ON j.source = i.source AND j.sha = i.sha AND j.accepted GROUP BY ALL) WHERE (made, import_id) > k"""
SQL["import_status"] = model("""
SELECT t.import_id, t.processed, t.failed, coalesce(f.ordinal, -1) AS ordinal, coalesce(f.chars, 0)::BIGINT AS message_chars
FROM (SELECT import_id, count(*) AS processed, count_if(bad)::BIGINT AS failed FROM item GROUP BY import_id) t
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY import_id ORDER BY ordinal) AS n FROM item WHERE bad) f ON f.import_id = t.import_id""",
    """
item AS (SELECT 'import-' || (num % 3) AS import_id, num * 16 + turn + CASE WHEN starts_with(conversation_id, 'd') THEN 1000000 ELSE 0 END AS ordinal,
   length(text) > 1500 AS bad, least(1000, length(text) + 15) AS chars FROM msgs)""")
SQL["integrity_audit"] = model("""
SELECT 'missing_manifest' AS problem, revision_id AS detail FROM rev JOIN hdr USING (conversation_id) WHERE num % 19 = 2
UNION ALL
SELECT 'missing_segment', revision_id || ':' || CASE WHEN num % 23 = 1 THEN 'missing-key' ELSE 's/' || segment_id END
FROM rev JOIN hdr USING (conversation_id)
WHERE num % 19 <> 2 AND (num % 23 = 1 OR segment_id NOT IN (SELECT segment_id FROM rev JOIN hdr USING (conversation_id) WHERE num % 29 <> 3))""")
