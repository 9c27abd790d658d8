"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

from threadloom.functions import fixed

SQL: dict[str, str] = {}

# ------------------------------------------------------------------ fragments

US = "chr(31)"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}._:@/\\]*"


def norm(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}._:@/\\]+', ' ', 'g'))"


def words(normed: str) -> str:
    return rf"list_transform(regexp_extract_all({normed}, '{WORD}'), lambda w: regexp_replace(w, '[._:@/\\]+$', ''))"


def stem(t: str) -> str:
    base = f"left({t}, length({t}) - 3)"
    return f"""CASE WHEN {t} = 'people' THEN 'person' WHEN {t} = 'lost' THEN 'loss'
      WHEN length({t}) > 5 AND suffix({t}, 'ies') THEN {base} || 'y'
      WHEN length({t}) > 5 AND suffix({t}, 'ing') THEN
        CASE WHEN right({base}, 1) = left(right({base}, 2), 1) AND length({base}) > 1
             THEN left({base}, length({base}) - 1) ELSE {base} END
      WHEN length({t}) > 5 AND suffix({t}, 'ed') THEN left({t}, length({t}) - 2)
      WHEN length({t}) > 4 AND suffix({t}, 's') AND right({t}, 2) NOT IN ('ss', 'us', 'is')
        THEN left({t}, length({t}) - 1)
      ELSE {t} END"""


def in_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOPS = in_list(fixed.STOP_WORDS)
STOP_LIST = f"[{STOPS}]"


def stems(tokens: str) -> str:
    return f"list_transform({tokens}, lambda s: {stem('s')})"


def distinct(items: str) -> str:
    """First occurrences, in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def meaningful(distinct_stems: str) -> str:
    kept = f"list_filter({distinct_stems}, lambda m: m NOT IN ({STOPS}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {distinct_stems} END"


# ------------------------------------------------------------------ the model over the given tables

def model_ctes(node_text: str = "text") -> str:
    return f"""
msgs AS (
  SELECT 'c' || conv_id AS conversation_id, conv_id AS num, turn, role, text FROM conversations
  UNION ALL
  SELECT 'd' || doc_id, doc_id, 0::BIGINT, 'user', text FROM documents),
hdr AS (
  SELECT conversation_id, num, split_part(split_part(text, chr(10), 1), '.', 1) AS title, 'ns' || (num % 4) AS namespace,
         'u' || (num % 3) AS user_id,
         TIMESTAMP '2024-01-01' + to_days((num % 1000)::INTEGER) AS updated_at,
         (SELECT 't' || lpad(max(m2.turn)::VARCHAR, 6, '0') FROM msgs m2
          WHERE m2.conversation_id = m.conversation_id) AS current_node
  FROM msgs m WHERE turn = 0),
nodes AS (
  SELECT conversation_id, turn, 't' || lpad(turn::VARCHAR, 6, '0') AS node_id,
         CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 4 THEN 't' || lpad((turn - 2)::VARCHAR, 6, '0')
              ELSE 't' || lpad((turn - 1)::VARCHAR, 6, '0') END AS parent_id, role, {node_text} AS text
  FROM msgs),
act AS (
  SELECT h.conversation_id, h.current_node AS node_id, 0 AS d FROM hdr h
  UNION ALL
  SELECT a.conversation_id, n.parent_id, a.d + 1 FROM act a
  JOIN nodes n ON n.conversation_id = a.conversation_id AND n.node_id = a.node_id
  WHERE n.parent_id IS NOT NULL),
active AS (
  SELECT conversation_id, node_id, (max(d) OVER (PARTITION BY conversation_id) - d)::BIGINT AS sequence FROM act),
leaves AS (
  SELECT n.conversation_id, n.node_id FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.conversation_id = n.conversation_id AND c.parent_id = n.node_id)
    AND NOT EXISTS (SELECT 1 FROM active a WHERE a.conversation_id = n.conversation_id AND a.node_id = n.node_id)),
alt AS (
  SELECT conversation_id, node_id AS leaf, node_id, 0 AS d FROM leaves
  UNION ALL
  SELECT a.conversation_id, a.leaf, n.parent_id, a.d + 1 FROM alt a
  JOIN nodes n ON n.conversation_id = a.conversation_id AND n.node_id = a.node_id
  WHERE n.parent_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM active x WHERE x.conversation_id = a.conversation_id AND x.node_id = a.node_id)),
paths AS (
  SELECT conversation_id, 'active' AS branch_key, sequence AS pos, node_id, sequence FROM active
  UNION ALL
  SELECT a.conversation_id, 'alternate:' || a.leaf,
         (max(a.d) OVER (PARTITION BY a.conversation_id, a.leaf) - a.d)::BIGINT, a.node_id, x.sequence
  FROM alt a LEFT JOIN active x ON x.conversation_id = a.conversation_id AND x.node_id = a.node_id),
digest AS (
  SELECT conversation_id, sha256(concat_ws({US}, node_id, coalesce(parent_id, ''), role, text)) AS h FROM nodes),
bucket AS (
  SELECT conversation_id, left(h, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n
  FROM digest GROUP BY ALL),
seg AS (
  SELECT conversation_id, sha256(string_agg(h, '' ORDER BY b)) AS segment_hash, sum(n)::BIGINT AS node_count
  FROM bucket GROUP BY ALL),
rev AS (
  SELECT *, sha256(concat('revision', {US}, conversation_id, {US}, content_hash)) AS revision_id FROM (
    SELECT *, sha256(concat('revision-content', {US}, segment_id)) AS content_hash FROM (
      SELECT s.*, sha256(concat('segment', {US}, sha256(concat_ws({US}, 'header', conversation_id, '', '', title, namespace,
        current_node, '', updated_at::VARCHAR, '{{}}')), {US}, segment_hash)) AS segment_id
      FROM seg s JOIN hdr h USING (conversation_id))))
"""


MODEL = model_ctes()


def est(text: str) -> str:
    return f"greatest(1, ceil(strlen({text}) / 3.0))::BIGINT"


def split_ctes(source: str, budget: str) -> str:
    """Hard split of ``source(k, text)`` by recursion; ``cuts(k, part, char_start, char_end)``."""
    return f"""
over_budget AS (SELECT k, text, {budget} AS budget FROM {source} WHERE {est('text')} > {budget}),
chars AS (SELECT k, text, budget, unnest(regexp_extract_all(text, '(?s).')) AS ch,
                 unnest(range(length(text)::BIGINT)) AS i FROM over_budget),
cum AS (SELECT k, i, budget, sum(strlen(ch)) OVER w - strlen(ch) AS bytes_before, sum(strlen(ch)) OVER w AS bytes_to,
               ch, lead(ch, 1) OVER w AS c1, lead(ch, 2) OVER w AS c2
        FROM chars WINDOW w AS (PARTITION BY k ORDER BY i)),
marks AS (SELECT k, i,
            max(CASE WHEN ch = chr(10) AND c1 = chr(10) AND c2 = '#' THEN i END) OVER w AS h,
            max(CASE WHEN ch = chr(10) AND c1 = chr(10) THEN i END) OVER w AS p,
            max(CASE WHEN ch = chr(10) THEN i END) OVER w AS n,
            max(CASE WHEN ch = ' ' THEN i END) OVER w AS s
          FROM cum WINDOW w AS (PARTITION BY k ORDER BY i)),
ev AS (SELECT k, bytes_to AS v, 0 AS kind, i, NULL::BIGINT AS start_at FROM cum
       UNION ALL SELECT k, bytes_before + 3 * budget, 1, NULL, i FROM cum),
ends AS (SELECT k, start_at, end_at FROM (
           SELECT k, kind, start_at, max(i) OVER (PARTITION BY k ORDER BY v, kind
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS end_at FROM ev) WHERE kind = 1),
sizes AS (SELECT k, length(text)::BIGINT AS size FROM over_budget),
cuts AS (
  SELECT k, 0 AS part, 0::BIGINT AS char_start, NULL::BIGINT AS char_end FROM over_budget
  UNION ALL
  SELECT k, part + 1, char_end_next, NULL FROM (
    SELECT c.k, c.part, {cut_case()} AS char_end_next, z.size
    FROM cuts c JOIN ends e ON e.k = c.k AND e.start_at = c.char_start JOIN sizes z ON z.k = c.k
    LEFT JOIN marks m3 ON m3.k = c.k AND m3.i = e.end_at - 3
    LEFT JOIN marks m2 ON m2.k = c.k AND m2.i = e.end_at - 2
    LEFT JOIN marks m1 ON m1.k = c.k AND m1.i = e.end_at - 1) q
  WHERE char_end_next < size),
parts AS (
  SELECT k, part::BIGINT AS part, char_start,
         coalesce(lead(char_start) OVER (PARTITION BY k ORDER BY part), size) AS char_end
  FROM cuts JOIN sizes USING (k))
"""


def cut_case() -> str:
    half = "(e.end_at - c.char_start) / 2.0"
    return f"""CASE WHEN e.end_at >= z.size THEN e.end_at
      WHEN m3.h - c.char_start > {half} THEN m3.h + 2
      WHEN m2.p - c.char_start > {half} THEN m2.p + 2
      WHEN m1.n - c.char_start > {half} THEN m1.n + 1
      WHEN m1.s - c.char_start > {half} THEN m1.s + 1
      ELSE e.end_at END"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def group_ctes(source: str, keys: str) -> str:
    """Greedy grouping of ``source(keys, idx, size)``, idx from 0; gives ``grouped(keys, idx, g)``."""
    same = " AND ".join(f"u.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    gk = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    joins = "u.size <= 64 AND g.cnt > 0 AND g.cnt < 6 AND g.tok + u.size <= 320"
    return f"""
grouped AS (
  SELECT {keys}, idx, 0::BIGINT AS g, size AS tok, CASE WHEN size <= 64 THEN 1 ELSE 0 END AS cnt
  FROM {source} WHERE idx = 0
  UNION ALL
  SELECT {gk}, u.idx, CASE WHEN {joins} THEN g.g ELSE g.g + 1 END,
         CASE WHEN {joins} THEN g.tok + u.size ELSE u.size END,
         CASE WHEN {joins} THEN g.cnt + 1 WHEN u.size <= 64 THEN 1 ELSE 0 END
  FROM grouped g JOIN {source} u ON {same} AND u.idx = g.idx + 1)
"""


UNITS = f"""
long_msgs AS (SELECT conversation_id || ':' || node_id AS k, text, role FROM nodes),
long_split AS (SELECT k, text FROM long_msgs),
""" + split_ctes("(SELECT k, text, role FROM long_msgs)", "(1800 - " + est("'[' || role || ']' || chr(10)") + ")") + f""",
unit AS (
  SELECT n.conversation_id, n.node_id, coalesce(p.part, 0) AS part, coalesce(p.char_start, 0) AS char_start,
         coalesce(p.char_end, length(n.text)::BIGINT) AS char_end, p.k IS NOT NULL AS is_split,
         '[' || n.role || ']' || chr(10) ||
           substring(n.text, coalesce(p.char_start, 0) + 1, coalesce(p.char_end, length(n.text)) - coalesce(p.char_start, 0)) AS body
  FROM nodes n LEFT JOIN parts p ON p.k = n.conversation_id || ':' || n.node_id
  WHERE trim(n.text) <> ''),
placed AS (
  SELECT p.conversation_id, p.branch_key, p.sequence, u.*  EXCLUDE (conversation_id),
         row_number() OVER (PARTITION BY p.conversation_id, p.branch_key ORDER BY p.pos, u.part) - 1 AS idx,
         CASE WHEN u.is_split THEN greatest({est('u.body')}, 65) ELSE {est('u.body')} END AS size
  FROM paths p JOIN unit u ON u.conversation_id = p.conversation_id AND u.node_id = p.node_id),
""" + group_ctes("placed", "conversation_id, branch_key") + f""",
asm AS (
  SELECT conversation_id, branch_key, g AS ordinal, string_agg(body, chr(10) || chr(10) ORDER BY idx) AS body,
         string_agg(node_id || ':' || char_start || ':' || char_end, '|' ORDER BY idx) AS places,
         count(*) AS n_sources
  FROM placed JOIN grouped USING (conversation_id, branch_key, idx) GROUP BY ALL),
chunk AS (
  SELECT sha256(concat_ws({US}, 'chunk', 'chat-turn-v2', 'gen-1', r.revision_id, a.branch_key, a.places)) AS chunk_id,
         r.revision_id, a.*, h.title, h.namespace, h.user_id, h.updated_at, h.num
  FROM asm a JOIN rev r USING (conversation_id) JOIN hdr h USING (conversation_id))
"""


def model(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([MODEL, *more]) + "\n" + select


# ------------------------------------------------------------------ ids and text

SQL["domain_ids"] = model(f"""
SELECT conversation_id, turn, sha256(concat('conversation', {US}, 'chatgpt', {US}, conversation_id)) AS import_id,
       sha256(concat('mcp-message', {US}, role, {US}, text)) AS message_id,
       sha256(concat('vector', {US}, '', {US}, conversation_id)) AS null_part_id FROM msgs""")

SQL["token_estimates"] = model(f"SELECT conversation_id, turn, {est('text')} AS tokens FROM msgs")

TOKENS = f"tok AS (SELECT unnest({words('n')}) AS token FROM (SELECT {norm('text')} AS n FROM msgs))"
SQL["token_counts"] = model("SELECT token, count(*) AS n FROM tok GROUP BY token", TOKENS)
SQL["stemmed_counts"] = model(
    f"SELECT stem, count(*) AS n FROM (SELECT {stem('token')} AS stem FROM tok) GROUP BY stem", TOKENS
)
SQL["stopword_filtered"] = model(
    f"""SELECT conversation_id, turn, len(kept)::BIGINT AS n, array_to_string(kept[1:12], ' ') AS first_tokens,
               array_to_string({distinct('w')}[1:12], ' ') AS first_lexical
    FROM (SELECT *, {meaningful('ds')} AS kept FROM (SELECT *, {distinct('s')} AS ds FROM
          (SELECT *, {stems('w')} AS s FROM (SELECT conversation_id, turn, {words(norm('text'))} AS w FROM msgs))))"""
)
NAME = r"\p{Lu}[\p{L}\p{N}._:@/-]*"
SQL["entity_tokens"] = f"""
WITH n AS (SELECT item_id, text, unnest(regexp_extract_all(text, '{NAME}')) AS name,
                  generate_subscripts(regexp_extract_all(text, '{NAME}'), 1) AS i FROM benchmark),
t AS (SELECT item_id, i, unnest({stems(words(norm('name')))}) AS s FROM n),
k AS (SELECT item_id, s, min(i) AS i FROM t WHERE length(s) >= 2 AND s NOT IN ({STOPS}) GROUP BY ALL)
SELECT b.item_id, CASE WHEN length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) = length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))
       THEN '' ELSE coalesce((SELECT string_agg(s, ' ' ORDER BY k.i) FROM k WHERE k.item_id = b.item_id), '') END AS entities
FROM benchmark b"""

CONCEPT_VALUES = ",\n".join(
    f"({ci}, {pi}, {sql_text(name)}, {sql_text(phrase)}, {sql_text(label)})"
    for ci, (name, phrases, label) in enumerate(fixed.CONCEPTS)
    for pi, phrase in enumerate(phrases)
)
CONCEPTS = f"""
concept(ci, pi, name, phrase, label) AS (VALUES {CONCEPT_VALUES}),
cstem AS (SELECT ci, min(pi) AS pi, name, phrase FROM
  (SELECT ci, pi, name, array_to_string({stems("string_split(phrase, ' ')")}, ' ') AS phrase FROM concept) GROUP BY ALL)
"""
PHRASES = "[" + in_list([p for _, phrases, _ in fixed.CONCEPTS for p in phrases]) + "]"


def phrase(number: str) -> str:
    return f"{PHRASES}[({number}) % len({PHRASES}) + 1]"


SQL["concept_detection"] = model(
    f"""SELECT id, name AS concept, string_agg(phrase, '|' ORDER BY pi) AS phrases
    FROM (SELECT id, array_to_string({stems('w')}, ' ') AS st FROM (SELECT id, {words(norm('text'))} AS w FROM (
      SELECT conversation_id || ':' || turn AS id, {phrase('num + turn')} || ' ' || text || ' ' || upper({phrase('num * 7 + turn')}) AS text
      FROM msgs UNION ALL SELECT 'p' || page_id, html FROM pages)))
    JOIN cstem ON contains(' ' || st || ' ', ' ' || phrase || ' ') GROUP BY id, name""",
    CONCEPTS,
)
SQL["tags_normalized"] = model("""
SELECT conversation_id, 't' || (num % 5) || '|lang-' || (num % 2) || '|' || namespace AS tags FROM hdr""")
SQL["structured_labels"] = model(
    f"""SELECT conversation_id, turn, coalesce(string_agg(label, '|' ORDER BY i), '') AS labels FROM (
      SELECT conversation_id, turn, label, min(i) AS i FROM (
        SELECT conversation_id, turn, i, w[i] || ' ' || w[i + 1] AS label,
               w[i] IN ({in_list(fixed.STRUCTURED_LABEL_KINDS)}) AND regexp_full_match(w[i + 1], '[0-9]+') AS ok
        FROM (SELECT *, unnest(range(1, len(w))) AS i FROM (
          SELECT conversation_id, turn, {words(norm("regexp_replace(x, '[._:@/" + chr(92) * 2 + "]+', ' ', 'g')"))} AS w FROM (
            SELECT *, 'Event ' || num || '/phase-' || turn || ' chapter_' || (num % 7) || ' ' || text AS x FROM msgs)))
      ) WHERE ok GROUP BY ALL) GROUP BY conversation_id, turn"""
)
SQL["headings"] = model("""
SELECT conversation_id, turn, array_to_string(list_concat([split_part(split_part(text, chr(10), 1), '.', 1)],
   list_transform(list_filter(list_transform(string_split(b, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13))),
     lambda s: length(s) > 2 AND prefix(s, '[') AND suffix(s, ']')), lambda s: substring(s, 2, length(s) - 2))[1:2]), '|') AS headings
FROM (SELECT *, '[Chat ' || num || ']' || chr(10) || '  [turn ' || turn || '] ' || chr(10) || '[]' || chr(10) || '[third]' || chr(10) || text AS b
      FROM msgs)""")

# ------------------------------------------------------------------ graph

SQL["linear_nodes"] = model(f"""
SELECT conversation_id, sha256(concat_ws({US}, 'message-node', conversation_id, node_id)) AS id, node_id,
       coalesce(lag(node_id) OVER w, '-') AS parent_id, coalesce(lead(node_id) OVER w, '') AS children, role,
       sequence, sequence + 2 AS line_number
FROM (SELECT *, 'mcp-' || sequence || '-' || sha256(concat_ws({US}, 'mcp-message', role, text)) AS node_id
      FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) - 1 AS sequence FROM msgs))
WINDOW w AS (PARTITION BY conversation_id ORDER BY turn)""")
SQL["active_branch"] = model("SELECT conversation_id, node_id, sequence FROM active")
SQL["alternate_branches"] = model("""
SELECT conversation_id, branch_key, pos, node_id, coalesce(sequence, -1) AS sequence FROM paths WHERE branch_key <> 'active'""")
SQL["graph_anomalies"] = model(
    """SELECT conversation_id, 'current_node_missing:gone' AS anomaly FROM hdr WHERE num % 7 = 0
    UNION ALL
    SELECT w.conversation_id, CASE WHEN n.parent_id = 'ghost' THEN 'dangling_parent:ghost' ELSE 'cycle:' || n.parent_id END
    FROM (SELECT conversation_id, arg_max(node_id, d) AS node_id FROM walk GROUP BY conversation_id) w
    JOIN bad n ON n.conversation_id = w.conversation_id AND n.node_id = w.node_id
    WHERE n.parent_id IS NOT NULL""",
    """
bad AS (SELECT n.conversation_id, n.node_id, n.turn,
          CASE WHEN n.turn = 0 AND h.num % 11 = 5 THEN 'ghost' WHEN n.turn = 0 AND h.num % 13 = 6 THEN h.current_node
               ELSE n.parent_id END AS parent_id FROM nodes n JOIN hdr h USING (conversation_id)),
allleaf AS (SELECT conversation_id, max(node_id) AS leaf FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.conversation_id = n.conversation_id AND c.parent_id = n.node_id)
  GROUP BY conversation_id),
walk AS (
  SELECT h.conversation_id, CASE WHEN num % 7 < 2 THEN l.leaf ELSE current_node END AS node_id, 0 AS d,
         [CASE WHEN num % 7 < 2 THEN l.leaf ELSE current_node END] AS seen
  FROM hdr h JOIN allleaf l USING (conversation_id)
  UNION ALL
  SELECT w.conversation_id, b.parent_id, w.d + 1, list_append(w.seen, b.parent_id) FROM walk w
  JOIN bad b ON b.conversation_id = w.conversation_id AND b.node_id = w.node_id
  WHERE b.parent_id IS NOT NULL AND b.parent_id <> 'ghost' AND NOT list_contains(w.seen, b.parent_id))""",
)

# ------------------------------------------------------------------ chunks

SQL["hard_split"] = model(
    f"""SELECT conversation_id, turn, coalesce(part, 0) AS part, coalesce(char_start, 0) AS char_start,
        coalesce(char_end, length(text)::BIGINT) AS char_end
    FROM msgs LEFT JOIN parts ON k = conversation_id || ':' || turn""",
    "src AS (SELECT conversation_id || ':' || turn AS k, text FROM msgs)," + split_ctes("src", "1797"),
)
SQL["chunk_groups"] = model(
    """SELECT conversation_id, turn, g AS ordinal, min(idx) AS first_line, count(*) AS lines FROM grouped GROUP BY ALL""",
    f"""lines AS (SELECT conversation_id, turn, idx, {est('unit')} AS size FROM (
         SELECT conversation_id, turn, unnest(string_split(text, chr(10))) AS unit,
                unnest(range(len(string_split(text, chr(10))))) AS idx FROM msgs)),"""
    + group_ctes("lines", "conversation_id, turn"),
)
SQL["chunks"] = model(
    f"""SELECT chunk_id, sha256(concat_ws({US}, 'vector', 'gen-1', chunk_id)) AS vector_id, revision_id, conversation_id,
        branch_key, ordinal, title, sha256(body) AS body_sha, {est('body')} AS token_estimate,
        strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z') AS updated_at, namespace, n_sources FROM chunk""",
    UNITS,
)
SQL["chunk_sources"] = model(
    """SELECT c.chunk_id, row_number() OVER (PARTITION BY c.chunk_id ORDER BY idx) - 1 AS ordinal, p.node_id AS source_node_id,
        coalesce(p.sequence, -1) AS source_sequence, p.char_start, p.char_end
    FROM placed p JOIN grouped g USING (conversation_id, branch_key, idx)
    JOIN chunk c ON c.conversation_id = p.conversation_id AND c.branch_key = p.branch_key AND c.ordinal = g.g""",
    UNITS,
)
SQL["revision_ids"] = model("SELECT conversation_id, segment_id, content_hash, revision_id, node_count FROM rev")
