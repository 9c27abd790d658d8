"""DuckDB SQL for the search queries."""

from __future__ import annotations

from threadloom.functions import fixed

from .oracle import (
    CONCEPTS, MODEL, NAME, PHRASES, SQL, STOPS, UNITS, US, est, in_list, meaningful, model, model_ctes, norm, distinct,
    phrase, sql_text, stem, stems, words,
)

NL = "chr(10)"
SEP = r"[._:@/\\]+"
TITLE = "split_part(split_part(text, chr(10), 1), '.', 1)"


def caps(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


DECORATED = (
    f"'[Event ' || (num % 20) || ' / ' || {caps(phrase('num + turn'))} || ']' || {NL} || 'Owner: ' || "
    f"{phrase('num * 7 + turn')} || {NL} || text"
)
REQUESTS = f"""
req AS (
  SELECT 'q' || item_id AS query_id, item_id,
         CASE item_id % 3 WHEN 0 THEN text
              WHEN 1 THEN 'Event ' || (item_id % 20) || ' ' || {caps(phrase('item_id * 5'))} || ' of ' || {phrase('item_id * 11 + 3')}
              ELSE {phrase('item_id')} || ' ' || text END AS query,
         least(20, greatest(1, item_id % 30)) AS lim,
         CASE WHEN item_id % 4 = 0 THEN NULL ELSE ['ns' || (item_id % 4), 'ns' || ((item_id + 1) % 4)] END AS namespaces,
         CASE WHEN item_id % 2 = 0 THEN 'u' || (item_id % 3) END AS user_id,
         CASE WHEN item_id % 5 = 0 THEN ['t0', 'lang0'] ELSE []::VARCHAR[] END AS tags,
         CASE WHEN item_id % 10 = 0 THEN 'any' ELSE 'all' END AS tag_mode,
         TIMESTAMP '2024-01-31' AS as_of FROM benchmark),
plan AS (SELECT *, least(200, greatest(20, lim * CASE WHEN len(tags) > 0 THEN 8 ELSE 4 END)) AS pool FROM req)
"""


def in_scope(ns: str, owner: str) -> str:
    return f"(p.namespaces IS NULL OR list_contains(p.namespaces, {ns})) AND (p.user_id IS NULL OR p.user_id = {owner})"


def ftok(text: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}]+')"


SQL["postings"] = model(
    f"""SELECT token, chunk_id, any_value(size) AS size, count(*) AS freq FROM (
      SELECT chunk_id, len(t)::BIGINT AS size, unnest(t) AS token FROM (
        SELECT conversation_id || ':' || turn AS chunk_id, list_concat({ftok(TITLE)}, {ftok('text')}) AS t FROM msgs))
    GROUP BY token, chunk_id"""
)

TERMS = f"""
qkept AS (SELECT query_id, list_filter({distinct('w')}, lambda t: t NOT IN ({STOPS})) AS k
          FROM (SELECT query_id, {words(norm('query'))} AS w FROM req)),
qtok AS (SELECT query_id, len(k) AS n, unnest(k) AS t, unnest(range(1, len(k) + 1)) AS i FROM qkept),
term0 AS (
  SELECT query_id, 0 AS i, 0 AS sub, 'phrase' AS kind, array_to_string(k, ' ') AS source, false AS prefix FROM qkept WHERE len(k) >= 2
  UNION ALL SELECT query_id, i, 0, 'term', t, false FROM qtok
  UNION ALL SELECT query_id, i, 1, 'stem', s, true FROM (SELECT *, {stem('t')} AS s FROM qtok) WHERE s <> t AND length(s) >= 4
  UNION ALL SELECT query_id, i, 2, 'last', t, true FROM qtok WHERE i = n AND length(t) >= 4),
term AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i, sub) - 1 AS term_no, kind,
                {ftok('source')} AS tokens, prefix FROM term0)
"""
SQL["query_terms"] = f"WITH {REQUESTS}, {TERMS} SELECT query_id, term_no, kind, array_to_string(tokens, ' ') AS tokens, prefix FROM term WHERE len(tokens) > 0"
SQL["search_plans"] = f"WITH {REQUESTS} SELECT query_id, lim AS limit, pool, array_to_string(tags, '|') AS tags, tag_mode FROM plan"

# ------------------------------------------------------------------ the searchable tables

STATE = """
evt AS (SELECT 'c' || user_id AS conversation_id, ts, event_id,
          CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'indexed' END AS status
        FROM events),
st AS (SELECT conversation_id, arg_max(status, (ts, event_id)) AS status,
          coalesce(max(ts) FILTER (WHERE status = 'queued'), min(ts)) AS queued_at
       FROM evt WHERE conversation_id IN (SELECT conversation_id FROM hdr) GROUP BY conversation_id)
"""
BUILT = ",\n".join(
    [
        model_ctes(DECORATED),
        UNITS.replace(MODEL, ""),
        STATE,
        """
idx AS (SELECT * FROM chunk WHERE conversation_id NOT IN (SELECT conversation_id FROM st WHERE status IN ('queued', 'processing')))
""",
        REQUESTS,
    ]
)


def occurrences(tokens: str) -> str:
    whole = f"{tokens}[i:i + len(wanted) - 1] = wanted"
    start = f"{tokens}[i:i + len(wanted) - 2] = wanted[1:len(wanted) - 1] AND starts_with({tokens}[i + len(wanted) - 1], wanted[len(wanted)])"
    return f"len(list_filter(range(1, len({tokens}) - len(wanted) + 2), lambda i: CASE WHEN prefix THEN {start} ELSE {whole} END))"


LEXICAL = f"""
doc AS (SELECT chunk_id, namespace, user_id, {ftok('title')} AS tt, {ftok('body')} AS bt FROM idx),
sized AS MATERIALIZED (SELECT *, len(tt) + len(bt) AS size, ' ' || array_to_string(tt, ' ') || ' ' AS tj, ' ' || array_to_string(bt, ' ') || ' ' AS bj FROM doc),
tot AS (SELECT count(*) AS n, sum(size) / count(*) AS mean FROM sized),
post AS MATERIALIZED (SELECT token, chunk_id, size, count(*) AS freq FROM (SELECT chunk_id, size, unnest(list_concat(tt, bt)) AS token FROM sized) GROUP BY ALL),
uterm AS (SELECT DISTINCT array_to_string(tokens, ' ') || CASE WHEN prefix THEN '*' ELSE '' END AS term, tokens AS wanted, prefix
          FROM term WHERE len(tokens) > 0),
expanded AS MATERIALIZED (SELECT u.term, v.token FROM (SELECT term, wanted[1] AS w FROM uterm WHERE len(wanted) = 1 AND prefix) u
   JOIN (SELECT DISTINCT token FROM post) v ON starts_with(v.token, u.w)),
multi AS MATERIALIZED (SELECT term, wanted, prefix, ' ' || array_to_string(wanted, ' ') AS needle FROM uterm WHERE len(wanted) > 1),
near AS MATERIALIZED (SELECT m.term, s.chunk_id FROM multi m JOIN (SELECT chunk_id, tj || '#' || bj AS both FROM sized) s ON contains(s.both, m.needle)),
hit AS MATERIALIZED (
  SELECT u.term, p.chunk_id, p.freq, p.size FROM uterm u JOIN post p ON p.token = u.wanted[1] WHERE len(u.wanted) = 1 AND NOT u.prefix
  UNION ALL
  SELECT e.term, p.chunk_id, sum(p.freq), p.size FROM expanded e JOIN post p USING (token) GROUP BY ALL
  UNION ALL
  SELECT term, chunk_id, freq, size FROM (
    SELECT n.term, n.chunk_id, s.size, {occurrences('s.tt')} + {occurrences('s.bt')} AS freq
    FROM near n JOIN multi USING (term) JOIN sized s ON s.chunk_id = n.chunk_id) WHERE freq > 0),
dfs AS (SELECT term, greatest(ln(((SELECT n FROM tot) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM hit GROUP BY term),
bm AS (
  SELECT t.query_id, h.chunk_id, sum(d.idf * (h.freq * 2.2) / (h.freq + 1.2 * (0.25 + 0.75 * h.size / (SELECT mean FROM tot)))) AS score
  FROM term t JOIN hit h ON h.term = array_to_string(t.tokens, ' ') || CASE WHEN t.prefix THEN '*' ELSE '' END
  JOIN dfs d ON d.term = h.term WHERE len(t.tokens) > 0 GROUP BY ALL),
lex AS (
  SELECT * FROM (SELECT b.query_id, b.chunk_id, b.score, p.pool,
           row_number() OVER (PARTITION BY b.query_id ORDER BY round(b.score, 9) DESC, b.chunk_id) AS lexical_rank
    FROM bm b JOIN plan p USING (query_id) JOIN sized s USING (chunk_id) WHERE {in_scope('s.namespace', 's.user_id')})
  WHERE lexical_rank <= pool)
"""
SQL["bm25_topk"] = (
    f"WITH RECURSIVE {BUILT}, {TERMS}, {LEXICAL} SELECT query_id, chunk_id, round(score, 6) AS score, lexical_rank, "
    "round(61.0::DOUBLE / (60 + lexical_rank), 6) AS rank_score FROM lex"
)

# ------------------------------------------------------------------ vectors

qwords = r"list_distinct(regexp_extract_all(lower(q), '[\p{L}\p{N}]+'))"
LABELS = ", ".join(
    f"({i}, {sql_text(name)}, {sql_text(label)})" for i, (name, _, label) in enumerate(fixed.CONCEPTS)
)
VARIANTS = f"""
label(ci, name, label) AS (VALUES {LABELS}),
vq AS (SELECT query_id, trim(query) AS q, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS w FROM req),
vc AS (SELECT DISTINCT query_id, q, w, c.ci FROM vq JOIN concept c ON list_has_all(w, string_split(c.phrase, ' '))),
vl AS (SELECT v.query_id, v.q, l.ci, l.label, sum(len(list_distinct(string_split(l.label, ' ')))) OVER (PARTITION BY v.query_id ORDER BY l.ci) AS used
       FROM vc v JOIN label l USING (ci) WHERE NOT list_has_all(v.w, string_split(l.label, ' '))),
variant AS (
  SELECT query_id, 0::BIGINT AS variant_no, q AS variant FROM vq
  UNION ALL
  SELECT query_id, 1, any_value(q) || ' ' || string_agg(label, ' ' ORDER BY ci) FROM vl WHERE used <= 24 GROUP BY query_id)
"""
SQL["query_variants"] = f"WITH {REQUESTS}, {CONCEPTS}, {VARIANTS} SELECT query_id, variant_no, variant FROM variant"
SQL["cosine_topk"] = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, 'l' || label AS ns, label, 'u' || (vec_id % 3) AS owner FROM embeddings),
s AS (SELECT 'v' || a.vec_id AS query_id, 'v' || b.vec_id AS chunk_id, round(list_cosine_similarity(a.v, b.v), 9) AS s
      FROM e a JOIN e b ON (b.ns = 'l0' OR b.ns = 'l' || (a.vec_id // 50 % 10)) AND (a.vec_id % 100 <> 0 OR b.owner = a.owner) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rn FROM s)
SELECT query_id, chunk_id, round(s, 6) AS score FROM r WHERE rn <= 50"""
SQL["cosine_probed_recall"] = """
SELECT sum(least(10, (SELECT count(*) FROM embeddings b WHERE a.vec_id % 200 <> 0 OR b.vec_id % 3 = a.vec_id % 3)))::BIGINT AS rows,
       true AS enough, true AS equal_scores FROM embeddings a WHERE a.vec_id % 50 = 0"""
SQL["vector_check"] = """
SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid,
       len(embedding[1:63]) = 64 AS short FROM embeddings"""
SEMANTIC = f"""
vecs AS (SELECT c.chunk_id, c.namespace, c.user_id, e.embedding::DOUBLE[] AS v FROM chunk c JOIN embeddings e ON c.conversation_id IN ('d' || e.vec_id, 'c' || e.vec_id)),
qvec AS (SELECT r.query_id, x.variant_no, e.embedding::DOUBLE[] AS v FROM variant x JOIN req r USING (query_id)
         JOIN embeddings e ON e.vec_id = r.item_id + x.variant_no * 100),
cosine AS (SELECT q.query_id, q.variant_no, c.chunk_id, round(list_cosine_similarity(q.v, c.v), 9) AS s, p.pool
        FROM qvec q JOIN plan p USING (query_id) JOIN vecs c ON {in_scope('c.namespace', 'c.user_id')}),
sem AS (SELECT query_id, chunk_id, max(s) AS raw FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY s DESC, chunk_id) AS rn FROM cosine)
        WHERE rn <= least(50, pool) GROUP BY ALL HAVING max(s) > 0)
"""
NORMALIZED = "CASE WHEN raw >= 0.3 THEN 0.5 + 0.5 * least(1.0, greatest(0.0, (raw - 0.3) / 0.65)) ELSE 0.0 END"
SQL["semantic_merge"] = (
    f"WITH RECURSIVE {BUILT}, {CONCEPTS}, {VARIANTS}, {SEMANTIC} SELECT query_id, chunk_id, round(raw, 6) AS raw, "
    f"round(({NORMALIZED})::DOUBLE, 6) AS score FROM sem"
)

# ------------------------------------------------------------------ recent channel

RECENT = f"""
cand AS (SELECT * FROM (
  SELECT p.query_id, s.conversation_id, s.status, s.queued_at,
         row_number() OVER (PARTITION BY p.query_id ORDER BY (s.status = 'failed')::INT, s.queued_at DESC, v.revision_id) AS place
  FROM plan p JOIN st s ON s.queued_at >= p.as_of - INTERVAL 86400 SECOND AND s.status IN ('queued', 'processing', 'failed')
  JOIN hdr h ON h.conversation_id = s.conversation_id JOIN rev v ON v.conversation_id = s.conversation_id
  WHERE {in_scope('h.namespace', 'h.user_id')}) WHERE place <= 8),
nact AS (SELECT conversation_id, count(*) AS n FROM active GROUP BY ALL)
"""


def budget(messages: int) -> str:
    return f"""
bud AS (SELECT *, n - take AS first_sequence FROM (
  SELECT c.*, n, greatest(0, least(n, {messages} - coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY place
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS take FROM cand c JOIN nact USING (conversation_id)))"""


SQL["recent_candidates"] = (
    f"WITH RECURSIVE {BUILT}, {RECENT} SELECT query_id, conversation_id, status, "
    "strftime(date_trunc('millisecond', queued_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS queued_at, place FROM cand"
)
SQL["recent_budget"] = (
    f"WITH RECURSIVE {BUILT}, {RECENT}, {budget(200)} SELECT query_id, conversation_id, n AS active_messages, take, first_sequence FROM bud"
)
SQL["recent_status"] = (
    f"WITH RECURSIVE {BUILT}, {RECENT} SELECT query_id, count_if(status = 'queued')::BIGINT AS queued, "
    "count_if(status = 'processing')::BIGINT AS processing, count_if(status = 'failed')::BIGINT AS failed, 0::BIGINT AS load_failed "
    "FROM cand GROUP BY query_id"
)


def alias_list(stem_text: str) -> str:
    return f"coalesce((SELECT list(ci || ':' || phrase) FROM cstem WHERE contains(' ' || {stem_text} || ' ', ' ' || phrase || ' ')), []::VARCHAR[])"


def concept_ids(alias: str) -> str:
    return f"list_distinct(list_transform({alias}, lambda a: string_split(a, ':')[1]))"


def alias_matches(q: str, t: str) -> str:
    shared = f"list_transform(list_intersect({q}, {t}), lambda a: string_split(a, ':')[1])"
    return f"len(list_filter({concept_ids(q)}, lambda c: list_contains({concept_ids(t)}, c) AND NOT list_contains({shared}, c)))"


def grams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: {tokens}[i:i + {n - 1}])"


def gram_texts(tokens: str, n: int, skip_stop: bool) -> str:
    runs = grams(tokens, n)
    if skip_stop:
        runs = f"list_filter({runs}, lambda g: NOT list_has_any(g, [{STOPS}]))"
    return f"list_transform({runs}, lambda g: array_to_string(g, ' '))"


def any_in(text: str, items: str, pad: str = "") -> str:
    item = f"'{pad}' || x || '{pad}'"
    return f"len(list_filter({items}, lambda x: contains({text}, {item}))) > 0"


def labels(text: str) -> str:
    kinds = "|".join(fixed.STRUCTURED_LABEL_KINDS)
    padded = f"replace(' ' || {norm(f"regexp_replace({text}, '{SEP}', ' ', 'g')")} || ' ', ' ', '  ')"
    found = f"regexp_extract_all({padded}, ' (?:{kinds})  [0-9]+ ')"
    return f"list_distinct(list_transform({found}, lambda l: replace(trim(l), '  ', ' ')))"


def heading_norm(normed: str) -> str:
    return f"trim(regexp_replace(regexp_replace({normed}, '{SEP}', ' ', 'g'), ' +', ' ', 'g'))"


def entity_list(raw: str) -> str:
    letters = rf"length(regexp_replace({raw}, '[^\p{{L}}]', '', 'g'))"
    uppers = rf"length(regexp_replace({raw}, '[^\p{{Lu}}]', '', 'g'))"
    found = f"flatten(list_transform(regexp_extract_all({raw}, '{NAME}'), lambda n: {stems(words(norm('n')))}))"
    return f"CASE WHEN {letters} = 0 OR {letters} = {uppers} THEN []::VARCHAR[] ELSE list_filter({found}, lambda t: length(t) >= 2 AND t NOT IN ({STOPS})) END"


QSIG = f"""
qs1 AS (SELECT query_id, query, {norm('query')} AS q_norm FROM req),
qs2 AS (SELECT *, {words('q_norm')} AS q_words FROM qs1),
qs3 AS (SELECT *, {stems('q_words')} AS q_stems, q_words[1:12] AS q_first FROM qs2),
qs4 AS (SELECT *, {distinct('q_stems')} AS q_ds FROM qs3),
qs5 AS (SELECT *, {meaningful('q_ds')} AS q_tokens, {alias_list("array_to_string(q_stems, ' ')")} AS q_alias FROM qs4),
qs AS MATERIALIZED (SELECT query_id, q_norm, q_tokens, q_alias, q_tokens[1:12] AS q_top, {entity_list('query')} AS q_entities, {labels('q_norm')} AS q_labels,
        {heading_norm('q_norm')} AS q_heading,
        list_transform(regexp_extract_all(query, '{NAME}(?:\\s+{NAME})+'), lambda n: array_to_string({words(norm('n'))}, ' ')) AS q_names,
        list_filter(q_tokens[1:12], lambda t: NOT regexp_full_match(t, '[0-9]+')) AS q_rare,
        list_filter(q_tokens[1:12], lambda t: regexp_matches(t, '[._:@/\\\\-]|[0-9]')) AS q_ident,
        coalesce((SELECT list(phrase) FROM cstem WHERE list_contains({concept_ids('q_alias')}, ci::VARCHAR)), []::VARCHAR[]) AS q_concepts,
        {gram_texts('q_first', 4, True)} AS g4, {gram_texts('q_first', 3, True)} AS g3, {gram_texts('q_first', 2, True)} AS g2,
        {gram_texts('q_tokens', 4, False)} AS r4, {gram_texts('q_tokens', 3, False)} AS r3, {gram_texts('q_tokens', 2, False)} AS r2
       FROM qs5)
"""
TOKENS_JOINED = "' ' || array_to_string(t_tokens, ' ') || ' '"
RECENT_SCORES = f"""
elig AS (
  SELECT b.query_id, b.conversation_id, b.queued_at, c.chunk_id, c.ordinal, c.title, p.node_id, min(p.idx) AS idx
  FROM bud b JOIN chunk c ON c.conversation_id = b.conversation_id AND c.branch_key = 'active'
  JOIN grouped g ON g.conversation_id = c.conversation_id AND g.branch_key = 'active' AND g.g = c.ordinal
  JOIN placed p ON p.conversation_id = g.conversation_id AND p.branch_key = 'active' AND p.idx = g.idx
  WHERE b.take > 0 AND p.sequence >= b.first_sequence GROUP BY ALL),
etext AS (
  SELECT query_id, chunk_id, queued_at, ordinal, title || {NL} || string_agg(text, {NL} ORDER BY idx) AS text FROM (
    SELECT e.query_id, e.chunk_id, e.queued_at, e.ordinal, e.title, n.text, min(e.idx) AS idx
    FROM elig e JOIN nodes n ON n.conversation_id = e.conversation_id AND n.node_id = e.node_id GROUP BY ALL)
  GROUP BY query_id, chunk_id, queued_at, ordinal, title),
et1 AS (SELECT *, {norm('text')} AS t_norm FROM etext),
et2 AS (SELECT *, {stems(words('t_norm'))} AS t_stems FROM et1),
et3 AS (SELECT *, {distinct('t_stems')} AS t_ds FROM et2),
et4 AS MATERIALIZED (SELECT query_id, chunk_id, queued_at, ordinal, t_norm, {meaningful('t_ds')} AS t_tokens, {alias_list("array_to_string(t_stems, ' ')")} AS t_alias FROM et3),
et5 AS (SELECT e.*, q.*  EXCLUDE (query_id), contains(t_norm, q_norm) AS exact, len(list_intersect(q_tokens, t_tokens)) AS hits,
          {alias_matches('q_alias', 't_alias')} AS am, len({concept_ids('q_alias')}) AS nc,
          CASE WHEN {any_in(TOKENS_JOINED, 'r4', ' ')} THEN 4 WHEN {any_in(TOKENS_JOINED, 'r3', ' ')} THEN 3
               WHEN {any_in(TOKENS_JOINED, 'r2', ' ')} THEN 2 ELSE 0 END AS longest FROM et4 e JOIN qs q USING (query_id)),
rsc AS (SELECT query_id, chunk_id, queued_at, ordinal, CASE WHEN exact THEN 1.0::DOUBLE ELSE
          least(1.0::DOUBLE, hits::DOUBLE / len(q_tokens) * 0.55 + CASE WHEN nc > 0 THEN am::DOUBLE / nc ELSE 0 END * 0.3 + least(1.0::DOUBLE, longest / 3.0::DOUBLE) * 0.15) END AS s
        FROM et5 WHERE exact OR hits >= least(2, len(q_tokens)) OR am > 0),
rec AS (SELECT * FROM (SELECT r.query_id, r.chunk_id, r.s AS recent_score, p.pool,
          row_number() OVER (PARTITION BY r.query_id ORDER BY round(r.s, 9) DESC, r.queued_at DESC, r.ordinal DESC, r.chunk_id) AS rn
        FROM rsc r JOIN plan p USING (query_id)) WHERE rn <= pool)
"""
SQL["recent_scores"] = (
    f"WITH RECURSIVE {BUILT}, {CONCEPTS}, {RECENT}, {budget(200)}, {QSIG}, {RECENT_SCORES} "
    "SELECT query_id, chunk_id, round(recent_score, 6) AS score, rn AS rank FROM rec"
)

# ------------------------------------------------------------------ fusion

CHANNELS = ",\n".join([BUILT, TERMS, LEXICAL, CONCEPTS, VARIANTS, SEMANTIC, RECENT, budget(200), QSIG, RECENT_SCORES])
UNION = """
uni AS MATERIALIZED (SELECT query_id, chunk_id, max(lexical_rank) AS lexical_rank, max(raw) AS raw, max(recent_score) AS recent_score FROM (
  SELECT query_id, chunk_id, lexical_rank, NULL::DOUBLE AS raw, NULL::DOUBLE AS recent_score FROM lex
  UNION ALL SELECT query_id, chunk_id, NULL, raw, NULL FROM sem
  UNION ALL SELECT query_id, chunk_id, NULL, NULL, recent_score FROM rec) GROUP BY ALL)
"""
SQL["candidate_union"] = (
    f"WITH RECURSIVE {CHANNELS}, {UNION} SELECT query_id, chunk_id, coalesce(lexical_rank, -1) AS lexical_rank, "
    "round(coalesce(raw, -1), 6) AS semantic_raw, round(coalesce(recent_score, -1), 6) AS recent_score FROM uni"
)


def tokens_layers(name: str, source: str, columns: list[str]) -> str:
    """Layers adding ``<c>_m`` (meaningful tokens) for each normalised column ``c``."""
    one = ", ".join(f"{stems(words(c))} AS {c}_s" for c in columns)
    two = ", ".join(f"list_distinct({c}_s) AS {c}_d" for c in columns)
    three = ", ".join(f"{meaningful(f'{c}_d')} AS {c}_m" for c in columns)
    return f"""
{name}1 AS (SELECT *, {one} FROM {source}),
{name}2 AS (SELECT *, {two} FROM {name}1),
{name} AS MATERIALIZED (SELECT *, {three} FROM {name}2)"""


SIGNALS = f"""
pool_chunk AS (SELECT * FROM idx UNION ALL SELECT * FROM chunk WHERE chunk_id NOT IN (SELECT chunk_id FROM idx)
   AND conversation_id IN (SELECT conversation_id FROM st WHERE status IN ('queued', 'processing', 'failed'))),
txt0 AS (SELECT chunk_id, conversation_id, revision_id, namespace, user_id, updated_at, title, body, title || {NL} || body AS text
         FROM pool_chunk WHERE chunk_id IN (SELECT chunk_id FROM uni)),
txt1 AS (SELECT *, {norm('text')} AS n_text, {norm('title')} AS n_title, {norm('body')} AS n_body,
    list_concat([title], list_transform(list_filter(list_transform(string_split(body, {NL}), lambda s: trim(s, ' ' || chr(9) || chr(13))),
       lambda s: length(s) > 2 AND prefix(s, '[') AND suffix(s, ']')), lambda s: substring(s, 2, length(s) - 2))[1:2]) AS heads FROM txt0),
txt2 AS (SELECT *, {norm('heads[1]')} AS n_h1, {norm("coalesce(heads[2], '')")} AS n_h2, {norm("coalesce(heads[3], '')")} AS n_h3 FROM txt1),
{tokens_layers('txt3', 'txt2', ['n_text', 'n_title', 'n_body', 'n_h1', 'n_h2', 'n_h3'])},
txt AS MATERIALIZED (SELECT *, {alias_list("array_to_string(n_text_s, ' ')")} AS t_alias, {words('n_text')} AS t_words,
    array_to_string({words('n_text')}, ' ') AS t_join, array_to_string({words('n_title')}, ' ') AS t_title_join,
    list_concat(n_title_m, n_body_m) AS t_full, list_concat(n_h1_m, n_h2_m, n_h3_m) AS t_head_tokens,
    list_distinct(list_concat({labels('n_h1')}, {labels('n_h2')}, {labels('n_h3')})) AS t_head_labels, {labels('n_body')} AS t_body_labels,
    list_transform(regexp_extract_all(text, '(\\p{{L}}[\\p{{L}} -]{{0,30}})\\s*:', 1), lambda l: ' ' || array_to_string({stems(words(norm('l')))}, ' ') || ' ') AS t_fields
    FROM txt3)
"""


def longest(text: str) -> str:
    return f"(CASE WHEN {any_in(text, 'g4')} THEN 4 WHEN {any_in(text, 'g3')} THEN 3 WHEN {any_in(text, 'g2')} THEN 2 ELSE 0 END)"


HEAD_JOINS = [f"array_to_string({words(c)}, ' ')" for c in ("n_h1", "n_h2", "n_h3")]
PAIRS = f"""
pr AS MATERIALIZED (
  SELECT u.query_id, u.chunk_id, u.lexical_rank, u.raw, u.recent_score, t.conversation_id, t.revision_id, t.updated_at, t.namespace, t.title, t.body,
         q_rare, q_top, q_entities, p.tags AS req_tags, p.tag_mode, p.as_of, p.lim,
         contains(n_text, q_norm) AS has_query, {any_in('t_join', 'q_names')} AS has_name, {longest('t_join')} AS phrase_len,
         list_has_any(q_ident, t_words) AS has_ident, len(list_intersect(q_tokens, n_text_m))::DOUBLE / greatest(1, len(q_tokens)) AS overlap,
         {alias_matches('q_alias', 't_alias')} AS am, len({concept_ids('q_alias')}) AS nc,
         len(list_intersect({concept_ids('q_alias')}, {concept_ids('t_alias')})) AS covered,
         ({any_in('t_title_join', 'q_names')}) OR len(list_filter(t_fields, lambda f: len(list_filter(q_concepts, lambda c: contains(f, ' ' || c || ' '))) > 0)) > 0 AS has_field,
         least(0.6::DOUBLE, len(list_intersect(q_labels, t_head_labels)) * 0.3::DOUBLE
            + len(list_filter(list_intersect(q_labels, t_body_labels), lambda l: NOT list_contains(t_head_labels, l))) * 0.1::DOUBLE) AS label_boost,
         contains({heading_norm('n_h1')}, q_heading) OR (len(heads) > 1 AND contains({heading_norm('n_h2')}, q_heading))
            OR (len(heads) > 2 AND contains({heading_norm('n_h3')}, q_heading)) AS head_exact,
         greatest({longest(HEAD_JOINS[0])}, {longest(HEAD_JOINS[1])}, {longest(HEAD_JOINS[2])}) AS head_len,
         list_transform(q_rare, lambda r: list_contains(t_full, r)) AS hit, list_transform(q_rare, lambda r: list_contains(t_head_tokens, r)) AS hhit,
         contains(lower(t.body), q_norm) AS body_exact
  FROM uni u JOIN txt t USING (chunk_id) JOIN qs USING (query_id) JOIN plan p USING (query_id)
  WHERE {in_scope('t.namespace', 't.user_id')}),
rarity AS (SELECT query_id, i, any_value(tok) AS tok, any_value(ent) AS ent, log2((count(*) + 0.5::DOUBLE) / (count_if(h) + 0.5::DOUBLE)) AS w
  FROM (SELECT query_id, unnest(q_rare) AS tok, unnest(list_transform(q_rare, lambda r: list_contains(q_entities, r))) AS ent,
               unnest(range(1, len(q_rare) + 1)) AS i, unnest(hit) AS h FROM pr) GROUP BY query_id, i),
qweight AS (SELECT query_id, sum(w) AS tw, coalesce(sum(w) FILTER (WHERE NOT ent), 0) AS cw FROM rarity GROUP BY query_id),
pairw AS (SELECT p.query_id, p.chunk_id, coalesce(sum(w) FILTER (WHERE p.hit[i] AND w > 0), 0) AS sw, count_if(p.hit[i] AND w > 0) AS sn,
             coalesce(sum(w) FILTER (WHERE p.hit[i] AND w > 0 AND NOT ent), 0) AS scw, count_if(p.hit[i] AND w > 0 AND ent) AS sen,
             coalesce(sum(w) FILTER (WHERE p.hhit[i]), 0) AS hw FROM pr p JOIN rarity r USING (query_id) GROUP BY ALL),
tagged AS (SELECT conversation_id, ['t' || (num % 5), 'lang' || (num % 2)] AS ctags FROM hdr),
comp1 AS (SELECT p.*, ctags, coalesce(tw, 0) AS tw, coalesce(cw, 0) AS cw, coalesce(sw, 0) AS sw, coalesce(sn, 0) AS sn, coalesce(scw, 0) AS scw,
     coalesce(sen, 0) AS sen, coalesce(hw, 0) AS hw,
     coalesce(61.0::DOUBLE / (60 + lexical_rank), 0) AS lexical_score,
     coalesce(({NORMALIZED})::DOUBLE, 0) AS semantic_score,
     least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(recent_score, 0))) AS recent_canonical_score,
     (lexical_rank IS NOT NULL)::INT + (coalesce(raw, 0) >= 0.3)::INT + (recent_score IS NOT NULL)::INT AS ns,
     array_to_string(list_filter([CASE WHEN lexical_rank IS NOT NULL THEN 'lexical' END, CASE WHEN coalesce(raw, 0) >= 0.3 THEN 'semantic' END,
        CASE WHEN recent_score IS NOT NULL THEN 'recent_canonical' END], lambda x: x IS NOT NULL), '+') AS sources
   FROM pr p LEFT JOIN qweight USING (query_id) LEFT JOIN pairw USING (query_id, chunk_id) JOIN tagged USING (conversation_id)),
comp2 AS (SELECT *, greatest(lexical_score, semantic_score, recent_canonical_score) AS source_confidence,
     least(0.1::DOUBLE, (ns - 1) * 0.05::DOUBLE) AS source_agreement_boost,
     CASE WHEN has_query OR has_name THEN 1.0::DOUBLE WHEN phrase_len >= 3 THEN 0.8 WHEN phrase_len = 2 THEN 0.65 WHEN has_ident THEN 0.4 ELSE 0 END AS exact_match_boost,
     CASE WHEN has_name THEN 0.35::DOUBLE ELSE 0 END AS entity_match_boost, overlap * 0.45::DOUBLE AS token_overlap_boost,
     CASE WHEN nc > 0 THEN am::DOUBLE / nc ELSE 0 END * 0.15::DOUBLE AS alias_overlap_boost, CASE WHEN has_field THEN 0.15::DOUBLE ELSE 0 END AS field_match_boost,
     0.1::DOUBLE * exp(-greatest(0, (epoch_ms(as_of) - epoch_ms(updated_at)) / 86400000.0::DOUBLE) / 365.0::DOUBLE) AS recency_boost,
     least(0.25::DOUBLE, 0.1::DOUBLE * len(list_filter(ctags, lambda t: list_contains(req_tags, t) OR list_contains(q_top, t)))) AS tag_match_boost,
     CASE WHEN head_exact THEN 0.6::DOUBLE ELSE least(0.9::DOUBLE, CASE head_len WHEN 4 THEN 0.6::DOUBLE WHEN 3 THEN 0.5 WHEN 2 THEN 0.35 ELSE 0 END
        + CASE WHEN tw > 0 THEN hw / tw ELSE 0 END * 0.4::DOUBLE) END AS heading_match_boost,
     label_boost AS structured_label_boost, CASE WHEN tw > 0 THEN sw / tw ELSE 0 END * 0.5::DOUBLE AS specificity_boost,
     least(0.25::DOUBLE, greatest(0, sn - 1) * 0.05::DOUBLE) AS co_occurrence_boost
   FROM comp1 WHERE ns > 0),
comp3 AS (SELECT *, least(1.0::DOUBLE, least(1.0::DOUBLE, exact_match_boost + heading_match_boost + structured_label_boost)
      + CASE WHEN cw > 0 THEN scw / cw ELSE 0 END + least(0.25::DOUBLE, sen * 0.05::DOUBLE)) AS lexical_evidence FROM comp2),
comp4 AS (SELECT *, semantic_score * (1 - lexical_evidence) * CASE WHEN nc > 0 THEN covered::DOUBLE / nc ELSE 1 END AS semantic_lift FROM comp3),
comp AS MATERIALIZED (SELECT *, source_confidence + source_agreement_boost + exact_match_boost + heading_match_boost + structured_label_boost + alias_overlap_boost
     + field_match_boost + co_occurrence_boost + recency_boost + tag_match_boost + semantic_lift
     + (entity_match_boost + token_overlap_boost + specificity_boost) * lexical_evidence AS final_score FROM comp4)
"""
from threadloom.operators.ranking import COMPONENTS  # noqa: E402

RANKED = ",\n".join([CHANNELS, UNION, SIGNALS, PAIRS])
SQL["rank_components"] = (
    f"WITH RECURSIVE {RANKED} SELECT query_id, chunk_id, sources, "
    + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in COMPONENTS)
    + " FROM comp"
)

SQL["candidate_idf"] = f"""WITH RECURSIVE {BUILT}, {TERMS}, {LEXICAL}, {CONCEPTS}, {QSIG},
lt0 AS (SELECT chunk_id, {norm('title')} AS n_title, {norm('body')} AS n_body FROM idx WHERE chunk_id IN (SELECT chunk_id FROM lex)),
{tokens_layers('lt', 'lt0', ['n_title', 'n_body'])},
x AS (SELECT query_id, unnest(q_rare) AS token, unnest(list_transform(q_rare, lambda r: list_contains(n_title_m, r) OR list_contains(n_body_m, r))) AS h
      FROM lex JOIN lt USING (chunk_id) JOIN qs USING (query_id))
SELECT query_id, token, round(log2((count(*) + 0.5::DOUBLE) / (count_if(h) + 0.5::DOUBLE)), 6) AS weight FROM x GROUP BY ALL"""

PAGE = """
open0 AS (SELECT *, round(final_score, 9) AS s9, final_score >= 0.25 OR body_exact AS kept FROM comp
   WHERE len(req_tags) = 0 OR CASE WHEN tag_mode = 'any' THEN list_has_any(req_tags, ctags) ELSE list_has_all(ctags, req_tags) END),
open1 AS (SELECT *, kept AND row_number() OVER (PARTITION BY query_id, conversation_id, kept ORDER BY s9 DESC, chunk_id) <= 5 AS ok FROM open0),
open2 AS (SELECT *, ok AND row_number() OVER (PARTITION BY query_id, ok ORDER BY s9 DESC, chunk_id) <= lim AS on_page FROM open1)
"""
SQL["page_cap"] = (
    f"WITH RECURSIVE {RANKED}, {PAGE} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s9 DESC, chunk_id) AS position "
    "FROM open2 WHERE on_page"
)
HEADROOM = """
best AS (SELECT query_id, arg_min(chunk_id, (-raw, chunk_id)) AS chunk_id, max(raw) AS raw FROM sem GROUP BY query_id HAVING max(raw) >= 0.5),
shown0 AS (SELECT o.*, NOT on_page AS headroom, count(*) OVER (PARTITION BY o.query_id) AS n, bool_or(NOT on_page) OVER (PARTITION BY o.query_id) AS added
   FROM open2 o LEFT JOIN best b ON b.query_id = o.query_id AND b.chunk_id = o.chunk_id WHERE on_page OR b.chunk_id IS NOT NULL),
shown1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN added THEN round(final_score, 6) ELSE s9 END DESC, chunk_id) AS place FROM shown0),
shown2 AS (SELECT *, bool_or(headroom AND place = n) OVER (PARTITION BY query_id) AS last_is_best FROM shown1),
shown AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position FROM shown2
   WHERE n <= lim OR place <> CASE WHEN last_is_best THEN n - 1 ELSE n END)
"""
SQL["headroom"] = f"WITH RECURSIVE {RANKED}, {PAGE}, {HEADROOM} SELECT query_id, chunk_id, position, headroom FROM shown"
SQL["hybrid_search"] = f"""WITH RECURSIVE {RANKED}, {PAGE}, {HEADROOM}
SELECT query_id, position, conversation_id, revision_id, chunk_id, title,
  sha256(CASE WHEN length(body) > 500 THEN substring(body, 1, 497) || '...' ELSE body END) AS snippet_sha,
  strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, namespace, array_to_string(ctags, '|') AS tags, round(final_score, 6) AS score, sources FROM shown"""
SQL["search_summary"] = f"""WITH RECURSIVE {RANKED}, {PAGE}, {HEADROOM},
a AS (SELECT query_id, count(*) AS n FROM shown GROUP BY ALL), b AS (SELECT query_id, count(*) AS n FROM rec GROUP BY ALL),
c AS (SELECT query_id, count_if(status = 'queued') AS q, count_if(status = 'processing') AS p, count_if(status = 'failed') AS f FROM cand GROUP BY ALL)
SELECT coalesce(a.query_id, b.query_id, c.query_id) AS query_id, coalesce(a.n, 0)::BIGINT AS merged_result_count, coalesce(b.n, 0)::BIGINT AS recent_match_count,
  coalesce(q, 0)::BIGINT AS queued, coalesce(p, 0)::BIGINT AS processing, coalesce(f, 0)::BIGINT AS failed, 0::BIGINT AS load_failed
FROM a FULL JOIN b ON a.query_id = b.query_id FULL JOIN c ON c.query_id = coalesce(a.query_id, b.query_id)"""

SQL["recency_boost"] = model("""
SELECT conversation_id, round(0.1::DOUBLE * exp(-greatest(0, (epoch_ms(TIMESTAMP '2024-08-01 12:00:00') - epoch_ms(updated_at)) / 86400000.0::DOUBLE) / 365.0::DOUBLE), 6) AS boost FROM hdr""")
SQL["tag_boost"] = model("""
SELECT conversation_id, round(0.1::DOUBLE * ((num % 5 IN (1, 2, 3))::INT + 1), 6) AS boost FROM hdr""")
SQL["tag_filter_any"] = model("SELECT conversation_id FROM hdr WHERE num % 5 = 1 OR num % 2 = 0")
SQL["tag_filter_all"] = model("SELECT conversation_id FROM hdr WHERE num % 5 = 1 AND num % 2 = 0")
