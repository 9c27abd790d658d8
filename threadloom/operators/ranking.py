"""Fusion: candidate union, explainable score components, ordering and the result page.

Signals are computed once per query and once per distinct candidate chunk; the pairs only carry small
flags and counts from there on.  A query has at most a few hundred candidates (the channel bounds), so
every window over ``query_id`` is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, text as tx
from ..session import durable
from .lexical import in_scope, rank_score
from .semantic import normalized_score

# bounds for what may be sent to every task, and for the work of one task
BROADCAST_BYTES = 64 * 1024 * 1024
CANDIDATES_PER_QUERY = 2 * fixed.POOL_MAX + fixed.MAX_VARIANTS * fixed.SEMANTIC_TOP_K
CANDIDATE_BYTES = 256
QUERY_BYTES = 8192
SIGNAL_FACTOR = 40
ROWS_PER_TASK = 256
#: Queries that a row of a chunk names at most.
QUERIES_PER_ROW = 4096

COMPONENTS = [
    "lexical_score",
    "semantic_score",
    "recent_canonical_score",
    "source_confidence",
    "source_agreement_boost",
    "exact_match_boost",
    "entity_match_boost",
    "token_overlap_boost",
    "alias_overlap_boost",
    "field_match_boost",
    "recency_boost",
    "tag_match_boost",
    "heading_match_boost",
    "structured_label_boost",
    "specificity_boost",
    "co_occurrence_boost",
    "lexical_evidence",
    "semantic_lift",
    "final_score",
]


# --------------------------------------------------------------------------- plan and candidates


def search_plan(queries: DataFrame) -> DataFrame:
    """Clamp limits, normalise tags, size the candidate pool; queries without any token are dropped."""
    tags = F.coalesce(tx.normalize_tags(F.col("tags")), F.array().cast("array<string>"))
    rows = queries.withColumn("_n", tx.normalize_text(F.col("query")))
    rows = rows.filter(F.rlike("_n", F.lit(r"[\p{L}\p{N}]"))).drop("_n")
    rows = rows.withColumn("tags", tags).withColumn(
        "limit", F.least(F.lit(fixed.LIMIT_MAX), F.greatest(F.lit(1), F.col("limit")))
    )
    wide = F.col("limit") * F.when(F.size("tags") > 0, 8).otherwise(4)
    return rows.withColumns(
        {
            "pool": F.least(F.lit(fixed.POOL_MAX), F.greatest(F.lit(fixed.POOL_MIN), wide)),
            "tag_mode": F.when(F.col("tag_mode") == "any", "any").otherwise("all"),
        }
    )


def unite(lexical: DataFrame | None, semantic: DataFrame | None, recent: DataFrame | None) -> DataFrame:
    """One row per query and chunk: ``lexical_rank``, ``semantic_raw``, ``recent_score`` (null = not found)."""
    parts = [
        channel.select("query_id", "chunk_id", column)
        for channel, column in ((lexical, "lexical_rank"), (semantic, "semantic_raw"), (recent, "recent_score"))
        if channel is not None
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for column, kind in (("lexical_rank", "int"), ("semantic_raw", "double"), ("recent_score", "double")):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))
    return rows.groupBy("query_id", "chunk_id").agg(
        F.max("lexical_rank").alias("lexical_rank"),
        F.max("semantic_raw").alias("semantic_raw"),
        F.max("recent_score").alias("recent_score"),
    )


# --------------------------------------------------------------------------- signals


def _nfkc_items(items: Column) -> Column:
    """NFKC of each string of an array whose strings hold no line break."""
    return F.when(F.size(items) > 0, F.split(tx.nfkc(F.array_join(items, "\n")), "\n")).otherwise(items)


def query_signals(queries: DataFrame) -> DataFrame:
    """Everything the ranking needs from a query, prefixed ``q_``."""
    rows = tx.with_signals(queries.select("query_id", "query"), "q", F.col("query"))
    rows = rows.withColumns(
        {
            "_names": _nfkc_items(tx.named_phrases(F.regexp_replace("query", r"[\r\n]+", " "))),
            "_first": F.slice("q_words", 1, fixed.QUERY_TOKEN_LIMIT),
            "q_top": F.slice("q_tokens", 1, fixed.QUERY_TOKEN_LIMIT),
            "q_entities": tx.entity_tokens(tx.nfkc(F.col("query"))),
            "q_labels": tx.structured_labels(F.col("q_norm")),
            "q_heading": tx.heading_normalized(F.col("q_norm")),
            "q_concepts": F.flatten(
                F.map_values(
                    F.map_filter(tx.concept_phrase_map(), lambda c, _: F.map_contains_key(F.col("q_aliases"), c))
                )
            ),
        }
    )
    return rows.select(
        "query_id",
        "q_norm",
        "q_tokens",
        "q_aliases",
        "q_top",
        "q_entities",
        "q_labels",
        "q_heading",
        "q_concepts",
        F.transform("_names", lambda n: F.array_join(tx.words(tx.squash(n)), " ")).alias("q_names"),
        F.filter("q_top", lambda t: ~F.rlike(t, F.lit("^[0-9]+$"))).alias("q_rare"),
        F.filter("q_top", lambda t: F.rlike(t, F.lit(r"[._:@/\\-]|[0-9]"))).alias("q_identifiers"),
        *[tx.gram_phrases(F.col("_first"), n, True).alias(f"q_grams{n}") for n in (4, 3, 2)],
        *[tx.gram_phrases(F.col("q_tokens"), n, False).alias(f"q_runs{n}") for n in (4, 3, 2)],
    )


def chunk_signals(rows: DataFrame) -> DataFrame:
    """Everything the ranking needs from ``rows(chunk_id, title, body, ...)``, prefixed ``t_``.

    The body is dropped; all other columns stay.
    """
    carried = [c for c in rows.columns if c != "body"]
    base = rows.withColumn("_text", F.concat("title", F.lit("\n"), "body"))
    base = tx.with_signals(base, "t", F.col("_text"))
    base = base.withColumns(
        {
            "_title": tx.normalize_text(F.col("title")),
            "_heads": F.transform(
                _nfkc_items(tx.heading_texts(F.regexp_replace("title", r"[\r\n]+", " "), F.col("body"))), tx.squash
            ),
            "_labels": F.transform(_nfkc_items(tx.field_labels(F.col("_text"))), tx.squash),
            "t_join": F.array_join("t_words", " "),
        }
    )
    # title and body are separate stretches of the analysed text, so theirs are parts of its tokens
    base = base.withColumns(
        {
            "_head_words": F.transform("_heads", tx.words),
            "_n": F.size(tx.words(F.col("_title"))),
            "_body": F.when(F.col("_title") == "", F.col("t_norm")).otherwise(
                F.substring(F.col("t_norm"), F.length("_title") + 2, F.length("t_norm"))
            ),
        }
    )
    first = lambda c: F.slice(c, F.lit(1), F.col("_n"))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.size(c))
    return base.select(
        *carried,
        "t_norm",
        "t_words",
        "t_join",
        "t_tokens",
        "t_aliases",
        F.lower("body").alias("t_lower"),
        F.array_join(first("t_words"), " ").alias("t_title_join"),
        F.array_union(tx.meaningful(first("t_stems")), tx.meaningful(rest("t_stems"))).alias("t_full"),
        F.transform("_heads", tx.heading_normalized).alias("t_head_norms"),
        F.transform("_head_words", lambda w: F.array_join(w, " ")).alias("t_head_joins"),
        F.array_distinct(F.flatten(F.transform("_head_words", lambda w: tx.meaningful(tx.stems(w))))).alias("t_head_tokens"),
        F.array_distinct(F.flatten(F.transform("_heads", tx.structured_labels))).alias("t_head_labels"),
        tx.structured_labels(F.col("_body")).alias("t_body_labels"),
        F.transform(
            "_labels", lambda s: F.concat(F.lit(" "), F.array_join(tx.stems(tx.words(s)), " "), F.lit(" "))
        ).alias("t_fields"),
    )


def _named(text: Column) -> Column:
    return F.exists("q_names", lambda n: F.contains(text, n))


def _grams(text: Column) -> Column:
    return tx.longest_contained(text, {n: F.col(f"q_grams{n}") for n in (4, 3, 2)})


# --------------------------------------------------------------------------- components


def recency_boost(timestamp: Column, as_of: Column) -> Column:
    days = (F.unix_millis(as_of) - F.unix_millis(timestamp)) / F.lit(86_400_000.0)
    boost = fixed.RECENCY_RATE * F.exp(-F.greatest(F.lit(0.0), days) / fixed.RECENCY_DAYS)
    return F.coalesce(boost, F.lit(0.0))


def tag_boost(tags: Column, tag_tokens: Column, requested: Column, query_top: Column) -> Column:
    """``tag_tokens`` holds the meaningful tokens of each tag, in the order of ``tags``."""
    matched = F.filter(
        F.arrays_zip(tags.alias("tag"), tag_tokens.alias("tokens")),
        lambda z: F.array_contains(requested, z["tag"]) | F.arrays_overlap(z["tokens"], query_top),
    )
    return F.least(F.lit(fixed.TAG_MAX), F.size(matched) * fixed.TAG_RATE)


def tags_by_conversation(tags: DataFrame) -> DataFrame:
    """``(conversation_id, tags, tag_tokens)`` from ``tags(conversation_id, tag, seq)``, in insertion order."""
    rows = tags.withColumn("_n", tx.normalize_text(F.col("tag")))
    rows = rows.select("conversation_id", "seq", "tag", tx.meaningful_of(F.col("_n")).alias("_t"))
    listed = rows.groupBy("conversation_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "tag", "_t"))).alias("_l")
    )
    return listed.select(
        "conversation_id",
        F.col("_l.tag").alias("tags"),
        F.transform("_l", lambda t: F.slice(t["_t"], 1, fixed.QUERY_TOKEN_LIMIT)).alias("tag_tokens"),
    )


def _pair_facts(pairs: DataFrame, carried: list[str]) -> DataFrame:
    """Facts about a query and a chunk that need their texts; small values only come out."""
    pairs = pairs.withColumns(
        {
            "_phrase": _grams(F.col("t_join")),
            "_name": _named(F.col("t_join")),
            "_alias": tx.alias_matches(F.col("q_aliases"), F.col("t_aliases")),
            "_concepts": F.size(F.map_keys("q_aliases")),
        }
    )
    labels = lambda found: F.size(F.array_intersect("q_labels", found))
    body_only = F.size(F.array_except(F.array_intersect("q_labels", "t_body_labels"), "t_head_labels"))
    contains_query = F.contains(F.col("t_norm"), F.col("q_norm"))
    identifier = F.arrays_overlap("q_identifiers", "t_words")
    field = _named(F.col("t_title_join")) | F.exists(
        "t_fields",
        lambda f: F.exists("q_concepts", lambda p: F.contains(f, F.concat(F.lit(" "), p, F.lit(" ")))),
    )
    return pairs.select(
        *carried,
        "q_rare",
        F.transform("q_rare", lambda t: F.array_contains("q_entities", t)).alias("rare_entity"),
        F.transform("q_rare", lambda t: F.array_contains("t_full", t)).alias("rare_hit"),
        F.transform("q_rare", lambda t: F.array_contains("t_head_tokens", t)).alias("rare_in_heading"),
        F.when(contains_query | F.col("_name"), fixed.EXACT_QUERY_BOOST)
        .when(F.col("_phrase") >= 3, fixed.EXACT_PHRASE_BOOST[3])
        .when(F.col("_phrase") == 2, fixed.EXACT_PHRASE_BOOST[2])
        .when(identifier, fixed.EXACT_IDENTIFIER_BOOST)
        .otherwise(0.0)
        .alias("exact_match_boost"),
        F.when(F.col("_name"), fixed.ENTITY_BOOST).otherwise(0.0).alias("entity_match_boost"),
        (
            tx.ratio(F.size(F.array_intersect("q_tokens", "t_tokens")), F.size("q_tokens"))
            * fixed.TOKEN_OVERLAP_RATE
        ).alias("token_overlap_boost"),
        (tx.ratio(F.col("_alias"), F.col("_concepts")) * fixed.ALIAS_OVERLAP_RATE).alias("alias_overlap_boost"),
        F.when(field, fixed.FIELD_BOOST).otherwise(0.0).alias("field_match_boost"),
        F.least(
            F.lit(fixed.STRUCTURED_LABEL_MAX),
            labels("t_head_labels") * fixed.STRUCTURED_LABEL_HEADING_BOOST
            + body_only * fixed.STRUCTURED_LABEL_BODY_BOOST,
        ).alias("structured_label_boost"),
        F.exists("t_head_norms", lambda h: F.contains(h, F.col("q_heading"))).alias("heading_exact"),
        F.coalesce(F.array_max(F.transform("t_head_joins", _grams)), F.lit(0)).alias("heading_phrase"),
        tx.concept_coverage(F.col("q_aliases"), F.col("t_aliases")).alias("concept_coverage"),
        F.contains(F.col("t_lower"), F.col("q_norm")).alias("body_exact"),
        "q_top",
    )


def token_weights(facts: DataFrame) -> DataFrame:
    """Add ``weights``: candidate-local rarity of each query token over all candidates of the query."""
    per_query = Window.partitionBy("query_id")
    slots = range(fixed.QUERY_TOKEN_LIMIT)
    hit = lambda i: F.sum(F.coalesce(F.get("rare_hit", F.lit(i)), F.lit(False)).cast("int")).over(per_query)
    facts = facts.withColumns({"_rows": F.count(F.lit(1)).over(per_query), **{f"_df{i}": hit(i) for i in slots}})
    df = F.array(*[F.col(f"_df{i}") for i in slots])
    weights = F.transform(
        F.slice(df, F.lit(1), F.size("q_rare")), lambda n: F.log2((F.col("_rows") + 0.5) / (n + 0.5))
    )
    return facts.withColumn("weights", weights).drop("_rows", *[f"_df{i}" for i in slots])


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def rank(
    candidates: DataFrame, rows: DataFrame, queries: DataFrame, tags: DataFrame, signals: DataFrame | None = None
) -> DataFrame:
    """Score every candidate.

    ``candidates`` from :func:`unite`; ``rows(chunk_id, conversation_id, title, body,
    conversation_timestamp, ...)`` one row per chunk, with ``_ns`` and ``owner`` when scopes have to be
    checked; ``queries(query_id, query, tags, as_of, namespaces, user_id)``; ``tags(conversation_id, tag,
    seq)``.  Adds the columns of ``COMPONENTS``, ``sources``, ``conversation_tags`` and ``body_exact``;
    bodies are left behind.

    ``signals`` are the stored ones of :mod:`.signals`, met by the ``text_key`` of the rows, which then need no
    body.  Without them texts are shuffled by chunk and analysed here; a chunk brings the queries that found it along,
    since its signals take several times the room of its text and would have to move to meet them.  Query signals are sent to the tasks when
    their size, estimated from the query texts, is small; otherwise Spark joins them as it sees fit.
    """
    spark = candidates.sparkSession
    count, text_bytes = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()
    most = count * CANDIDATES_PER_QUERY
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, most // ROWS_PER_TASK))
    asked = query_signals(queries).join(
        queries.select(
            "query_id",
            F.col("tags").alias("requested_tags"),
            "as_of",
            *[c for c in ("namespaces", "user_id") if c in queries.columns],
        ),
        "query_id",
    )
    if count * QUERY_BYTES + text_bytes * SIGNAL_FACTOR <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    found_by = F.struct(*[c for c in candidates.columns if c != "chunk_id"])
    block = F.pmod(F.xxhash64("query_id"), F.lit(1 + count // QUERIES_PER_ROW)).alias("_block")
    finders = candidates.groupBy("chunk_id", block).agg(F.collect_list(found_by).alias("_found")).drop("_block")
    if signals is None:
        analysed = chunk_signals(rows.repartition(tasks, "chunk_id").join(finders, "chunk_id"))
    else:
        keys = rows.select("text_key").distinct()
        if most * CANDIDATE_BYTES <= BROADCAST_BYTES:
            keys = F.broadcast(keys)  # at most one per candidate
        analysed = rows.join(signals.join(keys, "text_key", "left_semi"), "text_key").drop("text_key").join(finders, "chunk_id")
    pairs = analysed.select(*[c for c in analysed.columns if c != "_found"], F.inline("_found")).join(asked, "query_id")
    if "owner" in rows.columns:
        pairs = pairs.filter(in_scope(F.col("namespaces"), F.col("user_id"), F.col("_ns"), F.col("owner"))).drop("_ns", "owner")
    kept = [c for c in pairs.columns if c[:2] not in ("t_", "q_") and c not in ("namespaces", "user_id")]
    facts = durable(token_weights(_pair_facts(pairs, kept)))  # small values, a few hundred rows per query
    found = facts.select("conversation_id").distinct()
    if most * CANDIDATE_BYTES <= BROADCAST_BYTES:
        found = F.broadcast(found)
    listed = tags_by_conversation(tags.join(found, "conversation_id", "left_semi"))
    table = facts.join(listed, "conversation_id", "left")
    none = F.array().cast("array<string>")
    zipped = F.arrays_zip(
        F.col("weights").alias("w"),
        F.col("rare_hit").alias("hit"),
        F.col("rare_entity").alias("entity"),
        F.col("rare_in_heading").alias("heading"),
    )
    table = table.withColumns(
        {
            "lexical_score": F.coalesce(rank_score(F.col("lexical_rank")), F.lit(0.0)),
            "semantic_score": F.coalesce(normalized_score(F.col("semantic_raw")), F.lit(0.0)),
            "recent_canonical_score": F.least(
                F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("recent_score", F.lit(0.0)))
            ),
            "conversation_tags": F.coalesce("tags", none),
            "_tag_tokens": F.coalesce("tag_tokens", F.array().cast("array<array<string>>")),
            "_z": zipped,
        }
    )
    strong = F.filter("_z", lambda z: z["hit"] & (z["w"] > 0))
    table = table.withColumns(
        {
            "sources": F.filter(
                F.array(
                    F.when(F.col("lexical_rank").isNotNull(), F.lit("lexical")),
                    F.when(F.col("semantic_score") > 0, F.lit("semantic")),
                    F.when(F.col("recent_score").isNotNull(), F.lit("recent_canonical")),
                ),
                lambda s: s.isNotNull(),
            ),
            "_strong": strong,
            "_weight": _total(F.col("weights")),
            "_content_weight": _total(F.transform(F.filter("_z", lambda z: ~z["entity"]), lambda z: z["w"])),
            "_heading_weight": _total(F.transform(F.filter("_z", lambda z: z["heading"]), lambda z: z["w"])),
        }
    ).filter(F.size("sources") > 0)
    phrase_boost = (
        F.when(F.col("heading_phrase") >= 4, fixed.HEADING_PHRASE_BOOST[4])
        .when(F.col("heading_phrase") == 3, fixed.HEADING_PHRASE_BOOST[3])
        .when(F.col("heading_phrase") == 2, fixed.HEADING_PHRASE_BOOST[2])
        .otherwise(0.0)
    )
    coverage = tx.ratio(F.col("_heading_weight"), F.col("_weight"))
    strong_weight = _total(F.transform("_strong", lambda z: z["w"]))
    strong_content = _total(F.transform(F.filter("_strong", lambda z: ~z["entity"]), lambda z: z["w"]))
    strong_entities = F.size(F.filter("_strong", lambda z: z["entity"]))
    table = table.withColumns(
        {
            "source_confidence": F.greatest("lexical_score", "semantic_score", "recent_canonical_score"),
            "source_agreement_boost": F.least(
                F.lit(fixed.AGREEMENT_MAX), (F.size("sources") - 1) * fixed.AGREEMENT_RATE
            ),
            "recency_boost": recency_boost(F.col("conversation_timestamp"), F.col("as_of")),
            "tag_match_boost": tag_boost(
                F.col("conversation_tags"), F.col("_tag_tokens"), F.coalesce("requested_tags", none), F.col("q_top")
            ),
            "heading_match_boost": F.when(F.col("heading_exact"), fixed.HEADING_EXACT_BOOST).otherwise(
                F.least(F.lit(fixed.HEADING_MAX_PARTIAL), phrase_boost + coverage * fixed.HEADING_COVERAGE_RATE)
            ),
            "specificity_boost": tx.ratio(strong_weight, F.col("_weight")) * fixed.SPECIFICITY_RATE,
            "co_occurrence_boost": F.least(
                F.lit(fixed.COOCCURRENCE_MAX),
                F.greatest(F.lit(0), F.size("_strong") - 1) * fixed.COOCCURRENCE_PER_CONCEPT,
            ),
            "_content": tx.ratio(strong_content, F.col("_content_weight")),
            "_entity": F.least(
                F.lit(fixed.ENTITY_EVIDENCE_MAX), strong_entities * fixed.ENTITY_EVIDENCE_RATE
            ),
        }
    )
    signal = F.col("exact_match_boost") + F.col("heading_match_boost") + F.col("structured_label_boost")
    table = table.withColumn(
        "lexical_evidence",
        F.least(F.lit(1.0), F.least(F.lit(1.0), signal) + F.col("_content") + F.col("_entity")),
    )
    table = table.withColumn(
        "semantic_lift", F.col("semantic_score") * (1 - F.col("lexical_evidence")) * F.col("concept_coverage")
    )
    gated = (F.col("entity_match_boost") + F.col("token_overlap_boost") + F.col("specificity_boost")) * F.col(
        "lexical_evidence"
    )
    plain = [
        "source_confidence",
        "source_agreement_boost",
        "exact_match_boost",
        "heading_match_boost",
        "structured_label_boost",
        "alias_overlap_boost",
        "field_match_boost",
        "co_occurrence_boost",
        "recency_boost",
        "tag_match_boost",
        "semantic_lift",
    ]
    table = table.withColumn("final_score", reduce(Column.__add__, [F.col(c) for c in plain]) + gated)
    kept = [c for c in kept if c not in ("requested_tags", "as_of")]
    return table.select(*kept, "sources", "conversation_tags", "body_exact", *COMPONENTS)


# --------------------------------------------------------------------------- page


def matches_tags(requested: Column, mode: Column, tags: Column) -> Column:
    """Whether the conversation's tags satisfy the requested ones (none requested = always)."""
    some, all_ = F.arrays_overlap(requested, tags), F.size(F.array_except(requested, tags)) == 0
    return (F.size(requested) == 0) | F.when(mode == "any", some).otherwise(all_)


def page(ranked: DataFrame, queries: DataFrame, semantic: DataFrame | None) -> DataFrame:
    """Tag filter, score floor, five per conversation, the limit, and one slot for the best semantic hit.

    ``queries(query_id, limit, tags, tag_mode)``; ``semantic(query_id, chunk_id, semantic_raw)`` is the
    merged channel before hydration.  Adds ``position`` and ``headroom``.
    """
    limits = queries.select("query_id", "limit", F.col("tags").alias("_tags"), "tag_mode")
    rows = ranked.join(limits, "query_id").filter(
        matches_tags(F.col("_tags"), F.col("tag_mode"), F.col("conversation_tags"))
    )
    rows = rows.withColumn("_score", F.round("final_score", 9))
    if semantic is None:
        rows = rows.withColumn("_best", F.lit(False))
    else:
        best = semantic.groupBy("query_id").agg(
            F.min_by(F.struct("chunk_id", "semantic_raw"), F.struct(-F.col("semantic_raw"), F.col("chunk_id"))).alias("_b")
        )
        best = best.filter(F.col("_b.semantic_raw") >= fixed.SEMANTIC_HEADROOM_MIN_SCORE).select(
            "query_id", F.col("_b.chunk_id").alias("chunk_id"), F.lit(True).alias("_best")
        )
        rows = rows.join(best, ["query_id", "chunk_id"], "left").withColumn("_best", F.coalesce("_best", F.lit(False)))
    order = [F.col("_score").desc(), F.col("chunk_id")]
    kept = (F.col("final_score") >= fixed.SCORE_FLOOR) | F.col("body_exact")
    in_conversation = Window.partitionBy("query_id", "conversation_id", "_kept").orderBy(*order)
    rows = rows.withColumn("_kept", kept).withColumn("_nth", F.row_number().over(in_conversation))
    rows = rows.withColumn("_open", F.col("_kept") & (F.col("_nth") <= fixed.PER_CONVERSATION_MAX_RESULTS))
    in_query = Window.partitionBy("query_id", "_open").orderBy(*order)
    rows = rows.withColumn("_on_page", F.col("_open") & (F.row_number().over(in_query) <= F.col("limit")))
    rows = rows.filter(F.col("_on_page") | F.col("_best"))
    whole = Window.partitionBy("query_id")
    rows = rows.withColumns(
        {
            "headroom": ~F.col("_on_page"),
            "_n": F.count(F.lit(1)).over(whole),
            "_added": F.max((~F.col("_on_page")).cast("int")).over(whole) == 1,
        }
    )
    shown = F.when(F.col("_added"), F.round("final_score", 6)).otherwise(F.col("_score"))
    rows = rows.withColumn("_place", F.row_number().over(whole.orderBy(shown.desc(), F.col("chunk_id"))))
    last_is_best = F.max(F.when(F.col("headroom"), F.col("_place"))).over(whole) == F.col("_n")
    dropped = F.when(F.col("_n") <= F.col("limit"), F.lit(-1)).when(last_is_best, F.col("_n") - 1).otherwise(F.col("_n"))
    rows = rows.withColumn("_drop", dropped).filter(F.col("_place") != F.col("_drop"))
    position = F.row_number().over(whole.orderBy("_place"))
    return rows.withColumn("position", position).drop(
        "limit", "_tags", "tag_mode", "_score", "_best", "_kept", "_nth", "_open", "_on_page", "_n", "_added", "_place", "_drop"
    )


def snippet(body: Column) -> Column:
    long = F.length(body) > fixed.SNIPPET_MAX
    return F.when(long, F.concat(F.substring(body, 1, fixed.SNIPPET_MAX - 3), F.lit("..."))).otherwise(body)
