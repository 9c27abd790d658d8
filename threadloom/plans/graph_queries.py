"""Registered queries: ids, text analysis, graph and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, ids, text as tx
from ..operators import chunking, graph
from ..sources.messages import linear_nodes as linear
from . import corpus


def domain_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.messages(spark, d)
    return rows.select(
        "conversation_id",
        "turn",
        ids.domain_id("conversation", F.lit("chatgpt"), F.col("conversation_id")).alias("import_id"),
        ids.domain_id("mcp-message", F.col("role"), F.col("text")).alias("message_id"),
        ids.domain_id("vector", F.lit(None).cast("string"), F.col("conversation_id")).alias("null_part_id"),
    )


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.messages(spark, d)
    return rows.select(
        "conversation_id", "turn", ids.estimate_tokens(F.col("text")).cast("bigint").alias("tokens")
    )


def _words(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.messages(spark, d).withColumn("norm", tx.normalize_text(F.col("text")))
    return rows.withColumn("words", tx.words(F.col("norm")))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    exploded = _words(spark, d).select(F.explode("words").alias("token"))
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def stemmed_counts(spark: SparkSession, d: str) -> DataFrame:
    # stem each distinct token once instead of every occurrence
    counts = token_counts(spark, d).select(tx.stem(F.col("token")).alias("stem"), "n")
    return counts.groupBy("stem").agg(F.sum("n").alias("n"))


def stopword_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = _words(spark, d).withColumn("stems", tx.stems(F.col("words")))
    rows = rows.withColumn("kept", tx.meaningful(F.col("stems")))
    return rows.select(
        "conversation_id",
        "turn",
        F.size("kept").cast("bigint").alias("n"),
        F.array_join(F.slice("kept", 1, 12), " ").alias("first_tokens"),
        F.array_join(tx.lexical_tokens(F.col("norm")), " ").alias("first_lexical"),
    )


def entity_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "benchmark").withColumn("nfkc", tx.nfkc(F.col("text")))
    return rows.select("item_id", F.array_join(tx.entity_tokens(F.col("nfkc")), " ").alias("entities"))


def concept_detection(spark: SparkSession, d: str) -> DataFrame:
    """Concepts named by page markup and by messages (each message carries two phrases of the table)."""
    pages = corpus.table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    phrases = tx.lit_strings([p for _, ps, _ in fixed.CONCEPTS for p in ps])
    pick = lambda n: F.element_at(phrases, (n % F.size(phrases) + 1).cast("int"))
    num, turn = F.col("num"), F.col("turn")
    rows = corpus.messages(spark, d).select(
        F.concat_ws(":", "conversation_id", "turn").alias("id"),
        F.concat_ws(" ", pick(num + turn), "text", F.upper(pick(num * 7 + turn))).alias("text"),
    )
    rows = tx.with_signals(rows.unionByName(pages), "t", F.col("text"))
    return rows.select("id", F.explode("t_aliases").alias("concept", "found")).select(
        "id", "concept", F.array_join(F.transform("found", lambda p: F.trim(p)), "|").alias("phrases")
    )


def tags_normalized(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.headers(spark, d).select("conversation_id", "num", "namespace")
    raw = F.array(
        F.concat(F.lit("  T"), F.col("num") % 5, F.lit(" ")),
        F.concat(F.lit("t"), F.col("num") % 5),
        F.lit("   "),
        F.concat(F.lit("Lang-"), F.col("num") % 2),
        F.upper("namespace"),
        F.col("namespace"),
    )
    return rows.select("conversation_id", F.array_join(tx.normalize_tags(raw), "|").alias("tags"))


def structured_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels such as "event 16" written into each message by the model's rule."""
    rows = corpus.messages(spark, d)
    labelled = F.concat(
        F.lit("Event "), F.col("num"), F.lit("/phase-"), F.col("turn"), F.lit(" chapter_"), F.col("num") % 7,
        F.lit(" "), F.col("text"),
    )
    rows = rows.select("conversation_id", "turn", tx.normalize_text(labelled).alias("norm"))
    return rows.select(
        "conversation_id", "turn", F.array_join(tx.structured_labels(F.col("norm")), "|").alias("labels")
    )


def headings(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.messages(spark, d)
    body = F.concat(F.lit("[Chat "), F.col("num"), F.lit("]\n  [turn "), F.col("turn"), F.lit("] \n[]\n[third]\n"), F.col("text"))
    rows = rows.select("conversation_id", "turn", tx.heading_texts(corpus.title_of(F.col("text")), body).alias("h"))
    return rows.select("conversation_id", "turn", F.array_join("h", "|").alias("headings"))


def linear_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = linear(corpus.messages(spark, d))
    return rows.select(
        "conversation_id",
        "id",
        "node_id",
        F.coalesce("parent_id", F.lit("-")).alias("parent_id"),
        F.coalesce(F.array_join("children", ","), F.lit("")).alias("children"),
        "role",
        "sequence",
        "line_number",
    )


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.branches(corpus.nodes(spark, d), corpus.headers(spark, d), "conversation_id")


def active_branch(spark: SparkSession, d: str) -> DataFrame:
    return graph.active_sequence(_paths(spark, d), "conversation_id")


def alternate_branches(spark: SparkSession, d: str) -> DataFrame:
    rows = _paths(spark, d).filter(F.col("branch_key") != graph.ACTIVE)
    return rows.select(
        "conversation_id", "branch_key", "pos", "node_id", F.coalesce("sequence", F.lit(-1)).alias("sequence")
    )


def graph_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Damaged graphs: some roots point at a ghost or back at the last turn, some heads are gone."""
    last = corpus.headers(spark, d).select("conversation_id", "num", "current_node")
    damaged = (
        corpus.nodes(spark, d)
        .join(last, "conversation_id")
        .withColumn(
            "parent_id",
            F.when((F.col("turn") == 0) & (F.col("num") % 11 == 5), F.lit("ghost"))
            .when((F.col("turn") == 0) & (F.col("num") % 13 == 6), F.col("current_node"))
            .otherwise(F.col("parent_id")),
        )
    )
    heads = last.withColumn(
        "current_node",
        F.when(F.col("num") % 7 == 0, F.lit("gone")).when(F.col("num") % 7 == 1, F.lit(None)).otherwise(F.col("current_node")),
    )
    return graph.anomalies(damaged, heads, "conversation_id").select("conversation_id", "anomaly")


def hard_split(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.messages(spark, d)
    cut = rows.select("conversation_id", "turn", chunking.split_ranges(F.col("text"), F.lit(1797)).alias("r"))
    return cut.select("conversation_id", "turn", F.posexplode("r").alias("part", "r")).select(
        "conversation_id",
        "turn",
        F.col("part").cast("bigint").alias("part"),
        F.col("r.start").cast("bigint").alias("char_start"),
        F.col("r.end").cast("bigint").alias("char_end"),
    )


def chunk_groups(spark: SparkSession, d: str) -> DataFrame:
    """Micro-message grouping over every word line of every message, as tiny units."""
    rows = corpus.messages(spark, d).select(
        "conversation_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "unit")
    )
    rows = rows.select(
        "conversation_id",
        "turn",
        F.col("line").cast("bigint").alias("pos"),
        F.lit(0).alias("part"),
        ids.estimate_tokens(F.col("unit")).alias("tokens"),
        F.lit(False).alias("is_split"),
    )
    groups = chunking.group_units(rows, ["conversation_id", "turn"])
    return groups.groupBy("conversation_id", "turn", "ordinal").agg(
        F.min("pos").alias("first_line"), F.count(F.lit(1)).alias("lines")
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(spark, d)
    return rows.select(
        "chunk_id",
        "vector_id",
        "revision_id",
        "conversation_id",
        "branch_key",
        "ordinal",
        "title",
        F.sha2("body", 256).alias("body_sha"),
        F.col("token_estimate").cast("bigint").alias("token_estimate"),
        ids.iso(F.col("conversation_timestamp")).alias("updated_at"),
        "namespace",
        F.size("sources").cast("bigint").alias("n_sources"),
    )


def chunk_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk_sources(corpus.chunks(spark, d))
    return rows.select(
        "chunk_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "source_node_id",
        F.coalesce("source_sequence", F.lit(-1)).alias("source_sequence"),
        F.col("char_start").cast("bigint").alias("char_start"),
        F.col("char_end").cast("bigint").alias("char_end"),
    )


def integrity_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content hash, segment id and revision id of every conversation."""
    return corpus.catalog(spark, d).select(
        "conversation_id", "segment_id", "content_hash", "revision_id", "node_count"
    )


QUERIES = {
    f.__name__: f
    for f in (
        domain_ids,
        token_estimates,
        token_counts,
        stemmed_counts,
        stopword_filtered,
        entity_tokens,
        concept_detection,
        tags_normalized,
        structured_labels,
        headings,
        linear_nodes,
        active_branch,
        alternate_branches,
        graph_anomalies,
        hard_split,
        chunk_groups,
        chunks,
        chunk_sources,
    )
}
QUERIES["revision_ids"] = integrity_of_ids
