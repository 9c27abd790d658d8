"""Benchmark decontamination with a hash set of test n-grams, in Column functions only.

Texts and items are lower-cased (A-Z) and cut into words. Every window of ``n`` item words, or a whole
shorter item, is hashed; the set is broadcast when its size, which is counted first, is within
``broadcast_windows``, and shuffled beyond. Document windows are hashed and looked up; a hit counts only if
all its words are equal.

Null texts and texts without words have no windows: zero words, no hits, not contaminated. Repeated rows
are told apart by row only in ``flagged`` and ``cleaned``; copies have the same result. Empty tables give
empty results, and an empty benchmark leaves every document clean. Columns besides id and text pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free, row_key, source

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-case words of ``text``; empty for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR)
    return F.filter(parts, lambda w: w != "")


def window_hashes(words_: Column, n: Column | int) -> Column:
    """Hash of each window of ``n`` words, by position from 1."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.size(words_)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(words_, i, n)).alias("hash")))


def item_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``hash, window, item_ids``: the distinct windows of all items."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.lit(n), F.size("words")))
    windows = items.select(
        "item_id", "words", "n", F.explode(window_hashes(F.col("words"), F.col("n"))).alias("w")
    ).select("item_id", "w.hash", F.slice("words", F.col("w.pos"), F.col("n")).alias("window"))
    return windows.groupBy("hash", "window").agg(F.collect_set("item_id").alias("item_ids"))


def hits(
    docs: DataFrame, benchmark: DataFrame, keys: list[str], n: int = 13, broadcast_windows: int = 1_000_000
) -> DataFrame:
    """``keys, pos, n_window, item_ids`` for every document window that equals an item window."""
    windows = item_windows(benchmark, n)
    found = windows.groupBy(F.size("window").alias("n_window")).count().collect()  # at most n rows
    lengths = sorted(row["n_window"] for row in found) or [n]
    if sum(row["count"] for row in found) <= broadcast_windows:
        windows = F.broadcast(windows)
    read = docs.select(*keys, words(F.col("text")).alias("words"))
    scanned = F.concat(*[window_hashes(F.col("words"), k) for k in lengths])
    scanned = read.select(*keys, "words", F.explode(scanned).alias("w"))
    match = (F.col("w.hash") == windows["hash"]) & (
        F.slice("words", F.col("w.pos"), F.size(windows["window"])) == windows["window"]
    )
    return scanned.join(windows, match).select(
        *keys, F.col("w.pos").alias("pos"), F.size("window").alias("n_window"), "item_ids"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, **options) -> DataFrame:
    """``k1, k2, spans, items`` of each document with a hit.

    ``spans`` holds the word positions (from 1) inside item windows.
    """
    found = hits(docs, benchmark, ["k1", "k2"], n, **options)
    # all lists are of one document: bounded by its length and the number of items
    covered = F.array_distinct(
        F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("n_window") - 1)))
    )
    return found.groupBy("k1", "k2").agg(
        F.array_sort(covered).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"),
    )


def flagged(
    docs: DataFrame, benchmark: DataFrame, n: int = 13, percent: int = 5, into: str = "contamination", **options
) -> DataFrame:
    """``docs`` with a struct column ``into``: ``n_words, n_hit, items, spans, contaminated``.

    An input column of that name is replaced.
    """
    key_name, found_name, count_name = free(docs, "row_key", "found", "word_count")
    keys = row_key({"doc_id": F.col("doc_id"), "text": F.col("text")})
    found = contamination(docs.select(*keys, "text"), benchmark, n, **options).select(
        F.struct("k1", "k2").alias(key_name), F.struct("spans", "items").alias(found_name)
    )
    joined = docs.withColumns(
        {key_name: F.struct(*keys), count_name: F.size(words(F.col("text"))).cast("long")}
    ).join(found, key_name, "left")
    spans = F.coalesce(F.col(found_name)["spans"], F.array().cast("array<int>"))
    items = F.coalesce(F.col(found_name)["items"], F.array().cast("array<long>"))
    n_hit = F.size(spans).cast("long")
    struct = F.struct(
        F.col(count_name).alias("n_words"),
        n_hit.alias("n_hit"),
        items.alias("items"),
        spans.alias("spans"),
        ((n_hit > 0) & (n_hit * 100 >= F.col(count_name) * percent)).alias("contaminated"),
    )
    return joined.select(*[c for c in docs.columns if c != into], struct.alias(into))


def cleaned(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with their hit words cut out (``remove="spans"``).

    A document with spans cut keeps its other words, lower-cased and joined by single spaces.
    """
    (into,) = free(docs, "contamination")
    done = flagged(docs, benchmark, into=into, **options)
    found = F.col(into)
    if remove == "documents":
        return done.filter(~found["contaminated"]).select(*docs.columns)
    numbered = F.transform(words(F.col("text")), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i")))
    rest = F.transform(F.filter(numbered, lambda x: ~F.array_contains(found["spans"], x["i"])), lambda x: x["w"])
    text = F.when(found["contaminated"], F.array_join(rest, " ")).otherwise(F.col("text"))
    return done.withColumn("text", text).select(*docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    done = flagged(docs, source(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("contamination.items", lambda i: i.cast("string")))
    return done.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        "contamination.contaminated",
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n
), c AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
