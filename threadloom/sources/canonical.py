"""Append-only tables of canonical data and replaceable tables of derived data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..operators.lexical import in_scope
from ..operators.revisions import current_view
from ..session import durable

#: Hash buckets of a new table; a written table keeps its own number (``bucket_count``).
BUCKETS = 256
SEGMENT_FORMAT = "conversation-segment.v1"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None when nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def bucket_count(spark: SparkSession, path: str, buckets: int | None = None) -> int:
    """The number of buckets of the table at ``path``, a property that is written with it."""
    kept = f"{path}.layout"
    try:
        return int(spark.read.text(kept).first()[0])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    count = buckets or BUCKETS
    spark.range(1).select(F.lit(str(count)).alias("value")).coalesce(1).write.mode("overwrite").text(kept)
    return count


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def in_buckets(table: DataFrame, buckets: DataFrame) -> DataFrame:
    """The rows of a table in some of its ``buckets(bucket)``: only their folders are read."""
    touched = [r[0] for r in buckets.select("bucket").distinct().collect()]  # at most the number of buckets
    return table.filter(F.col("bucket").isin(touched)) if touched else table.limit(0)


def lookup(spark: SparkSession, path: str, keys: DataFrame, column: str) -> DataFrame | None:
    """The rows of a table bucketed by ``column`` with one of ``keys(column)``; reads only their buckets."""
    table = read_table(spark, path)
    if table is None:
        return None
    wanted = keys.select(column).distinct().withColumn("bucket", bucket_of(column, bucket_count(spark, path)))
    return in_buckets(table, wanted).join(wanted, [column, "bucket"], "left_semi").drop("bucket")


def append_new(
    rows: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None, bucket_by: str | None = None
) -> DataFrame:
    """Append the rows whose key is not in the table yet; a repeated write adds nothing.  Null keys are equal.

    ``bucket_by`` is one of the keys; the table is then laid out by its hash, and only the buckets of the new rows
    are compared.  Returns the appended rows, made durable before the write so that they do not depend on the table.
    """
    existing = read_table(rows.sparkSession, path)
    if bucket_by is None:
        fresh = rows.dropDuplicates(keys)
    else:
        # rows are compared where they are written, so that they are shuffled once
        places = {"bucket": bucket_of(bucket_by, bucket_count(rows.sparkSession, path)), "_part": F.pmod(F.xxhash64(*keys), F.lit(16))}
        placed = rows.withColumns(places).repartition(*places)
        fresh = durable(placed.dropDuplicates([*keys, *places]).drop("_part"))
        partition_by = ["bucket"]
        if existing is not None:
            existing = in_buckets(existing, fresh)
            keys = [*keys, "bucket"]
    if existing is not None:
        known = existing.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys])
        fresh = durable(fresh.join(known, same, "left_anti"))
        if bucket_by is not None:
            fresh = fresh.repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(16)))
    elif bucket_by is None:
        fresh = durable(fresh)
    fresh.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)
    return fresh if bucket_by is None else fresh.drop("bucket")


def replace_revisions(rows: DataFrame, path: str, revisions: DataFrame, buckets: int | None = None) -> None:
    """Replace the derived rows of ``revisions(revision_id, generation_id)`` by ``rows``.

    The table is partitioned by generation and a hash bucket of the revision; only the touched
    partitions are rewritten.
    """
    keys = ["revision_id", "generation_id"]
    bucket = bucket_of("revision_id", bucket_count(rows.sparkSession, path, buckets)).alias("bucket")
    fresh = rows.withColumn("bucket", bucket)
    existing = read_table(rows.sparkSession, path)
    if existing is not None:
        touched = revisions.select("generation_id", bucket).distinct()
        kept = existing.join(touched, ["generation_id", "bucket"], "left_semi").join(revisions.select(*keys), keys, "left_anti")
        fresh = kept.unionByName(fresh)
    layout = ["generation_id", "bucket"]
    _overwrite(fresh, path, layout, None if existing is None else touched)


def _overwrite(fresh: DataFrame, path: str, layout: list[str], touched: DataFrame | None) -> None:
    fresh = durable(fresh)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(path)
    if touched is not None:
        # overwriting leaves a partition alone that has no row any more
        emptied = touched.join(fresh.select(*layout).distinct(), layout, "left_anti").collect()
        folders = ["/".join(f"{c}={r[c]}" for c in layout) for r in emptied]
        remove(fresh.sparkSession, [f"{path}/{folder}" for folder in folders])


def rewrite(
    spark: SparkSession, path: str, doomed: DataFrame, key: str, layout: list[str], bucket_by: str, change: dict[str, Column] | None = None
) -> None:
    """Remove the rows with one of ``doomed(key)``, or change some of their columns.

    Only partitions that hold such a row are written again.  If the table is bucketed by the key, only the
    buckets of ``doomed`` are looked at; otherwise the key column of the table is read to find them.
    """
    table = read_table(spark, path)
    if table is None:
        return
    keys = doomed.select(key).distinct()
    seen = table
    if bucket_by == key:
        seen = in_buckets(table, keys.select(bucket_of(key, bucket_count(spark, path)).alias("bucket")))
    touched = durable(seen.join(keys, key, "left_semi").select(*layout).distinct())
    if touched.isEmpty():
        return
    held = in_buckets(table, touched).join(touched, layout, "left_semi")
    if change is None:
        kept = held.join(keys, key, "left_anti")
    else:
        hit = held.join(keys.withColumn("_hit", F.lit(True)), key, "left")
        kept = hit.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in change.items()}).select(*held.columns)
    _overwrite(kept, path, layout, touched)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of a table, wherever it is stored."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_segments(headers: DataFrame, nodes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Canonical text form: one JSON line per header and per node, in hash buckets of the conversation.

    Nodes are spread by their own id below the bucket, so a huge conversation is many files.
    """
    def lines(df: DataFrame, kind: str, salt) -> DataFrame:
        body = F.struct(*df.columns)
        return df.select(
            F.to_json(F.struct(F.lit(SEGMENT_FORMAT).alias("format"), F.lit(kind).alias("type"), body.alias(kind))).alias("value"),
            F.pmod(F.xxhash64("conversation_id"), F.lit(buckets)).cast("int").alias("bucket"),
            salt.alias("_salt"),
        )

    both = lines(headers, "header", F.lit(0)).unionByName(lines(nodes, "node", F.pmod(F.xxhash64("node_id"), F.lit(16)).cast("int")))
    both.repartition("bucket", "_salt").drop("_salt").write.mode("append").partitionBy("bucket").text(path)


def read_segments(spark: SparkSession, path: str, header_schema: str, node_schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(headers, nodes, malformed)`` from :func:`write_segments`; bad lines are set apart, not dropped."""
    lines = spark.read.text(path).withColumn(
        "_p", F.from_json("value", f"format string, type string, header struct<{header_schema}>, node struct<{node_schema}>")
    )
    good = (F.col("_p.format") == SEGMENT_FORMAT) & (
        ((F.col("_p.type") == "header") & F.col("_p.header").isNotNull())
        | ((F.col("_p.type") == "node") & F.col("_p.node").isNotNull())
    )
    good = F.coalesce(good, F.lit(False))
    return (
        lines.filter(good & (F.col("_p.type") == "header")).select("_p.header.*"),
        lines.filter(good & (F.col("_p.type") == "node")).select("_p.node.*"),
        lines.filter(~good).select("value"),
    )


def load_current(spark: SparkSession, store: str, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(heads, nodes)`` of the current revisions that ``requests(request_id, conversation_id, namespaces, user_id)`` may see.

    ``heads`` has one row per request that is answered, with the whole revision row; deleted conversations and those
    outside the scope of the request give none.  Both tables are looked up by bucket, so only the buckets of the
    requested conversations and of their revisions are read.
    """
    log = lookup(spark, f"{store}/revisions", requests, "conversation_id")
    tombstones = lookup(spark, f"{store}/tombstones", requests, "conversation_id")
    current = durable(current_view(log, tombstones))
    heads = requests.select(
        "request_id", "conversation_id", F.col("namespaces").alias("_namespaces"), F.col("user_id").alias("_user")
    ).join(current, "conversation_id")
    heads = heads.filter(in_scope(F.col("_namespaces"), F.col("_user"), F.col("namespace"), F.col("user_id"))).drop("_namespaces", "_user")
    return heads, lookup(spark, f"{store}/nodes", heads, "revision_id")
