"""Raw files, duplicate uploads, the import log and the integrity audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import fixed


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, size_bytes, modified_at)`` of the uploaded files, byte for byte."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")
    )


def checksums(files: DataFrame, *carried: str) -> DataFrame:
    """``(*carried, sha256, size_bytes)`` of ``files(content, ...)``; contents never leave their partition."""
    return files.select(
        *carried, F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size_bytes")
    )


def duplicates(imports: DataFrame) -> DataFrame:
    """Add ``duplicate_of``: the earliest other accepted import with the same source type and checksum.

    ``imports(import_id, source_type, sha256, status, created_at)``.  The two earliest accepted imports per
    checksum are found by aggregation, so a file uploaded very often is no bottleneck.
    """
    keys = ["source_type", "sha256"]
    accepted = imports.filter(F.col("status").isin(*fixed.IMPORT_DUPLICATE_STATES))
    first = accepted.groupBy(*keys).agg(F.min(F.struct("created_at", "import_id")).alias("_a"))
    return (
        imports.join(first, keys, "left")
        .withColumn(
            "duplicate_of",
            F.when(
                F.struct("created_at", "import_id") > F.col("_a"), F.col("_a.import_id")
            ),
        )
        .drop("_a")
        .filter(F.col("duplicate_of").isNotNull())
    )


def import_items(parsed: DataFrame) -> DataFrame:
    """The item log of ``parsed(import_id, ordinal, error, ...)``: status, error code, message of at most 1000."""
    failed = F.col("error").isNotNull()
    return parsed.select(
        *[c for c in parsed.columns if c != "error"],
        F.when(failed, "failed").otherwise("complete").alias("status"),
        F.when(failed, fixed.PARSER_ERROR).alias("error_code"),
        F.substring("error", 1, 1000).alias("error_message"),
    )


def import_status(items: DataFrame, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per import: counts, and its failures; ``first`` asks for a page of the first ones in file order."""
    totals = items.groupBy("import_id").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    failures = items.filter(F.col("status") == "failed")
    if first is not None:
        window = Window.partitionBy("import_id").orderBy("ordinal")
        failures = failures.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= first).drop("_n")
    return totals, failures


def integrity_audit(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """``(problem, detail)`` for ``manifests(revision_id, manifest_key, segment_keys)`` against ``files(key)``.

    A missing manifest hides its segments; a segment without a key is reported as ``missing-key``.
    """
    known = files.select("key").distinct()
    gone = manifests.join(known, F.col("manifest_key") == F.col("key"), "left_anti")
    present = manifests.join(known, F.col("manifest_key") == F.col("key"), "left_semi")
    segments = present.select("revision_id", F.explode("segment_keys").alias("key"))
    lost = segments.join(known, "key", "left_anti")
    return gone.select(F.lit("missing_manifest").alias("problem"), F.col("revision_id").alias("detail")).unionByName(
        lost.select(
            F.lit("missing_segment").alias("problem"),
            F.concat_ws(":", "revision_id", F.coalesce("key", F.lit("missing-key"))).alias("detail"),
        )
    )


def checksum_audit(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose bytes no longer have the recorded ``sha256``: ``expected(path, sha256)``."""
    found = checksums(files, "path").withColumnRenamed("sha256", "_found")
    return expected.join(found, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("_found"))).select("path", "sha256", "_found")
