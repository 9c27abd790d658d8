"""Sharding by extendible hashing, in Column functions only.

A document's hash is the first 60 bits of the MD5 of its id. A bucket is the set of documents that share a
prefix of hash bits. It splits on the next bit only while it holds more bytes than the limit and more than
one hash, so that shards have different depths. The directory maps every prefix of the deepest depth to
its bucket.

Splits are found on counted cells, never on documents: bytes are added up per prefix of ``step`` bits, and
only cells of oversized buckets are counted again with ``step`` more bits. Documents with one hash (repeated
ids, a null id) cannot be told apart by bits: their bucket is divided by a count of bytes instead (``part``),
so that only a single document larger than the limit exceeds it. A null text has zero bytes. An empty table
has an empty directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free, partitions, source, table, utf8_length

BITS = 60
LIMIT = 8 << 20


def hash_bits(key: Column) -> Column:
    """60 hash bits of a key as a long; null has the hash of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(hash_: Column, depth: int) -> Column:
    return F.shiftright(hash_, BITS - depth)


def directory(counted: DataFrame, limit: int = LIMIT, step: int = 12) -> DataFrame:
    """``depth, prefix, bytes, n_hashes`` of every bucket, from ``hash, bytes`` with one row per hash.

    ``step`` bits are counted in a round: at most 2**step cells per bucket that is still too large.
    """
    full = (F.col("bytes") > limit) & (F.col("n_hashes") > 1)
    whole = counted.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_hashes")).filter("n_hashes > 0")
    buckets = table(whole.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "bytes", "n_hashes"))
    done, depth = buckets.filter(~full), 0
    too_large = buckets.filter(full)
    while not too_large.isEmpty():
        deeper = min(step, BITS - depth)
        inside = counted.join(
            too_large.select("prefix"), prefix(F.col("hash"), depth) == F.col("prefix"), "left_semi"
        )
        cells = inside.groupBy(prefix(F.col("hash"), depth + deeper).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n_hashes")
        )
        levels = [
            F.struct(F.lit(depth + k).alias("depth"), F.shiftright("cell", deeper - k).alias("prefix"))
            for k in range(deeper + 1)
        ]
        sums = (
            cells.select("bytes", "n_hashes", F.explode(F.array(*levels)).alias("b"))
            .groupBy("b.depth", "b.prefix")
            .agg(F.sum("bytes").alias("bytes"), F.sum("n_hashes").alias("n_hashes"))
        )
        sums = table(sums)
        # a full bucket has full ancestors only, so a bucket exists if its parent is full
        parents = sums.filter(full).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = sums.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi")
        split = table(split.select("depth", "prefix", "bytes", "n_hashes"))
        depth += deeper
        done = done.unionByName(split.filter(~full))
        too_large = split.filter(full & (F.col("depth") == depth))
    return table(done)


def assigned(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", into: str = "shard") -> DataFrame:
    """``docs`` with a struct column ``into``: ``bytes, depth, prefix, part, name``.

    ``part`` is null but in a bucket of one hash above the limit. An input column of that name is replaced.
    """
    hash_name, bucket_name, part_name, bytes_name = free(docs, "shard_hash", "shard_bucket", "shard_part", "shard_bytes")
    hash_, bytes_ = hash_bits(F.col(key)), utf8_length(F.col(text))
    counted = table(
        docs.select(hash_.alias("hash"), bytes_.alias("bytes")).groupBy("hash").agg(F.sum("bytes").alias("bytes"))
    )
    buckets = directory(counted, limit)
    depths = [row["depth"] for row in buckets.select("depth").distinct().collect()]  # at most 61 numbers
    places = [F.struct(F.lit(d).alias("depth"), prefix(F.col("hash"), d).alias("prefix")) for d in depths or [0]]
    located = (
        counted.select("hash", F.explode(F.array(*places)).alias("b"))
        .select("hash", "b.depth", "b.prefix")
        .join(buckets.select("depth", "prefix", (F.col("bytes") > limit).alias("divide")), ["depth", "prefix"])
        .select(F.col("hash").alias(hash_name), F.struct("depth", "prefix", "divide").alias(bucket_name))
    )
    # sizes are taken before the join, so that a reader of shards only moves no text
    joined = docs.withColumn(bytes_name, bytes_).join(located, hash_ == F.col(hash_name))
    bytes_ = F.col(bytes_name)
    divide, bucket = F.col(bucket_name)["divide"], F.col(bucket_name)
    parts = joined.withColumn(part_name, F.lit(None).cast("string"))
    if not buckets.filter(F.col("bytes") > limit).isEmpty():
        parts = parts.filter(~divide).unionByName(
            divided(joined.filter(divide), bytes_, limit, hash_name, text, part_name)
        )
    digits = F.lpad(F.conv(bucket["prefix"].cast("string"), 10, 2), bucket["depth"], "0")
    bits = F.concat(F.lit("s"), F.when(bucket["depth"] > 0, digits).otherwise(""))
    shard = F.struct(
        bytes_.alias("bytes"),
        bucket["depth"].alias("depth"),
        bucket["prefix"].alias("prefix"),
        F.col(part_name).alias("part"),
        F.concat_ws(".", bits, part_name).alias("name"),
    )
    return parts.select(*[c for c in docs.columns if c != into], shard.alias(into))


def divided(rows: DataFrame, bytes_: Column, limit: int, hash_name: str, text: str, part_name: str) -> DataFrame:
    """Rows of buckets with one hash, in parts by bytes within the blocks they were written in.

    Rows of up to half the limit fill spans of half the limit, so a part stays within it; a larger row has a
    part of its own.
    """
    (block,) = free(rows, "shard_block")
    # spread first: blocks and so windows stay small however many rows share the hash
    rows = table(rows.repartition(partitions(rows.sparkSession)).withColumn(block, F.spark_partition_id()))
    small = bytes_ * 2 <= limit
    order = Window.partitionBy(hash_name, block, small).orderBy(F.xxhash64(text))
    upto = F.sum(bytes_).over(order.rowsBetween(Window.unboundedPreceding, 0)) - bytes_
    number = F.when(small, F.floor(upto * 2 / limit)).otherwise(F.row_number().over(order))
    part = F.concat_ws("-", F.col(block).cast("string"), F.concat(F.when(small, "p").otherwise("q"), number.cast("string")))
    return rows.withColumn(part_name, part).drop(block)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """Bucket of every document."""
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    done = assigned(docs)
    return done.select("doc_id", "shard.*")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), hs AS (SELECT h, sum(bytes) AS bytes FROM d GROUP BY h),
p AS (
  SELECT k, h >> CAST({BITS} - k AS BIGINT) AS prefix, sum(bytes) AS bytes, count(*) AS n
  FROM hs, range(0, 25) r(k) GROUP BY ALL
), leaf AS (
  SELECT h, min(k) AS depth FROM hs JOIN p ON h >> CAST({BITS} - k AS BIGINT) = p.prefix
  WHERE p.bytes <= {LIMIT} OR p.n = 1 GROUP BY h
)
SELECT doc_id, bytes, CAST(depth AS INT) AS depth, h >> CAST({BITS} - depth AS BIGINT) AS prefix,
  CAST(NULL AS VARCHAR) AS part,
  's' || CASE WHEN depth > 0 THEN lpad(to_binary(h >> CAST({BITS} - depth AS BIGINT)), CAST(depth AS INT), '0') ELSE '' END AS name
FROM d JOIN leaf USING (h)
"""
