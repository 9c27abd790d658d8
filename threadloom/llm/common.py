"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, write_parquet


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but later readers fetch only the columns that they need. The
    files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    write_parquet(df, path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a batch whose values a Python task holds as objects at a time.
SLICE_ROWS = 256


def slices(batches, rows: int = SLICE_ROWS):
    """The rows of Arrow ``batches`` a few at a time, so that a task does not hold the texts of a whole batch as objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def row_key(columns: dict[str, Column], id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """Two long columns that tell rows apart; only rows with equal id and equal text share them."""
    id_, text = columns[id_column], columns[text_column]
    return [F.xxhash64(text, id_).alias("k1"), F.xxhash64(id_, F.lit(1), text).alias("k2")]


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of ``df`` has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
