"""Session defaults and the one place where intermediate results are made durable."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "threadloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Partition counts are left to adaptive execution; nothing here depends on the data size.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # checkpoint files go when no DataFrame refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode, if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


#: Spark's setting by which the shuffle files of a statement go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Texts and ids take about two thirds of the room that Spark's default leaves them, and words stay in dictionaries.
COMPACT = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a statement inside go when it ends, so those of finished steps do not pile up on the disks."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    """Write ``df``; its shuffle files go with the statement."""
    with own_shuffles(df.sparkSession):
        df.write.mode(mode).options(**options).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read it back.

    Cuts the lineage like :func:`durable`, but readers fetch only the columns and rows that they need.  The
    files go when the application ends.
    """
    return stored_in_turns(df.sparkSession, lambda _: df, 1)


def stored_in_turns(spark: SparkSession, make: Callable[[int], DataFrame], turns: int) -> DataFrame:
    """:func:`stored` for the rows of ``make(0)``, ``make(1)``, ... together, written one after the other.

    Only what one turn shuffles lies on the disks at a time.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    for turn in range(turns):
        df = make(turn)
        write_parquet(df, path, "append" if turn else "errorifexists", **COMPACT)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    with own_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a statement takes the setting of the time when it is made
