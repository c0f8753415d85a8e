"""Session defaults, table access and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "scholion", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow; cluster settings given outside win."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made, but only in a local session;
    on a cluster each machine would write to its own disk.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="scholion-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Tables written within leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Steps that would be one method too long for the JVM to compile (it interprets those) run as several short ones."""
    with _set(spark, "spark.sql.codegen.hugeMethodLimit", "8000"):
        yield


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the folder that all executors share.

    A compressed table takes a fraction of what checkpointed rows do, later reads
    take only the columns they need, and it outlives any executor. Shuffle files
    behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(df: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int = 200_000) -> DataFrame:
    """``df`` joined with a kept table that may be small.

    The table's rows are counted; up to ``rows`` of them are sent to every
    executor, more are joined by a sort and merge, so that a table that grows
    with the data never reaches the driver, however well it was compressed.
    Give it tables of short rows that :func:`checkpoint` wrote.
    """
    if small.count() <= rows:
        return df.join(F.broadcast(small), on, how)
    return df.hint("merge").join(small.hint("merge"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan has fewer partitions than there are; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
