"""Streaming: failure streaks, folded logs, incremental upserts, arrivals against approved plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failure_streaks(runs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """[T1] (``source``, ``streak``, ``failing_since``, ``last_success``) after each micro-batch.

    ``runs``: stream of (``source``, ``ts``, ``failed``). State is one small row a
    source; a success resets the streak.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, since, success = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, failed in zip(rows["ts"], rows["failed"]):
            if failed:
                since, streak = since if streak else ts.to_pydatetime(), streak + 1
            else:
                streak, since, success = 0, None, ts.to_pydatetime()
        state.update((streak, since, success))
        yield pd.DataFrame({"source": [key[0]], "streak": [streak], "failing_since": [since], "last_success": [success]})

    out = "source string, streak int, failing_since timestamp, last_success timestamp"
    return runs.withWatermark("ts", watermark).groupBy("source").applyInPandasWithState(fold, out, "streak int, since timestamp, success timestamp", "update", "NoTimeout")


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by type in tumbling windows; rows later than ``late`` are left to the batch side."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def fold_log(path: str):
    """[T2, T3] A ``foreachBatch`` function that writes each batch once, under its number: a batch that comes again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def fold_state(path: str, key: list[str], order: str):
    """[T2, T3] A ``foreachBatch`` function that folds a log to its current state: per ``key`` the row that is last in ``order``.

    Each batch makes a new version of the state from the one before it, under
    its number; a batch that comes again makes the same version again.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark, latest = batch.sparkSession, F.struct(order, *[c for c in sorted(batch.columns) if c != order])
        rows = batch
        before = f"{path}/state={number - 1}"
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(before).unionByName(batch)
        kept = rows.groupBy(*key).agg(F.max(latest).alias("r")).select(*[c if c in key else F.col(f"r.{c}").alias(c) for c in batch.columns])
        kept.write.mode("overwrite").parquet(f"{path}/state={number}")

    return fold


def arrivals(files: DataFrame, approved: DataFrame) -> DataFrame:
    """[T4] Arriving files (``file``, ``md5``) against approved plans (``file``, ``ok_md5``, ``plan``), stream to static.

    A plan holds only for the very bytes it was approved for.
    """
    return files.join(approved, "file", "left").withColumn("verdict", F.when(F.col("ok_md5").isNull(), "unplanned").when(F.col("ok_md5") != F.col("md5"), "bytes changed").otherwise("approved"))
