"""Streaming operators and the runs that drive them to the end of the available input."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergescope.session import shared_folder


def dedup_stream(df: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First arrival per key; state is kept for as long as a repeat may come."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def merge_stream(df: DataFrame, key: Sequence[str], rank: str) -> DataFrame:
    """One row per key, that of the smallest rank, for complete mode: the order of arrival does not matter."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(rank)).alias("row__"))
    return best.select(*key, "row__.*").drop(rank)


def daily_counts(df: DataFrame, ts: str, by: Sequence[str], delay: str) -> DataFrame:
    """Rows per day and group for append mode: a day is emitted once the watermark has passed its end."""
    days = df.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("day"), *by).agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), *by, "n")


def monthly_update(df: DataFrame, ts: str, by: Sequence[str]) -> DataFrame:
    """Running outcome counts per calendar month for update or complete mode; a month is no fixed window."""
    return df.groupBy(F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("month"), *by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_merged").alias("merged")
    )


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared storage for one run's output and progress."""
    return f"{shared_folder(spark)}/runs/{name}-{uuid4().hex}"


def append_to(df: DataFrame, folder: str) -> DataFrame:
    """Process what is available and append the result to Parquet; a rerun continues where the last one stopped."""
    query = (
        df.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/progress")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/data")


def keep_latest(df: DataFrame, folder: str) -> DataFrame:
    """Process what is available in complete mode; every step replaces the stored result."""

    def replace(result: DataFrame, step: int) -> None:
        result.write.mode("overwrite").parquet(f"{folder}/data")

    query = (
        df.writeStream.foreachBatch(replace).option("checkpointLocation", f"{folder}/progress").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/data")
