"""Session construction for tests, the benchmark and local use."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from uuid import uuid4

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def local_session(
    app: str = "mergescope", cpus: int | None = None, shuffle_partitions: int | None = None, shared: str | None = None
) -> SparkSession:
    """A local session; on a cluster the caller brings its own session and settings.

    shared: the folder for stored intermediates and checkpoints, used where the settings name none.
    """
    cores = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if not SparkConf().get("spark.checkpoint.dir", None):
        builder = builder.config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="mergescope-"))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can write to: the session's spark.checkpoint.dir, which is fixed when it starts."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("start the session with spark.checkpoint.dir set to a folder that all its executors share")
    return configured.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    """Settings that hold for what is run inside, and not for what is only planned there."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: What a write shuffles is removed when it is done, not when the driver next collects its garbage.
SHUFFLES_FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A join on several columns takes tables that are dealt out by one of them as they are.
JOINED_AS_DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once to the shared folder and read it from there.

    For results several branches start from: the work behind them is not repeated, a lost executor costs only a re-read,
    and the planner knows the table's size.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid4().hex}"
    with settings(df.sparkSession, SHUFFLES_FREED):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """`stored`, in so many buckets of a key's hash: joins of such tables on the key, and aggregates, shuffle nothing.

    Rows dealt out by ``repartition(parts, key)`` make one file a bucket. The catalog holds the table only until it is read.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid4().hex}"
    write = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/tables/{table}")
    with settings(spark, SHUFFLES_FREED):
        write.bucketBy(parts, key).saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay
    return read
