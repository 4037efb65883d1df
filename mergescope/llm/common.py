"""Helpers shared by the training-data operators: checkpoints, text columns, bucket counts and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergescope.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the cluster's shared folder; a lost executor costs a re-read only."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(*columns: str | Column) -> Column:
    """A hash to deal rows out by."""
    return F.xxhash64(*columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of an edge; component is the smallest id that links reach.

    Every round hangs each id and its neighbours on the smallest neighbour's own smallest neighbour, so distances shrink
    geometrically. Edges point from the larger id to the smaller, so a hub with very many members is the target of its
    edges, never the key that groups them. Rounds end when every id has one edge and no target has any. Loops are left
    out; null ids have no edges. No edges: an empty result.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    links = checkpointed(
        edges.where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct()
    )
    while True:
        nearest = checkpointed(links.groupBy("a").agg(F.min("b").alias("m")))
        further = nearest.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        # The checkpoint lets both sides of each join be plain shuffles, which adaptive execution splits where skewed.
        hooks = nearest.join(further, "m", "left").select("a", F.coalesce("mm", "m").alias("t"), F.col("mm").isNotNull().alias("moved"))
        hooked = links.join(hooks, "a")
        ends = hooked.select(
            F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("t").alias("t"), F.col("moved").alias("moved")),
                              F.struct(F.col("b").alias("x"), F.col("t").alias("t"), (F.col("b") != F.col("t")).alias("moved")))).alias("e")
        ).select("e.*").where("x != t")
        following = checkpointed(
            ends.groupBy(F.greatest("x", "t").alias("a"), F.least("x", "t").alias("b")).agg(F.max("moved").alias("moved"))
        )
        links = following.select("a", "b")
        if following.where("moved").isEmpty():
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
