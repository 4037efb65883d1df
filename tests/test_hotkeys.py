"""Joins whose keys are uneven."""

import pytest
from pyspark.sql import functions as F

from mergescope.operators.hotkeys import heavy_keys, split_join
from mergescope.operators.joins import lookup, membership
from mergescope.operators.labelling import attribute
from tests.test_operators import rows


@pytest.fixture
def many_tasks(spark):
    """Sort-merge joins over sixteen tasks that stay as they are dealt."""
    changed = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    known = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in known.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def uneven(spark, n=20_000):
    """Half of the rows have key 7, a tenth have none, the others are of many keys."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 997)
    return spark.range(n).select("id", key.alias("k"), F.lit("x").alias("note"))


def test_heavy_keys_are_found_whole(spark, many_tasks):
    heavy = heavy_keys(uneven(spark), ["k"]).collect()[0].heavy
    wanted = spark.range(1).select(F.xxhash64(F.lit(7).cast("long")), F.xxhash64(F.lit(None).cast("long"))).collect()[0]
    assert set(heavy) == set(wanted)
    even = spark.range(50_000).select((F.col("id") % 5000).alias("k"))
    assert heavy_keys(even, ["k"]).collect()[0].heavy == []
    assert heavy_keys(even.limit(0), ["k"]).collect()[0].heavy == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_split_join_has_the_rows_of_the_plain_one(spark, many_tasks, how):
    df, single = uneven(spark), spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    assert rows(split_join(df, single, ["k"], how)) == rows(df.join(single, "k", how).select("k", "id", "note", "v"))


def test_half_of_the_rows_are_spread_over_all_tasks(spark, many_tasks):
    df, single = uneven(spark), spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))

    def largest(joined):
        return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).collect()[0][0]

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or the last aggregate sees other partitions
    try:
        plain, split = largest(df.join(single, "k", "left")), largest(split_join(df, single, ["k"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plain > 10_000 and split < 20_000 / 16 * 2


def test_lookups_flags_and_authors_of_hot_keys(spark, many_tasks):
    df = uneven(spark)
    dimension = spark.range(2000).select((F.col("id") % 900).alias("k"), F.col("id").alias("o"), F.concat(F.lit("n"), "id").alias("name"))
    names = lookup(df, dimension, ["k"], [F.col("o")], {"name": "?"})
    assert rows(names.select("id", "name")) == rows(lookup(df, dimension, ["k"], [F.col("o")], {"name": "?"}, split_hot=False).select("id", "name"))
    flags = membership(df, dimension, ["k"], "known")
    assert rows(flags) == rows(membership(df, dimension, ["k"], "known", split_hot=False)) and flags.where("known").count() > 10_000
    prs = df.select("id", F.concat(F.lit("u"), "k").alias("user"))
    users = spark.createDataFrame([("u7", "old", 1), ("u7", "Devin", 2), ("u3", "Cursor", 1)], "user string, agent string, id int")
    counts = {r.agent: r["count"] for r in attribute(prs, users, ["id"]).groupBy("agent").count().collect()}
    expected = sum(i % 2 and i % 10 != 1 and i % 997 == 3 for i in range(20_000))
    sevens = sum(i % 2 and i % 10 != 1 and i % 997 == 7 for i in range(20_000))
    assert counts["Cursor"] == expected and counts["Devin"] == 10_000 + sevens and sum(counts.values()) == 20_000
