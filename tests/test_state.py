"""Keyed state with timers, and streams that stop and go on."""

import datetime as dt

from pyspark.sql import functions as F

from mergescope.streaming.months import append_with_state, closing_months, corrections
from tests.test_operators import rows

SCHEMA = "ts timestamp, g string, is_merged boolean"


def arrive(spark, folder, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def day(month, d, hour=12):
    return dt.datetime(2025, month, d, hour)


def test_months_close_once_and_late_rows_are_set_apart(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return append_with_state(closing_months(stream, "ts", ["g"], "is_merged", "2 days"), out)

    arrive(spark, source, [(day(1, 3), "a", True), (day(1, 31, 23), "a", None), (day(1, 9), "b", False), (day(2, 1), "a", True)], SCHEMA)
    assert run().collect() == []  # the second of February less two days is still January
    arrive(spark, source, [(day(1, 20), "a", True), (day(2, 4), "b", True)], SCHEMA)  # January is open still
    first = [("closed", "2025-01", "a", 3, 2), ("closed", "2025-01", "b", 1, 0)]
    assert rows(run()) == first
    assert rows(run()) == first  # nothing new
    late = [(day(1, 5), "a", True), (day(1, 6), "a", False), (day(1, 7), "c", True), (day(2, 9), "a", False), (day(4, 1), "a", True)]
    arrive(spark, source, late, SCHEMA)
    assert rows(run()) == sorted([
        *first, ("closed", "2025-02", "a", 2, 1), ("closed", "2025-02", "b", 1, 1), ("late", "2025-01", "a", 2, 1), ("late", "2025-01", "c", 1, 1),
    ])


def test_what_the_base_holds_corrects_what_came_before(spark, tmp_path):
    source, out, schema = f"{tmp_path}/in", f"{tmp_path}/out", "k int, ts timestamp, rank int, v string"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return append_with_state(corrections(stream, ["k"], "rank", "ts", "3 days"), out)

    arrive(spark, source, [(1, day(1, 1), 1, "new"), (2, day(1, 1), 0, "base"), (2, day(1, 1), 1, "new"), (3, day(1, 2), 1, "new")], schema)
    first = [(1, 1, "new"), (2, 0, "base"), (3, 1, "new")]
    assert rows(run().select("k", "rank", "v")) == first
    arrive(spark, source, [(1, day(1, 1), 0, "base"), (1, day(1, 1), 1, "again"), (2, day(1, 2), 1, "new"), (9, day(1, 9), 1, "x")], schema)
    second = sorted([*first, (1, 0, "base"), (9, 1, "x")])
    assert rows(run().select("k", "rank", "v")) == second
    arrive(spark, source, [(3, day(1, 9), 0, "base")], schema)  # its state is gone: a first row again
    assert rows(run().select("k", "rank", "v")) == sorted([*second, (3, 0, "base")])


def test_files_are_read_one_a_step_across_a_stop(spark, tmp_path):
    import os

    from mergescope.streaming.incremental import append_to

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for half in (0, 1):
        spark.range(half * 400, half * 400 + 400).repartition(4).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        assert append_to(stream, out).count() == 400 * (half + 1)
    assert append_to(stream, out).select("id").distinct().count() == 800
    assert len([n for n in os.listdir(f"{out}/progress/commits") if n.isdigit()]) == 8


def test_many_keys_of_a_bucket_are_corrected_and_expire_each_for_itself(spark, tmp_path):
    source, out, big, schema = f"{tmp_path}/in", f"{tmp_path}/out", 2**60 + 1, "k long, ts timestamp, rank int, v long"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        changes = corrections(stream, ["k"], "rank", "ts", "3 days", buckets=2)
        assert changes.schema.simpleString() == "struct<k:bigint,ts:timestamp,rank:int,v:bigint>"
        return append_with_state(changes, out)

    arrive(spark, source, [(big + i, day(1, 1 + i % 9), 1, big if i % 3 else None) for i in range(300)] + [(None, day(1, 2), 1, 5)], schema)
    first = [(big + i, 1, big if i % 3 else None) for i in range(300)] + [(None, 1, 5)]
    order = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, run().select("k", "rank", "v").collect()), key=order) == sorted(first, key=order)
    # Keys of the first five days are no longer held: they come as first rows again, others as corrections if they are better.
    arrive(spark, source, [(big + i, day(1, 9), 2, i) for i in range(300)] + [(big + i, day(1, 9), 0, -i) for i in range(300, 302)], schema)
    gone = [i for i in range(300) if 1 + i % 9 + 3 < 6]
    second = first + [(big + i, 2, i) for i in gone] + [(big + i, 0, -i) for i in (300, 301)]
    assert sorted(map(tuple, run().select("k", "rank", "v").collect()), key=order) == sorted(second, key=order)
