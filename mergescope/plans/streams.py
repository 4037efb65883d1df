"""Streaming runs over whole tables, whose results equal a batch query's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mergescope.functions.numeric import np_round, percent
from mergescope.operators.filters import closed_fixes
from mergescope.operators.labelling import label_by_title
from mergescope.sources.warehouse import Warehouse
from mergescope.streaming.incremental import append_to, daily_counts, dedup_stream, keep_latest, merge_stream, monthly_update, run_folder
from mergescope.streaming.months import append_with_state, closing_months, corrections


def _events(w: Warehouse) -> DataFrame:
    return w.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))


def resumed_labels(w: Warehouse) -> DataFrame:
    """Titles labelled by a stream that is stopped and resumed; the second run finds nothing left to do."""
    folder = run_folder(w.spark, "labels")
    labels = label_by_title(w.prs_from(w.stream("orders")).select("id", "title"))
    append_to(labels, folder)
    return append_to(labels, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def merged_stream(w: Warehouse) -> DataFrame:
    """A base and a replayed incremental stream merged by key."""
    both = _events(w).withColumn("run", F.lit("base")).unionByName(_events(w).withColumn("run", F.lit("replay")))
    merged = append_to(dedup_stream(both, ["event_id"], "ts", "40 days"), run_folder(w.spark, "merge"))
    return merged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("keys"))


def daily_event_counts(w: Warehouse) -> DataFrame:
    """Counts of the days that closed two hours before the last event."""
    return append_to(daily_counts(_events(w), "ts", ["event_type"], "2 hours"), run_folder(w.spark, "daily"))


def all_daily_event_counts(w: Warehouse) -> DataFrame:
    """Counts of all days, the last open one included, from a stream that replaces its result."""
    return keep_latest(daily_counts(_events(w), "ts", ["event_type"], "2 hours"), run_folder(w.spark, "all-daily"))


def base_wins_stream(w: Warehouse) -> DataFrame:
    """A base and an increment with other values for the same keys: what the base holds stays, wherever it arrives."""
    base = _events(w).select("event_id", "event_type", F.col("value"), F.lit(0).alias("rank"))
    increment = _events(w).select("event_id", "event_type", (F.col("value") + 1000).alias("value"), F.lit(1).alias("rank"))
    merged = keep_latest(merge_stream(increment.unionByName(base), ["event_id"], "rank"), run_folder(w.spark, "base-wins"))
    return merged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 1000).alias("from_increment"))


def monthly_merge_counts(w: Warehouse) -> DataFrame:
    prs = w.prs_from(w.stream("orders"))
    monthly = keep_latest(monthly_update(prs, "created_at", ["agent"]), run_folder(w.spark, "monthly"))
    return monthly.withColumn("rate", np_round(percent(F.col("merged"), F.col("total")), 4))


def filtered_in_steps(w: Warehouse) -> DataFrame:
    """Closed fixes kept by a stream that reads one file at a time."""
    kept = closed_fixes(w.prs_from(w.stream("orders", files_per_trigger=1))).select("id", "month", "agent")
    return append_to(kept, run_folder(w.spark, "fixes")).groupBy("month", "agent").agg(F.count(F.lit(1)).alias("n"))


def _arrived(w: Warehouse, rows: DataFrame, folder: str, files: int | None = None) -> None:
    """More files in the folder a stream reads from, which has to be there before the stream is defined."""
    (rows if files is None else rows.repartition(files)).write.mode("append").parquet(f"{folder}/in")


def _stream_of(w: Warehouse, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = w.spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/in")


def steps_with_restart(w: Warehouse) -> DataFrame:
    """Closed fixes from files that keep arriving, one a step: four, a stop, four more, and a restart that finds no more."""
    folder, orders = run_folder(w.spark, "steps"), w.table("orders")
    for half in (0, 1):
        _arrived(w, orders.where(F.col("o_orderkey") % 2 == half), folder, files=4)
        kept = closed_fixes(w.prs_from(_stream_of(w, folder, orders.schema, files_per_trigger=1))).select("id", "month", "agent")
        append_to(kept, f"{folder}/out")
    return append_to(kept, f"{folder}/out").groupBy("month", "agent").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def closed_months(w: Warehouse) -> DataFrame:
    """Merge counts of each month, given out once when it closed, and what came too late for it.

    Orders up to 1997 arrive first, then later ones, then some of all years that were held back.
    """
    folder, orders = run_folder(w.spark, "months"), w.table("orders")
    held_back, early = F.col("o_orderkey") % 97 == 0, F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (~held_back & early, ~held_back & ~early, held_back):
        _arrived(w, orders.where(part), folder)
        stream = w.prs_from(_stream_of(w, folder, orders.schema)).select("created_at", "agent", "is_merged")
        out = append_with_state(closing_months(stream, "created_at", ["agent"], "is_merged", "10 days"), f"{folder}/out")
    return out.groupBy("kind", "month", "agent").agg(
        F.count(F.lit(1)).alias("given_out"), F.sum("total").alias("total"), F.sum("merged").alias("merged")
    )


def corrected_stream(w: Warehouse) -> DataFrame:
    """An increment that arrives first and a base that corrects two thirds of its keys: changes given out, and last values."""
    folder = run_folder(w.spark, "corrected")
    events = w.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    increment = events.withColumns({"value": F.col("value") + 1000, "rank": F.lit(1)})
    base = events.where("event_id % 3 <> 0").withColumn("rank", F.lit(0))
    for part in (increment, base):
        _arrived(w, part, folder)
        changes = corrections(_stream_of(w, folder, base.schema), ["event_id"], "rank", "ts", "40 days")
        out = append_with_state(changes, f"{folder}/out")
    last = out.groupBy("event_id", "event_type").agg(F.min_by("value", "rank").alias("value"), F.count(F.lit(1)).alias("changes"))
    return last.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 1000).alias("from_increment"), F.sum("changes").alias("changes")
    )


PLANS = {
    "i1_resumed_labels": resumed_labels,
    "i2_merged_stream": merged_stream,
    "i2_base_wins": base_wins_stream,
    "i3_daily_counts": daily_event_counts,
    "i3_all_daily_counts": all_daily_event_counts,
    "i3_monthly_update": monthly_merge_counts,
    "i4_filtered_in_steps": filtered_in_steps,
    "i4_steps_with_restart": steps_with_restart,
    "i3_closed_months": closed_months,
    "i2_corrected_stream": corrected_stream,
}
