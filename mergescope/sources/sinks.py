"""Writing results, comparing schemas, and compacting many small files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergescope.config import PREVIEW_ROWS, SEED
from mergescope.functions.numeric import np_round
from mergescope.operators.sampling import sample_n


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str] = (), digits: Mapping[str, int] | None = None) -> None:
    """CSV with a header, doubles rounded as stated and rows in the stated order across the part files."""
    rounded = df.withColumns({c: np_round(F.col(c), d) for c, d in (digits or {}).items()}) if digits else df
    ordered = rounded.orderBy(*order) if order else rounded
    ordered.write.mode("overwrite").csv(path, header=True)


def write_by_source(prs: DataFrame, path: str, column: str = "source") -> None:
    """One write that files rows under their source; reading one source touches only its folder."""
    prs.write.mode("overwrite").partitionBy(column).parquet(path)


def write_preview(df: DataFrame, path: str, id_col: str, n: int = PREVIEW_ROWS, seed: int = SEED) -> None:
    """A small fixed sample as CSV for a quick look."""
    sample_n(df, n, id_col, seed).write.mode("overwrite").csv(path, header=True)


def compact(spark: SparkSession, source: str, target: str, files: int | None = None) -> None:
    """Rewrite a folder of small Parquet files under their unified schema.

    Without a stated number of files Spark rebalances the output to the session's advisory partition size.
    """
    table = spark.read.option("mergeSchema", True).parquet(source)
    sized = table.hint("rebalance") if files is None else table.repartition(files)
    sized.write.mode("overwrite").parquet(target)


def schema_diff(a: DataFrame, b: DataFrame, helpers: Sequence[str] = ()) -> DataFrame:
    """(column, type_a, type_b, side) for two tables' columns, without the named helper columns."""
    spark = a.sparkSession

    def described(df: DataFrame, alias: str) -> DataFrame:
        rows = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in helpers]
        return spark.createDataFrame(rows, f"column string, {alias} string")

    side = F.when(F.col("type_b").isNull(), "only_a").when(F.col("type_a").isNull(), "only_b").otherwise("shared")
    return described(a, "type_a").join(described(b, "type_b"), "column", "outer").withColumn("side", side)


def report_rows(section: str, frame: DataFrame, group: str | None, metrics: Sequence[str]) -> DataFrame:
    """Long form (section, metric, group, value) of a result table."""
    label = F.lit("all") if group is None else F.col(group).cast("string")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return frame.select(F.lit(section).alias("section"), label.alias("group"), F.inline(cells)).select(
        "section", "metric", "group", "value"
    )


def report(parts: Sequence[DataFrame]) -> DataFrame:
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


def write_report(parts: Sequence[DataFrame], path: str) -> None:
    """The report as readable lines, one per value."""
    rows = report(parts).orderBy("section", "group", "metric")
    rows.select(F.concat_ws("\t", "section", "group", "metric", F.col("value").cast("string"))).write.mode(
        "overwrite"
    ).text(path)
