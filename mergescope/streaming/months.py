"""Keyed state with timers: months that close, and corrections that replace what came before.

A calendar month is no fixed window, so its counts are kept as state of their own, with a timer at the month's end. When the
watermark passes that end the counts are given out once and the state goes. Rows that arrive after it are given out as
late, whatever their number, and change nothing.

A base and an increment are merged in the same way: a key's state is the rank of what was given out for it. A row of a
better rank is given out as a correction, others are dropped, and the state goes when the watermark has passed the time in
which a correction may come. So a step gives out what it changes and nothing else. Keys are dealt into buckets by their
hash, and a bucket's ranks are one value of the store: it is read, compared as columns and written once a step, where a
call to the store for each key would take most of the time.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from mergescope.streaming.incremental import append_to

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets that keys are dealt into. A step reads and writes the buckets its keys fall into, one at a time.
BUCKETS = 512

# What runs in executors travels with its task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class MonthCounts(StatefulProcessor):
    """Counts of one month and group until its timer fires."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "total long, merged long")

    def _row(self, key, kind: str, total: int, merged: int) -> pd.DataFrame:
        return pd.DataFrame([[kind, *key, total, merged]], columns=["kind", *self.names, "total", "merged"])

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        total, merged = self.counts.get() if self.counts.exists() else (0, 0)
        fresh, late, late_merged, closes = not total, 0, 0, 0
        for part in rows:
            closes = int(part["closes"].iloc[0])
            n, hits = len(part), int(part["flag"].sum())
            if closes <= passed:
                late, late_merged = late + n, late_merged + hits
            else:
                total, merged = total + n, merged + hits
        if closes > passed:
            self.counts.update((total, merged))
            if fresh:
                self.handle.registerTimer(closes)
        elif late:
            yield self._row(key, "late", late, late_merged)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        total, merged = self.counts.get()
        self.counts.clear()
        yield self._row(key, "closed", total, merged)

    def close(self) -> None:
        pass


class Corrected(StatefulProcessor):
    """The best rank given out for each key of a bucket, until no better one can come."""

    def __init__(self, rank: str):
        self.rank = rank

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def _held(self) -> pd.DataFrame:
        """(id__, best, until) of the keys held."""
        if not self.held.exists():
            return pd.DataFrame({"id__": pd.Series(dtype=object), "best": pd.Series(dtype=float), "until": pd.Series(dtype="int64")})
        with pa.ipc.open_stream(bytes(self.held.get()[0])) as stream:
            return stream.read_pandas()

    def _hold(self, held: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(held, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(),))

    def _best(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The first row of the best rank of each key, with the latest time of all its rows."""
        rows = rows.assign(until__=rows.groupby("id__")["until__"].transform("max"))
        return rows.sort_values(["id__", self.rank], kind="stable").drop_duplicates("id__")

    def handleInputRows(self, key, rows, timerValues):
        came = None
        for part in rows:
            came = self._best(part if came is None else pd.concat([came, part], ignore_index=True))
        if came is None:
            return
        held = self._held()
        at = pd.Index(held["id__"]).get_indexer(came["id__"])
        best, rank = held["best"].to_numpy(dtype=float, copy=True), came[self.rank].to_numpy(dtype=float, na_value=np.inf)
        known = at >= 0
        better = known.copy()
        better[known] = rank[known] < best[at[known]]
        found = better | ~known
        if not found.any():
            return
        best[at[better]] = rank[better]
        until = came["until__"].to_numpy(dtype=float, na_value=0)[~known].astype("int64")
        fresh = pd.DataFrame({
            "id__": came["id__"].to_numpy(dtype=object)[~known], "best": rank[~known],
            "until": np.maximum(until, timerValues.getCurrentWatermarkInMs() + 1),
        })
        if len(fresh) and not (len(held) and held["until"].min() <= fresh["until"].min()):
            self.handle.registerTimer(int(fresh["until"].min()))
        held = held.assign(best=best)
        self._hold(pd.concat([held, fresh], ignore_index=True) if len(held) else fresh)
        yield came[found].drop(columns=["id__", "until__", "bucket__"], errors="ignore")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        left = held[held["until"] > passed]
        if len(left):
            self._hold(left)
            self.handle.registerTimer(int(left["until"].min()))
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def closing_months(df: DataFrame, ts: str, by: Sequence[str], flag: str, delay: str) -> DataFrame:
    """(kind, month, by, total, merged): each month once it has closed, and the rows that came after that.

    A month closes when the watermark, the latest time so far less the delay, has reached its end.
    """
    by = list(by)
    month = F.date_trunc("month", F.col(ts))
    rows = df.withWatermark(ts, delay).select(
        F.date_format(month, "yyyy-MM").alias("month"), *by, F.coalesce(F.col(flag), F.lit(False)).alias("flag"),
        F.unix_millis(F.add_months(month, 1).cast("timestamp")).alias("closes"),
    )
    kinds = dict(rows.dtypes)
    schema = ", ".join(["kind string", *[f"{c} {kinds[c]}" for c in ("month", *by)], "total long", "merged long"])
    return rows.groupBy("month", *by).transformWithStateInPandas(MonthCounts(["month", *by]), schema, "Append", "EventTime")


def corrections(df: DataFrame, key: Sequence[str], rank: str, ts: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """The first row of each key, and every row of a better rank that comes while the key is held, a delay after its time.

    Where one step brings several rows of a key only the best is given out. The last row of a key is its value. A stream
    keeps the number of buckets it began with.
    """
    kinds = dict(df.dtypes)
    # Whole numbers travel as text: pandas would make them floats where some are null.
    whole = [c for c in df.columns if c != rank and kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    names = F.to_json(F.struct(*key))
    rows = df.withWatermark(ts, delay).withColumns(
        {"id__": names, "until__": F.unix_millis(F.col(ts) + F.expr(f"INTERVAL {delay}"))}
    ).select(
        *[F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in df.columns if c != ts],
        F.expr(f"{ts} + INTERVAL 0 SECOND").alias(ts), "id__", "until__",
        F.pmod(F.xxhash64("id__"), F.lit(buckets)).alias("bucket__"),
    )
    schema = ", ".join(f"{c} {'string' if c in whole else kinds[c]}" for c in df.columns)
    out = rows.groupBy("bucket__").transformWithStateInPandas(Corrected(rank), schema, "Append", "EventTime")
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns])


def append_with_state(df: DataFrame, folder: str) -> DataFrame:
    """``append_to`` for state that needs the embedded store, which is set for this run."""
    conf = df.sparkSession.conf
    known = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return append_to(df, folder)
    finally:
        conf.unset(PROVIDER) if known is None else conf.set(PROVIDER, known)
