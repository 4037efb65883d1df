"""Hard negatives by a secondary-sort shuffle.

Anchors meet all rows in a grid: anchors and rows are dealt into blocks, and a cell of the grid scores one block of anchors
against a stream of one block of rows. Of what a cell scores only that goes on which can still count: for every anchor the
cell's best positives, and, once the positives of all cells are known, for each positive's window the cell's best negatives
in it. What goes on are pairs keyed by (anchor, descending score, id); they are dealt out by anchor and sorted by that key
inside their partitions. An iterator then reads an anchor's pairs from the best score down: each positive opens the window
of scores below it, each negative is given out to the open windows it fits, and a window that is full closes. It holds one
anchor's few open windows and nothing else.

Scores are exact integers. Blocks only say where work is done: what a block lets pass is a superset of what counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergescope.llm.common import shuffle_tasks
from mergescope.llm.vector_codes import scaled, sound
from mergescope.session import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score is at least LOW and at most HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
ANCHOR_BLOCK = 16_384
ROW_BLOCK = 131_072
TILE = 1024
LEAST = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


class Best:
    """For each of a number of slots the k best (score, id) offered: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.score = np.full((slots, k), LEAST)
        self.id = np.full((slots, k), MOST)

    def better(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which offers come before the last one held; (slots, n) scores of n ids."""
        last, number = self.score[slots, -1][:, None], self.id[slots, -1][:, None]
        return (score > last) | ((score == last) & (ids[None, :] < number))

    def offer(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        met = np.unique(slots)
        k = self.score.shape[1]
        slots = np.r_[slots, np.repeat(met, k)]
        score, ids = np.r_[score, self.score[met].ravel()], np.r_[ids, self.id[met].ravel()]
        order = np.lexsort((ids, ~score, slots))  # ~score falls as score rises, and has no overflow
        slots, score, ids = slots[order], score[order], ids[order]
        rank = np.arange(len(slots)) - np.searchsorted(slots, slots)
        kept = rank < k
        self.score[slots[kept], rank[kept]], self.id[slots[kept], rank[kept]] = score[kept], ids[kept]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots, at = np.nonzero(self.id != MOST)
        return slots, self.score[slots, at], self.id[slots, at]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows."""
    if a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.stack([(b * row).sum(1) for row in a]) if len(a) else np.empty((0, len(b)), np.int64)


class Cell:
    """One block of anchors, offered the rows of one block piece by piece."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: np.ndarray | None, keep: int):
        self.ids, self.labels, self.vectors, self.windows = ids, labels, vectors, windows
        self.slots = 1 if windows is None else windows.shape[1]
        self.best = Best(len(ids) * self.slots, keep)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(self.ids), TILE):
            tile = np.arange(at, min(at + TILE, len(self.ids)))
            score = products(self.vectors[tile], vectors)
            same = self.labels[tile][:, None] == labels[None, :]
            if self.windows is None:
                self._offer(tile, score, ids, same & (self.ids[tile][:, None] != ids[None, :]))
                continue
            for w in range(self.slots):
                low, high = self.windows[tile, w, 0][:, None], self.windows[tile, w, 1][:, None]
                self._offer(tile * self.slots + w, score, ids, ~same & (score >= low) & (score <= high))

    def _offer(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        row, at = np.nonzero(fits & self.best.better(slots, score, ids))
        if len(row):
            self.best.offer(slots[row], score[row, at], ids[at])

    def found(self) -> pa.RecordBatch:
        slots, score, ids = self.best.held()
        pairs = np.unique(np.stack([self.ids[slots // self.slots], score, ids]), axis=1) if len(slots) else np.empty((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["anchor", "score", "id"])


def _cells(keep: int, windowed: bool):
    """Rows (at, length, row, id, label, v, windows), sorted by the first four -> the best pairs of every cell.

    A cell is a place in the grid and one length of vectors; its anchors come before its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, number, waiting = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                if (here := tuple(keys[:2, s].tolist())) != number:
                    if cell is not None:
                        yield cell.found()
                    cell, number, waiting = None, here, []
                part = batch.slice(s, e - s)
                if not keys[2, s]:
                    waiting.append(part)
                elif waiting or cell is not None:
                    if cell is None:
                        anchors = pa.Table.from_batches(waiting).combine_chunks()
                        windows = np.array(anchors.column("windows").to_pylist(), np.int64).reshape(len(anchors), -1, 2) if windowed else None
                        cell, waiting = Cell(*_arrays(anchors), windows, keep), []
                    ids, labels, vectors = _arrays(pa.Table.from_batches([part]).combine_chunks())
                    for at in range(0, len(ids), TILE):
                        cell.meet(ids[at : at + TILE], labels[at : at + TILE], vectors[at : at + TILE])
        if cell is not None:
            yield cell.found()

    def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = np.asarray(rows.column("v").combine_chunks().flatten()).astype(np.int64).reshape(len(rows), -1)
        return rows.column("id").to_numpy(), rows.column("label").to_numpy(), vectors

    return run


def _met(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], keep: int) -> DataFrame:
    """(anchor, score, id) that the cells of the grid let pass; anchors may have windows, else positives are sought."""
    across, down = grid
    windowed = "windows" in anchors.columns
    windows = F.col("windows") if windowed else F.lit(None).cast("array<struct<low:long,high:long>>")
    length = F.size("v").alias("length")
    left = anchors.select("*", length).select(
        F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"), F.pmod(F.xxhash64("id"), F.lit(across)).alias("across"),
        "length", F.lit(False).alias("row"), "id", "label", "v", F.flatten(F.transform(windows, lambda w: F.array(w.low, w.high))).alias("windows"),
    )
    right = rows.select("*", length).select(
        F.pmod(F.xxhash64("id"), F.lit(down)).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"),
        "length", F.lit(True).alias("row"), "id", "label", "v", F.lit(None).cast("array<long>").alias("windows"),
    )
    dealt = left.unionByName(right).withColumn("at", (F.col("across") * down + F.col("down")).cast("long"))
    tasks = min(across * down, 64 * max(down, shuffle_tasks(rows.sparkSession)))
    return (
        dealt.repartitionById(tasks, F.pmod("at", F.lit(tasks)).cast("int")).sortWithinPartitions("at", "length", "row", "id")
        .select("at", "length", "row", "id", "label", "v", "windows").mapInArrow(_cells(keep, windowed), "anchor long, score long, id long")
    )


def _mined(low: int, high: int, negatives: int):
    """Pairs of anchors in descending order of score -> the negatives of every positive; see the module's first lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for number, score, kind, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != anchor:
                    anchor, windows = number, []
                if kind == 0:
                    windows.append([other, score, 0])
                    continue
                for window in windows:
                    positive, best, given = window
                    if low * best <= 100 * score <= high * best:
                        window[2] = given + 1
                        out.append((anchor, positive, given + 1, other, best, score))
                windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' hard negatives.

    Anchors are the rows whose id is divisible by `every`. An anchor's positives are its first other rows of the same label,
    its negatives those of other labels whose score is within the window of a positive; higher scores come first, then
    smaller ids. No part take rows whose id, label or vector is null, whose vector is empty or holds null or non-finite
    components; vectors of different lengths never meet. An id names one vector: of rows that repeat an id, that with the
    smallest label and then vector counts. Components beyond 2^25 / scale count as that large. A positive without a negative
    in its window gives no row, so do anchors without positives and an empty table. Other columns are ignored.
    """
    sane = vectors.where(sound(vector_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = sane.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(vector_col, scale).alias("v"))
    rows = stored(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "rows")
    anchors = rows.where(F.col("id") % every == 0)
    many, few = (df.count() for df in (rows, anchors))
    across = max(1, -(-few // ANCHOR_BLOCK))
    down = max(1, -(-many // ROW_BLOCK), -(-shuffle_tasks(rows.sparkSession) // across))
    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    first = (
        _met(anchors, rows, (across, down), positives)
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives).select("anchor", "score", "id")
    )
    first = stored(first, "positives")
    # The whole scores n with low * p <= 100 * n <= high * p, worked out so that large scores don't overflow.
    share = "(score div 100) * {0}L + ((score % 100) * {0}L + {1}) div 100"
    whole = F.struct(F.expr(share.format(low, 99)).alias("low"), F.expr(share.format(high, 0)).alias("high"))
    opened = first.where("score >= 0").groupBy("anchor").agg(F.collect_list(whole).alias("w"))
    shut = F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    windows = F.slice(F.concat("w", F.array_repeat(shut, positives)), 1, positives)
    seeking = anchors.join(opened.select(F.col("anchor").alias("id"), windows.alias("windows")), "id")
    others = _met(seeking, rows, (across, down), negatives)
    # Positives before negatives of the same score: a score of zero opens a window that holds zero.
    pairs = first.withColumn("kind", F.lit(0)).unionByName(others.withColumn("kind", F.lit(1)))
    return (
        pairs.select("anchor", "score", "kind", "id").repartition(shuffle_tasks(rows.sparkSession), "anchor")
        .sortWithinPartitions("anchor", F.desc("score"), "kind", "id")
        .mapInArrow(_mined(low, high, negatives), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    )


def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    """`hard_negatives` with the labels of rows whose id is divisible by seven moved on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")))
