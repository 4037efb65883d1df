"""Vector compression by product codes, whose codebooks come from exact rounds of nearest entries with norm-of-sum bounds.

A vector is cut into parts, and each part is coded by the number of its nearest codebook entry. In every round all parts
are assigned and each entry becomes the mean of its parts. Most assignments don't change from round to round, so every
part keeps an upper bound of the distance to its own entry and, for each group of entries, a lower bound of the distance
to the group's other entries, each with the stamp of the round in which it was measured. The codebooks of all rounds are
retained: an entry's displacement since a stamp is the norm of its whole way, the true net displacement between two
codebooks, and not the sum of its steps, which is never less. Only where the bounds, moved by these displacements, cannot
tell the nearest entry is the own distance measured anew, and only if this isn't enough are the groups in doubt scanned.

All distances that decide are exact integers. Bounds are kept in 16-bit floats, rounded to the safe side, so a part's
state is a few bytes. Codebooks are the only thing that passes through the driver; their size is fixed by parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.session import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
GROUP = 16
#: Integer components are held to this size, so that squared distances of parts of up to 1,024 components fit 64 bits.
LARGEST = 1 << 25
BLOCK = 4096


@dataclass(frozen=True)
class Codebooks:
    """The entries of every part, as integers: one array of (entries, components) for each part."""

    parts: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Digest of all components in decimals, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(str(x) for p in self.parts for x in p.ravel().tolist()).encode()).hexdigest()


def scaled(vector: str, scale: int = SCALE) -> Column:
    """The components as integers, floor(scale * x); what is larger than LARGEST is held to it."""
    limit = float(LARGEST)
    return F.transform(
        F.col(vector).cast("array<double>"), lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c * scale))).cast("int")
    )


def sound(vector: str) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & good, F.lit(False))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, (rows, entries)."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * largest * largest * x.shape[1] < 1 << 53:  # doubles hold every sum exactly
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        step = x - entry
        out[:, j] = (step * step).sum(1)
    return out


def _below(x: np.ndarray) -> np.ndarray:
    """16-bit floats that are not above x."""
    y = np.minimum(x, 65504.0).astype(np.float16)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float16(-np.inf)), y)


def _above(x: np.ndarray) -> np.ndarray:
    """16-bit floats that are not below x."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float16)
    return np.where(y.astype(np.float64) < x, np.nextafter(y, np.float16(np.inf)), y)


class Displacements:
    """How far the entries of one part have come since each round, by the norm of the whole way."""

    def __init__(self, history: list[np.ndarray]):
        now = history[-1].astype(np.float64)
        # The norms are a little enlarged, for their own rounding.
        ways = [np.sqrt(((now - past) ** 2).sum(1)) * (1 + 1e-9) for past in history]
        self.entry = np.array(ways)
        edges = range(0, len(now), GROUP)
        self.group = np.array([[way[g : g + GROUP].max() for g in edges] for way in ways])


def assigned(x: np.ndarray, history: list[np.ndarray], state: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple, int]:
    """(nearest entries, exact squared distances, state, scanned distances) of one part's rows for the last codebook.

    state: (codes, upper bounds, their stamps, lower bounds of groups, their stamps), or None at the first time. Equal
    distances go to the lower entry.
    """
    entries, now, n = history[-1].astype(np.int64), len(history) - 1, len(x)
    groups = [np.arange(g, min(g + GROUP, len(entries))) for g in range(0, len(entries), GROUP)]
    if state is None:
        codes = np.zeros(n, np.int64)
        lower = np.full((n, len(groups)), -1.0)
        stamps = np.full((n, len(groups)), now, np.int8)
        upper, upper_stamp = np.full(n, np.inf, np.float16), np.full(n, now, np.int8)
    else:
        codes, upper, upper_stamp, lower, stamps = state
        codes, lower, stamps = codes.astype(np.int64), lower.astype(np.float64), stamps.copy()
        upper, upper_stamp = upper.copy(), upper_stamp.copy()
    far = Displacements(history)
    moved = lower - far.group[stamps, np.arange(len(groups))]
    # First test, with the upper bound moved by its entry's net displacement; then with the distance measured anew.
    doubtful = np.flatnonzero(upper.astype(np.float64) + far.entry[upper_stamp, codes] >= moved.min(1))
    own = np.empty(n, np.int64)
    step = x - entries[codes]
    own[:] = (step * step).sum(1)  # also the error that a caller may ask for
    root = np.sqrt(own[doubtful].astype(np.float64)) * (1 + 1e-9)
    upper[doubtful], upper_stamp[doubtful] = _above(root), now
    wanted = root[:, None] >= moved[doubtful]
    scanned = 0
    best, nearest = own[doubtful].copy(), codes[doubtful].copy()
    first = np.full(wanted.shape, np.iinfo(np.int64).max)
    second, leader = first.copy(), np.full(wanted.shape, -1, np.int64)
    for g, members in enumerate(groups):
        rows = np.flatnonzero(wanted[:, g])
        if not len(rows):
            continue
        d = _distances(x[doubtful[rows]], entries[members])
        scanned += d.size
        at = d.argmin(1)
        low = d[np.arange(len(rows)), at]
        first[rows, g], leader[rows, g] = low, members[at]
        if len(members) > 1:
            second[rows, g] = np.partition(d, 1, axis=1)[:, 1]
        better = (low < best[rows]) | ((low == best[rows]) & (members[at] < nearest[rows]))
        best[rows[better]], nearest[rows[better]] = low[better], members[at[better]]
    # A scanned group's bound leaves out the part's own entry. A group that lost its entry unscanned takes the entry in.
    rest = np.sqrt(np.where(leader == nearest[:, None], second, first).astype(np.float64)) * (1 - 1e-9)
    kept, kept_stamps = lower[doubtful], stamps[doubtful]
    kept[wanted], kept_stamps[wanted] = rest[wanted], now
    lost = np.flatnonzero(nearest != codes[doubtful])
    home = codes[doubtful[lost]] // GROUP
    open_ = ~wanted[lost, home]
    lost, home = lost[open_], home[open_]
    kept[lost, home] = np.minimum(moved[doubtful[lost], home], root[lost] * (1 - 1e-8))
    kept_stamps[lost, home] = now
    lower[doubtful], stamps[doubtful] = kept, kept_stamps
    changed = nearest != codes[doubtful]
    codes[doubtful], own[doubtful] = nearest, best
    upper[doubtful[changed]] = _above(np.sqrt(best[changed].astype(np.float64)) * (1 + 1e-9))
    return codes, own, (codes, upper, upper_stamp, _below(lower), stamps), scanned


STATE = ("codes", "upper", "upper_stamps", "lower", "stamps")


def _rounds(parts: int, history: list[Codebooks], last: bool):
    """Rows (id, label, v[, state]) -> the rows with their new state, or at last with codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(at, BLOCK))

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        x = np.asarray(rows.column("v").flatten()).astype(np.int64).reshape(n, parts, -1)
        found, errors, states = [], np.zeros(n, np.int64), []
        old = {c: [b.as_py() for b in rows.column(c)] for c in STATE} if STATE[0] in rows.schema.names else None
        kinds = (np.int16, np.float16, np.int8, np.float16, np.int8)
        if old:
            held = [np.frombuffer(b"".join(old[c]), k).reshape(n, parts, -1) for c, k in zip(STATE, kinds, strict=True)]
        for p in range(parts):
            state = tuple(h[:, p, 0] if i < 3 else h[:, p] for i, h in enumerate(held)) if old else None
            codes, own, state, _ = assigned(x[:, p], [h.parts[p] for h in history], state)
            found.append(codes)
            errors += own
            states.append(state)
        if last:
            code = ["".join(f"{c:02x}" for c in row) for row in np.array(found).T.tolist()]
            columns = {"code": pa.array(code, pa.string()), "error": pa.array(errors)}
            return pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), *columns.values()], names=["id", "label", *columns])
        columns = {}
        for i, (name, kind) in enumerate(zip(STATE, kinds, strict=True)):
            joined = np.ascontiguousarray(np.stack([s[i] for s in states], 1).astype(kind)).reshape(n, -1)
            columns[name] = pa.array([row.tobytes() for row in joined], pa.binary())
        arrays = [rows.column("id"), rows.column("label"), rows.column("v"), *columns.values()]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "label", "v", *columns])

    return run


def _sums(parts: int, entries: int):
    """Rows (v, codes) -> (part, entry, position, sum) of this task; position -1 counts the parts of an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column(0).flatten()).astype(np.int64).reshape(n, parts, -1)
            codes = np.frombuffer(b"".join(b.as_py() for b in batch.column(1)), np.int16).reshape(n, parts)
            if total is None:
                total = np.zeros((parts, entries, x.shape[2] + 1), np.int64)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                met, starts, counts = np.unique(codes[order, p], return_index=True, return_counts=True)
                total[p, met, 1:] += np.add.reduceat(x[order, p], starts, axis=0)
                total[p, met, 0] += counts
        if total is not None:
            part, entry = np.nonzero(total[:, :, 0])
            width = total.shape[2]
            arrays = (np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(-1, width - 1), len(part)), total[part, entry].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["part", "entry", "position", "total"])

    return run


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """((id, label, code, error) of every coded vector, codebooks): product codes after a number of exact rounds.

    The codebooks start as the parts of the vectors of the smallest ids, nulls last, equal ids by their vectors; they have
    fewer entries where there are fewer vectors. `code` holds two hex digits for each part, so there are at most 256
    entries. Left out are rows whose vector is null or empty or holds null or non-finite components, and those whose number
    of components isn't that of the vector of the smallest id or can't be cut into equal parts. Components beyond
    LARGEST / scale count as that large. Every row counts, also repeated ones. Null ids and labels stay as they are; other
    columns are ignored. An empty table gives no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes of two hex digits number at most 256 entries")
    rows = vectors.where(sound(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(vector_col, scale).alias("v"))
    rows = rows.where(F.size("v") % parts == 0)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("n")).collect()
    size = first[0].n if first else parts
    rows = stored(rows.where(F.size("v") == size), "vectors")
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in start], np.int64).reshape(len(start), parts, size // parts)
    history = [Codebooks(tuple(books[:, p] for p in range(parts)))]
    state = rows
    kinds = dict(rows.dtypes)
    head = f"id {kinds['id']}, label {kinds['label']}"
    if not start:
        return state.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), history[0]
    for _ in range(rounds):
        held = ", ".join(f"{c} binary" for c in STATE)
        state = stored(state.mapInArrow(_rounds(parts, history, last=False), f"{head}, v array<int>, {held}"), "assigned")
        totals = (
            state.select("v", "codes").mapInArrow(_sums(parts, len(start)), "part long, entry long, position long, total long")
            .groupBy("part", "entry", "position").agg(F.sum("total").alias("total"))
        )
        history.append(_moved(history[-1], totals.collect()))
    coded = state.mapInArrow(_rounds(parts, history, last=True), f"{head}, code string, error long")
    return coded, history[-1]


def _moved(books: Codebooks, totals: list) -> Codebooks:
    """The next codebooks: floors of the means; unused entries stay. `totals` has one row for each component and count."""
    width = books.parts[0].shape[1]
    sums = np.zeros((len(books.parts), len(books.parts[0]), width + 1), np.int64)
    for r in totals:
        sums[r.part, r.entry, r.position + 1] = r.total
    new = [np.where(s[:, :1] > 0, s[:, 1:] // np.maximum(s[:, :1], 1), old) for s, old in zip(sums, books.parts, strict=True)]
    return Codebooks(tuple(new))


def restored(coded: DataFrame, books: Codebooks, scale: int = SCALE, id_col: str = "id") -> DataFrame:
    """(id, vector array<double>): what the codes stand for; a null code gives a null vector."""
    spark = coded.sparkSession
    held = spark.sparkContext.broadcast([p.astype(np.float64) / scale for p in books.parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for code in batch.column(1):
                code = code.as_py()
                pieces = None if code is None else [p[c] for p, c in zip(held.value, bytes.fromhex(code), strict=True)]
                found.append(None if pieces is None else np.concatenate(pieces).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["id", "vector"])

    rows = coded.select(F.col(id_col).alias("id"), "code")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>").withColumnRenamed("id", id_col)


def op11_vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every coded vector; see `compressed`.

    The sum of each label's errors is stored before rows meet it, so both sides of that join are plain shuffles, which
    adaptive execution splits where one label holds much of the table. Null labels count as one label.
    """
    coded, books = compressed(vectors)
    kind = dict(coded.dtypes)["label"]
    key = F.struct(F.col("label").isNull().alias("missing"), F.coalesce("label", F.lit(0).cast(kind)).alias("label"))
    keyed = stored(coded.withColumn("key", key), "codes")
    sums = stored(keyed.groupBy("key").agg(F.sum("error").alias("label_error")), "errors")
    return keyed.join(sums, "key").select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
