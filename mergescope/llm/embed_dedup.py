"""Embedding near-duplicates by sorted projection passes.

In every pass vectors are ordered by label and then lexicographically by concatenated random hyperplane hashes, so near
vectors of a label come to lie close together. Each vector is compared with its next neighbours in that order, and beyond
them with all that share its hash prefix, so a crowd of near vectors is searched in full. Verified pairs of all passes are
united. Equal vectors of a label are one row with a count, so copies are never compared with each other.

Passes are range-partitioned by the order itself: one label, however large, is spread over tasks. Pairs on two sides of a
task's edge are left to the other passes, whose orders differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergescope.llm.common import checkpointed, connected_components, shuffle_tasks

PASSES = 24
HASH_BITS = 48
PREFIX_BITS = 24
NEIGHBOURS = 256
COSINE = 0.93
BLOCK = 256
SEED = 42


def pass_keys(vectors: np.ndarray, passes: int) -> np.ndarray:
    """For each vector and pass the hash: one bit for the side of each random hyperplane, the first one highest."""
    planes = np.random.default_rng(SEED).standard_normal((passes * HASH_BITS, vectors.shape[1]))
    sides = (vectors @ planes.T >= 0).reshape(len(vectors), passes, HASH_BITS)
    return sides @ (np.int64(1) << np.arange(HASH_BITS, dtype=np.int64)[::-1])


def _keyed(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            keys: list[np.ndarray] = [np.empty(0)] * len(rows)
            for dim in {len(x) for x in rows}:
                at = [i for i, x in enumerate(rows) if len(x) == dim]
                for i, k in zip(at, pass_keys(np.array([rows[i] for i in at]), passes), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return run


def _compared(cosine: float, neighbours: int):
    """Rows (group, key, lead, copies, vector) sorted by group and key -> (a, b, copies_a, copies_b) of the pairs found."""

    def search(key, lead, copies, unit, out):
        n, prefix = len(key), key >> (HASH_BITS - PREFIX_BITS)
        run_end = np.searchsorted(prefix, prefix, side="right")
        reach = np.minimum(n, np.maximum(np.arange(n) + neighbours + 1, run_end))
        for at in range(0, n, BLOCK):
            to = min(n, at + BLOCK)
            far = int(reach[at:to].max())
            for start in range(at, far, 4 * BLOCK):
                end = min(far, start + 4 * BLOCK)
                found = unit[at:to] @ unit[start:end].T >= cosine
                i, j = np.nonzero(found)
                i, j = i + at, j + start
                good = (j > i) & (j < reach[i])
                out.append((lead[i[good]], lead[j[good]], copies[i[good]], copies[j[good]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            codes = held.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            if len(edges):
                yield _pairs(held.slice(0, int(edges[-1])))
                held = held.slice(int(edges[-1]))
        if held is not None and held.num_rows:
            yield _pairs(held)

    def _pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
        group = rows.column(0).to_numpy(zero_copy_only=False)
        key, lead, copies = (rows.column(i).to_numpy() for i in (1, 2, 3))
        starts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
        out: list[tuple] = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s > 1:
                part = rows.column(4).slice(s, e - s)
                vectors = np.asarray(part.flatten(), dtype=np.float64).reshape(e - s, -1)
                search(key[s:e], lead[s:e], copies[s:e], vectors / np.linalg.norm(vectors, axis=1)[:, None], out)
        a, b, m, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4
        swap = a > b
        a, b, m, n = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n, m), np.where(swap, m, n)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, m, n)], names=["a", "b", "copies_a", "copies_b"])

    return run


def embedding_groups(
    vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, neighbours: int = NEIGHBOURS, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors are linked if their labels are equal and not null and their cosine, in double precision, is at least
    `cosine`; n_links counts all linked vectors, copies too. Vectors that are null or empty, that hold null, infinite or
    undefined components, whose length is zero, or whose id or label is null are linked with nothing and are kept. Vectors
    of different lengths are never linked. Rows with equal ids count each for itself. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("v"))
    sound = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    )
    rows = checkpointed(rows.withColumn("sound", F.coalesce(sound, F.lit(False))))
    # Vectors are brought to unit size before any sum of squares, so very large or small components neither overflow nor vanish.
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    classes = checkpointed(
        rows.where("sound").groupBy("label", "v").agg(F.min("id").cast("long").alias("lead"), F.count("*").alias("copies"))
        .withColumn("scaled", F.transform("v", lambda c: c / largest))
    )
    keyed = classes.select("scaled", "label", "lead", "copies").mapInArrow(
        _keyed(passes), f"scaled array<double>, label {classes.schema['label'].dataType.simpleString()}, lead long, copies long, keys array<long>"
    )
    ordered = keyed.select(
        F.posexplode("keys").alias("pass", "key"), "label", F.size("scaled").alias("dim"), "lead", "copies", "scaled"
    ).select(F.xxhash64("label", "dim", "pass").alias("group"), "key", "lead", "copies", "scaled")
    pairs = (
        ordered.repartitionByRange(shuffle_tasks(spark), "group", "key", "lead").sortWithinPartitions("group", "key", "lead")
        .mapInArrow(_compared(cosine, neighbours), "a long, b long, copies_a long, copies_b long")
    )
    pairs = checkpointed(pairs.distinct())
    joined = connected_components(pairs)
    sides = F.array(F.struct(F.col("a").alias("lead"), F.col("copies_b").alias("n")), F.struct(F.col("b").alias("lead"), F.col("copies_a").alias("n")))
    linked = pairs.select(F.explode(sides).alias("x")).groupBy("x.lead").agg(F.sum("x.n").alias("others"))
    named = checkpointed(
        classes.drop("scaled").join(linked, "lead", "left").join(joined.withColumnRenamed("id", "lead"), "lead", "left").select(
            F.col("label").alias("l"), F.col("v").alias("w"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"),
            F.coalesce("component", "lead").alias("component"),
        )
    )
    good = rows.where("sound").join(named, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("id", "n", "component")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n"), F.col("id").cast("long").alias("component"))
    return good.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
