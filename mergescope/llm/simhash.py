"""SimHash near-duplicates by deletion variants.

A fingerprint of 64 bits is cut into so few segments that, of two fingerprints within the distance asked for, one segment
differs by at most one bit: 2 segments for up to 3 bits, 3 for up to 5. Every fingerprint is indexed by each segment with
each of its bits deleted, so near fingerprints share an index key; those that share one are compared in full.

Documents with one fingerprint are a class and travel as one row. A key that very many fingerprints share is dealt out
again by deletion variants of the remaining bits, so no group of copies ends in one task.

Where a Jaccard similarity is asked for, fingerprints are too coarse to find it: at 0.8 they differ by 9.7 of 64 bits on
average. Then MinHash bands of the different shingles retrieve pairs, the fingerprints' distance is a loose test, and the
shingles themselves decide. Every document is first compared with the leading one of each of its bands; what that leaves
in different components, but in one band, is compared pair by pair, so no candidate stays unchecked.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.llm.common import checkpointed, connected_components, shuffle_tasks
from mergescope.llm.line_dedup import banded, minhashes, similarity
from mergescope.session import stored

BITS = 64
SEED = 42
SHARED_BY_MANY = 2048
SHINGLES_AT_ONCE = 1 << 16
#: MinHash bands: documents of Jaccard similarity 0.8 share one with probability 0.9996, those of 0.4 with 0.19.
BANDS, ROWS = 20, 5
#: bits_of_byte[v] are the eight bits of the byte v, lowest first.
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles_of(text: str | None, words: int) -> list[bytes]:
    """The shingles of a text, that of a short one is the text; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    return list(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))


def fingerprint(text: str | None, words: int, tables: int) -> list[int]:
    """`tables` fingerprints of a text as signed 64-bit numbers; zero for a text without words.

    A bit is 1 where more than half of the shingles' hashes have it. Further tables hash with other seeds.
    """
    return fingerprint_of(shingles_of(text, words), tables)


def fingerprint_of(shingles: Collection[bytes], tables: int) -> list[int]:
    shingles = list(shingles)
    if not shingles:
        return [0] * tables
    out = []
    for k in range(tables):
        counts = np.zeros((8, 256), dtype=np.int64)
        for at in range(0, len(shingles), SHINGLES_AT_ONCE):
            hashes = np.array([xxhash.xxh64_intdigest(s, SEED + k) for s in shingles[at : at + SHINGLES_AT_ONCE]], dtype="<u8")
            cells = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
            counts += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
        ones = (counts @ BITS_OF_BYTE).ravel()
        out.append(int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 3, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fps array<long>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t, words, tables) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fps"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fps array<long>")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _pieces(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def _deletions(bits: list[int], n: int) -> list[int]:
    """For n pieces of the given bits and each bit: the mask of the bit's piece without it."""
    return [_signed(sum(1 << b for b in piece) & ~(1 << gone)) for piece in _pieces(bits, n) for gone in piece]


def _masks(masks: list[int]) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in masks])


class NearRuns:
    """Links inside runs of rows with one key, from rows that come sorted by key.

    In every run each member is compared with those not yet reached, so a run of near copies costs little more than one
    pass, and the links kept are a forest with the same components as all links of the run.
    """

    def __init__(self, distance: int, total: int | None, tables: int):
        self.distance, self.total, self.tables = distance, total, tables

    def _linked(self, one: np.ndarray, many: np.ndarray, own: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(many ^ one)
        close = apart[np.arange(len(many)), own] <= self.distance
        return close & (apart.sum(axis=1) <= self.total) if self.total is not None else close

    def run(self, fps: np.ndarray, own: np.ndarray, leads: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.arange(len(fps))
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                close = self._linked(fps[at], fps[left], own[left])
                for other in left[close].tolist():
                    yield leads[at], leads[other]
                    queue.append(other)
                left = left[~close]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            now = (
                np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1),
                batch.column(2).to_numpy(),
                batch.column(3).to_numpy(),
                np.asarray(batch.column(4).flatten()).astype(np.int64).view(np.uint64).reshape(-1, self.tables),
            )
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            last = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0
            yield from self._found(*(x[:whole] for x in held))
            held = tuple(x[whole:] for x in held)
        if held is not None:
            yield from self._found(*held)

    def _found(self, keys: np.ndarray, own: np.ndarray, leads: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(keys)]
        pairs = starts[ends - starts == 2]
        apart = np.bitwise_count(fps[pairs] ^ fps[pairs + 1])
        close = apart[np.arange(len(pairs)), own[pairs]] <= self.distance
        if self.total is not None:
            close &= apart.sum(axis=1) <= self.total
        a, b = leads[pairs[close]].tolist(), leads[pairs[close] + 1].tolist()
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            for x, y in self.run(fps[s:e], own[s:e], leads[s:e]):
                a.append(x)
                b.append(y)
        found = {(min(p), max(p)) for p in zip(a, b, strict=True)}
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(
    classes: DataFrame, distance: int, tables: int = 1, total: int | None = None, many: int = SHARED_BY_MANY
) -> DataFrame:
    """(a, b): leads of classes that are linked, enough of them for the components of all links.

    classes: (fps, lead), one row for each different list of fingerprints. Two are linked if in one table they differ by
    at most `distance` bits and, where `total` is given, in all tables together by at most that.
    """
    segments = distance // 2 + 1
    bits = list(range(BITS))
    variants = classes.select("fps", "lead", F.posexplode("fps").alias("own", "fp")).select(
        "fps", "lead", F.col("own").cast("long").alias("own"), "fp", F.posexplode(_masks(_deletions(bits, segments))).alias("i", "mask")
    ).select(
        F.xxhash64("own", "i", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "i", "fp", "own", "lead", "fps"
    )
    cold = variants.withColumn("sub", F.lit(0).cast("long"))
    shared = checkpointed(variants.groupBy("key").count().where(F.col("count") > many).select("key", F.lit(True).alias("hot")))
    if not shared.isEmpty():
        # The rest of the bits differs by no more than `distance`, so it is cut and indexed in the same way.
        rest = [_masks(_deletions([b for b in bits if b not in piece], segments)) for piece in _pieces(bits, segments) for _ in piece]
        marked = variants.join(shared, "key", "left")
        cold = marked.where("hot IS NULL").drop("hot").withColumn("sub", F.lit(0).cast("long"))
        hot = marked.where("hot").select(
            "key", "fp", "own", "lead", "fps", "i", F.posexplode(F.element_at(F.array(*rest), F.col("i") + 1)).alias("j", "mask")
        ).withColumn("sub", F.xxhash64("j", F.col("fp").bitwiseAND(F.col("mask"))))
        cold = cold.select("key", "sub", "own", "lead", "fps").unionByName(hot.select("key", "sub", "own", "lead", "fps"))
    dealt = cold.select("key", "sub", "own", "lead", "fps").repartition(shuffle_tasks(classes.sparkSession), "key", "sub")
    return dealt.sortWithinPartitions("key", "sub").mapInArrow(lambda batches: NearRuns(distance, total, tables)(batches), "a long, b long")


def set_hash(shingles: frozenset[bytes]) -> int:
    """One signed 64-bit number for a set of shingles."""
    return _signed(xxhash.xxh3_64_intdigest(b"\n".join(sorted(shingles))))


def set_bands(sets: list[frozenset[bytes]]) -> np.ndarray:
    """The band keys of sets that are not empty, a row for each."""
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for own in sets for s in own], dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    return banded(minhashes(hashes, owner, len(sets), BANDS * ROWS), BANDS, ROWS).view(np.int64)


def sketches(docs: DataFrame, words: int, tables: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fps, shape, bands) for every row, all of the text's different shingles; shape is their hash."""

    def portions(texts: list[str | None]) -> Iterator[list[frozenset[bytes]]]:
        sets, n = [], 0
        for text in texts:
            sets.append(frozenset(shingles_of(text, words)))
            n += len(sets[-1])
            if n >= SHINGLES_AT_ONCE:
                yield sets
                sets, n = [], 0
        yield sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, shapes, bands = [], [], []
            for sets in portions(batch.column(1).to_pylist()):
                fps += [fingerprint_of(own, tables) for own in sets]
                shapes += [set_hash(own) for own in sets]
                full = [own for own in sets if own]
                keys = iter(set_bands(full) if full else ())
                bands += [next(keys) if own else [] for own in sets]
            arrays = pa.array(fps, pa.list_(pa.int64())), pa.array(shapes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "fps", "shape", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fps array<long>, shape long, bands array<long>")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, jaccard: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of shapes whose texts' shingles are at least that similar."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a row of the same id may hold another text
            own = [set_hash(frozenset(shingles_of(t, words))) == s for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(own, pa.bool_()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shingles = None, frozenset()
        for batch in batches:
            close = []
            for a, one, other in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if a != last:
                    last, shingles = a, frozenset(shingles_of(one, words))
                close.append(similarity(shingles, frozenset(shingles_of(other, words))) >= jaccard)
            yield batch.select([0, 1]).filter(pa.array(close, pa.bool_()))

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("shape")).distinct().join(classes.select("shape", "lead"), "shape")
    rows = docs.select(F.col(id_col).cast("long").alias("lead"), F.col(text_col).cast("string").alias("text"))
    texts = checkpointed(rows.join(nodes, "lead").select("shape", "text").mapInArrow(named, "shape long, text string").dropDuplicates(["shape"]))
    both = pairs.join(texts.toDF("b", "other"), "b").join(texts.toDF("a", "one"), "a").select("a", "b", "one", "other")
    return checkpointed(both.mapInArrow(near, "a long, b long"))


def jaccard_components(
    classes: DataFrame, docs: DataFrame, words: int, jaccard: float, total: int | None, id_col: str, text_col: str
) -> DataFrame:
    """(shape, node) for shapes with links: the components of the pairs that share a band and are that similar."""

    def loosely(rows: DataFrame) -> DataFrame:
        apart = F.aggregate(F.zip_with("fps_a", "fps_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        return rows if total is None else rows.where(apart <= total)

    def of(pairs: DataFrame) -> DataFrame:
        return verified(pairs, classes, docs, words, jaccard, id_col, text_col)

    entries = checkpointed(classes.select(F.explode("bands").alias("key"), "shape", "fps"))
    leading = entries.groupBy("key").agg(F.min(F.struct("shape", "fps")).alias("x"), F.count("*").alias("n")).where("n > 1")
    leading = leading.select("key", F.col("x.shape").alias("a"), F.col("x.fps").alias("fps_a"))
    spokes = entries.join(leading, "key").where("shape != a").select("a", F.col("shape").alias("b"), "fps_a", F.col("fps").alias("fps_b"))
    tested = checkpointed(loosely(spokes).select("a", "b").distinct())
    found = of(tested)
    joined = checkpointed(connected_components(found).select(F.col("id").alias("shape"), "component"))
    parts = checkpointed(entries.join(joined, "shape", "left").withColumn("component", F.coalesce("component", "shape")))
    mixed_keys = parts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    parts = checkpointed(parts.join(mixed_keys.select("key"), "key", "left_semi"))
    one, other = parts.toDF("shape_a", "key", "fps_a", "part_a"), parts.toDF("shape_b", "key", "fps_b", "part_b")
    across = loosely(one.join(other, "key").where("shape_a < shape_b AND part_a != part_b"))
    across = across.select(F.col("shape_a").alias("a"), F.col("shape_b").alias("b")).distinct()
    # Written and read again: the union's plan would be carried through every round, and grow.
    found = stored(found.unionByName(of(checkpointed(across.join(tested, ["a", "b"], "left_anti")))), "near-copies")
    return connected_components(found).select(F.col("id").alias("shape"), F.col("component").alias("node"))


def simhash_groups(
    docs: DataFrame, words: int = 3, distance: int = 2, tables: int = 1, total: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", jaccard: float | None = None,
) -> DataFrame:
    """(id, fingerprint, component_id): one row for each row of the documents.

    fingerprint: that of the first table, 16 hexadecimal digits. component_id: the smallest id reachable over links.
    ids are whole numbers. A null or empty text has fingerprint zero and is linked like any other; rows with a null id
    take part in their class and show its component; rows with equal ids each get a row; other columns are ignored; an
    empty table gives no rows.

    With `jaccard` two texts are linked if their different shingles are at least that similar and, where `total` is given,
    the fingerprints of these differ by at most that; `distance` has no meaning then, and texts without words are linked
    with each other only.
    """
    if jaccard is not None:
        marked = checkpointed(sketches(docs, words, tables, id_col, text_col))
        classes = checkpointed(marked.groupBy("shape").agg(F.min("id").alias("lead"), F.first("fps").alias("fps"), F.first("bands").alias("bands")))
        nodes = jaccard_components(classes.where("lead IS NOT NULL"), docs, words, jaccard, total, id_col, text_col)
        placed = checkpointed(classes.select("shape", "lead").join(nodes, "shape", "left").withColumn("node", F.coalesce("node", "shape")))
        named = placed.join(placed.groupBy("node").agg(F.min("lead").alias("component_id")), "node").select("shape", "component_id")
        return marked.join(checkpointed(named), "shape").select(
            F.col("id").alias(id_col), F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id"
        )
    marked = checkpointed(fingerprints(docs, words, tables, id_col, text_col).withColumn("id", F.col("id").cast("long")))
    classes = checkpointed(marked.groupBy("fps").agg(F.min("id").alias("lead")))
    joined = connected_components(links(classes.where("lead IS NOT NULL"), distance, tables, total))
    named = checkpointed(
        classes.join(joined.withColumnRenamed("id", "lead"), "lead", "left")
        .select("fps", F.coalesce("component", "lead").alias("component_id"))
    )
    return marked.join(named, "fps").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The documents with one of each group left, that of the smallest id, with the columns they came with.

    Rows that share an id stay or go together, and stay if one of them does; rows with a null id stay.
    """
    kept = simhash_groups(docs, id_col=id_col, text_col=text_col, **how).where(f"`{id_col}` = component_id")
    kept = checkpointed(kept.select(F.col(id_col).alias("_kept_id")).distinct())
    named = docs.withColumn("_row_id", F.col(id_col).cast("long"))
    stay = named.where("_row_id IS NOT NULL").join(kept, F.col("_row_id") == F.col("_kept_id"), "left_semi")
    return stay.unionByName(named.where("_row_id IS NULL")).drop("_row_id")
