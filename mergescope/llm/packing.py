"""Packing of documents into token sequences, best fit decreasing.

Documents are tokenized where they are read; those longer than a sequence are first cut into full windows. Pieces are
dealt out over buckets by a hash of their id, and each bucket is packed in order of falling length. A segment tree over
the remaining capacities of the open windows finds the tightest one that takes a piece. A bucket keeps its open windows
only, so it can be of any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mergescope.llm.common import shuffle_tasks, spread
from mergescope.llm.tokens import SharedTokenizer

SEQUENCE = 2048
DOCUMENT_END = 1
DOCS_PER_BUCKET = 20_000
SOURCE_BATCH = 512


class CapacityTree:
    """Open windows by what they can still take: a segment tree whose leaves are capacities.

    A node is true where a window below it is open; the tightest fit is the first true leaf at or after the length
    asked for, found by one climb and one descent.
    """

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list] = [[] for _ in range(most + 1)]

    def _mark(self, capacity: int, on: int) -> None:
        node = capacity + self.leaves
        self.any[node] = on
        node >>= 1
        while node:
            now = self.any[2 * node] | self.any[2 * node + 1]
            if self.any[node] == now:
                return
            self.any[node] = now
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if not self.open[capacity]:
            self._mark(capacity, 1)
        self.open[capacity].append(window)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the open window with the least capacity of at least `length`: (capacity, window)."""
        node = length + self.leaves
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self._mark(capacity, 0)
        return capacity, window


class Packer:
    """Places pieces one by one; they must come in order of falling length."""

    def __init__(self, size: int):
        self.size = size
        self.tree = CapacityTree(size)
        self.windows = 0

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece."""
        found = self.tree.tightest(length)
        if found is None:
            found = self.size, self.windows
            self.windows += 1
        capacity, window = found
        if capacity > length:
            self.tree.put(capacity - length, window)
        return window, self.size - capacity


def token_pieces(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE,
    keep_ids: bool = True,
) -> DataFrame:
    """(id, start, length, doc_tokens, ids_crc32[, ids]): the documents' tokens, cut into pieces of at most `size`.

    A null text counts as empty; every document ends with one more token, so an empty one has that alone. ids are
    unsigned 32-bit little-endian numbers. `tokenizer_json` is the vocabulary's content, sent to the executors once.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(SharedTokenizer(tokenizer_json))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.value.get()
        end = np.array([DOCUMENT_END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SOURCE_BATCH):
                part = batch.slice(at, SOURCE_BATCH)
                names, rows = part.column(0), []
                for row, ids in enumerate(encode.all(part.column(1).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        rows.append((row, start, len(piece) // 4, total, zlib.crc32(piece), piece if keep_ids else b""))
                row, start, length, total, crc, piece = zip(*rows, strict=True)
                out = [names.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, total, crc))]
                fields = ["id", "start", "length", "doc_tokens", "ids_crc32"]
                if keep_ids:
                    out, fields = [*out, pa.array(piece, pa.binary())], [*fields, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=fields)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, doc_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def packed(pieces: DataFrame, buckets: int, keys: Sequence[str] = ("doc_id", "start"), size: int = SEQUENCE) -> DataFrame:
    """The pieces with their place: sequence_id and offset. Every piece needs a `length` of 1 to `size`.

    Rows are dealt out by a hash of all `keys`, so no document or source lands in one bucket, and a repeated attempt at
    a bucket gives the same sequences. A sequence's number is its bucket's, times 2^32, and its own in the bucket.
    """
    if clash := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"columns {sorted(clash)} exist")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(size), TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            window, offset = zip(*map(packer.place, lengths), strict=True) if lengths else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + w for w in window], pa.int64()), pa.array(offset, pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    schema = StructType([*pieces.schema.fields, *(StructField(n, LongType()) for n in ("sequence_id", "offset"))])
    dealt = pieces.repartition(buckets, spread(*keys))
    return dealt.sortWithinPartitions(F.desc("length"), *keys).mapInArrow(place, schema)


def bucket_count(docs: DataFrame, docs_per_bucket: int = DOCS_PER_BUCKET) -> int:
    """Buckets large enough that their last, part-filled windows don't count, at most one for each shuffle task."""
    return max(1, min(shuffle_tasks(docs.sparkSession), -(-docs.count() // docs_per_bucket)))


def pack_documents(docs: DataFrame, tokenizer_json: str, size: int = SEQUENCE, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequences: the columns of `token_pieces`, and sequence_id and offset.

    Null texts count as empty. Rows with equal ids are packed each for itself. Other columns are ignored. An empty
    table gives no pieces.
    """
    return packed(token_pieces(docs, tokenizer_json, size=size, keep_ids=keep_ids), bucket_count(docs), size=size)


def read_vocabulary(path: str) -> str:
    """A vocabulary file, read by the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()




def op1_packing(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """The query's columns: every piece's place and a digest of its ids."""
    return pack_documents(docs, tokenizer_json, keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
