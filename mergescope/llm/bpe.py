"""Byte-level BPE, encoding and decoding, over a contiguous rank array.

A word's part boundaries and the rank of each part joined with its right neighbour lie in two short arrays. The least
rank is found by a scan, its boundary is deleted, and the ranks of the two neighbours are looked up anew, until no pair
is in the vocabulary. Words are short, so the scan costs less than any queue.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_WORDS = 400_000
LONGEST_CACHED = 64
SOURCE_BATCH = 256
NONE = 1 << 40

#: Fixed value: the pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, to the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeCodec:
    """Encodes and decodes one text after the other with a vocabulary of the tokenizers library's file format."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        # Merge order is the rank; a pair of parts is looked up by the numbers of its two tokens.
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.ranks.setdefault((vocab[left], vocab[right]), rank)
            self.merged.append(vocab[left + right])
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of.update({i: content.encode() for content, i in self.special.items()})
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.of_word: dict[str, tuple[int, ...]] = {}
        self.of_chunk: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word, by the rank array."""
        get, none = self.ranks.get, NONE
        parts = [self.of_byte[b] for b in word.encode("utf-8")]
        ranks = list(map(get, zip(parts, parts[1:], strict=False), repeat(none)))
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] = part = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((part, parts[i + 1]), none)
            if i:
                ranks[i - 1] = get((parts[i - 1], part), none)
        return tuple(parts)

    def word(self, word: str) -> tuple[int, ...]:
        found = self.of_word.get(word)
        if found is None:
            found = self.merge(word)
            if len(self.of_word) >= CACHED_WORDS:
                self.of_word.clear()
            if len(word) <= LONGEST_CACHED:
                self.of_word[word] = found
        return found

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens.

        Where each piece between two blanks begins and ends with something else than white space, the pattern never
        reaches across a piece's end, so a piece and the blank before it have the same ids wherever they stand.
        """
        first, *chunks = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return [*self._split(first), *chain.from_iterable(map(self._chunk, chunks))]
            except ValueError:
                pass
        return self._split(text)

    def _split(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.word, self.words(text))))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        found = self.of_chunk.get(chunk)
        if found is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise ValueError("not alone")
            found = tuple(self._split(" " + chunk))
            if len(self.of_chunk) >= CACHED_WORDS:
                self.of_chunk.clear()
            if len(chunk) <= LONGEST_CACHED:
                self.of_chunk[chunk] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; of none for a null one. The strings of added tokens become those tokens."""
        text = text or ""
        if not self.at_special or not self.at_special.search(text):
            return self._plain(text)
        out: list[int] = []
        for part in self.at_special.split(text):
            out.extend([self.special[part]] if part in self.special else self._plain(part))
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids, added tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids or ())).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row; a null or empty text has no ids. Other columns are ignored."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SOURCE_BATCH):
                part = batch.slice(at, SOURCE_BATCH)
                ids = pa.array([codec.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_json: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(vocabulary.value)
        for batch in batches:
            text = pa.array([codec.decode(ids) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again in the task that reads it.

    Digests of the ids in decimals with commas between, and of the text the ids decode to. A null or empty text has no
    ids; rows with equal ids each get a row; an empty table gives none.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SOURCE_BATCH):
                part, found = batch.slice(at, SOURCE_BATCH), []
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text)
                    listed = ",".join(map(codec.text_of.__getitem__, ids))
                    decoded = codec.decode(ids)
                    found.append((len(ids), *(hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (listed, decoded))))
                n, listed, decoded = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
