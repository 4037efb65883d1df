"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that its predecessor wrote, and all but the last return the columns of `documents`: quality rules
reject documents, repeated lines are cut out, one document of each group of near copies stays, secrets are masked, and
what is left is packed into sequences.

A null text is an empty one: the rules reject it. Rows that repeat an id are kept or dropped together by near-copy dedup
and treated each for itself elsewhere, but for the numbers of repeated lines, which rows of an id share; null ids stay.
Columns beyond those of `documents`, whatever their names, are carried up to packing. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from mergescope.llm import line_dedup, packing, quality, secret_scan, simhash
from mergescope.llm.common import table
from mergescope.llm.queries import vocabulary
from mergescope.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies: the SimHash operator's own shingle length and bit distance; the distance alone decides.
NEAR_COPIES = {"words": 3, "distance": 2}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the default policy keeps."""
    return quality.quality_filter(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat a line of a document with a smaller id, exactly or nearly."""
    return line_dedup.drop_fuzzy_lines(docs, length_col="n_chars")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash.drop_near_copies(docs, **NEAR_COPIES)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.masked(docs, length_col="n_chars")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their place in the training sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_masking),
    ("packing", sequence_packing),
]

#: SQL can express neither the near duplicates, the forest nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what is between two stages is written and read again.

    No documents, no pieces. Clashing names, nulls and repeated rows: see the module's first lines.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline/{name}-{uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
