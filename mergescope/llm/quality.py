"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger holds the measurements and one failure bit for each rule;
policies are versioned sets of rules, applied afterwards by a bitwise AND, so a new policy or an ablation reads the
ledger and never the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# ASCII white space, the symbols counted, and the sizes of the repetition measure.
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
WINDOW = 8
SOURCE_BATCH = 256

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_upper": "long", "n_letters": "long", "n_marks": "long",
}

#: Bit i of a ledger's failed_bits belongs to rule i; never reorder, only append.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("mostly_capitals", "n_letters >= 20 AND 10 * n_upper > 3 * n_letters"),
    ("shouted", "5 * n_marks > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("short_mean_word", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 15 * n_words"),
)

#: Policy version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(name for name, _ in RULES),
    "v1_no_length": tuple(name for name, _ in RULES if not name.endswith("mean_word")),
}
DEFAULT_POLICY = "v1"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur twice or more, each word once."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    mixed = np.array(list(map(hash, words)), dtype=np.int64).view(np.uint64)
    reach = 1
    while reach < size:
        mixed = mixed[:-reach] * np.uint64(0x9E3779B97F4A7C15) + (mixed[reach:] ^ (mixed[reach:] >> np.uint64(29)))
        reach *= 2
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # Equal windows have equal hashes; those that share one are compared by their words.
    starts = np.flatnonzero(np.isin(mixed, twice))
    seen: dict[tuple, list[int]] = {}
    for i in starts.tolist():
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for at in seen.values():
        if len(at) > 1:
            cover[at] += 1
            cover[np.array(at) + size] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; of a null text, those of an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        len(words),
        len(text or "") - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + len(raw) - len(raw.translate(None, LOWER)),
        raw.count(b"!"),
    )


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of the documents and the measurements; `prefix` keeps their names apart from columns that exist."""
    names = [prefix + m for m in MEASURES]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; choose a prefix")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SOURCE_BATCH):
                part = batch.slice(at, SOURCE_BATCH)
                found = zip(*map(measure, part.column(part.schema.get_field_index(text_col)).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(x, pa.int64()) for x in found)], names=[*part.schema.names, *names]
                )

    return docs.mapInArrow(add, StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)]))


def failed_bits(prefix: str = "") -> Column:
    """One bit for each rule that a row of measurements fails."""
    bits = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        for name in MEASURES if prefix else ():
            rule = rule.replace(name, prefix + name)
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def passes(bits: Column, policy: str = DEFAULT_POLICY) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements..., failed_bits): one row for each row of the documents.

    A null text counts as empty, an empty text has no words and fails `few_words`; rows with equal or null ids each get
    their own row; other columns are ignored; an empty table gives an empty ledger. Documents are measured where they
    are read: nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return measured(rows).select(F.col("id").alias(id_col), *MEASURES, failed_bits().alias("failed_bits"))


def quality_filter(docs: DataFrame, text_col: str = "text", policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows that a policy keeps, with the columns they came with."""
    prefix = "_rule_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return measured(docs, text_col, prefix).where(passes(failed_bits(prefix), policy)).select(*docs.columns)


def ablation(ledger: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """What each rule of a policy does: (policy, rule, n_failed, n_only, n_kept_without), from the ledger's bits alone.

    n_only counts the rows that no other rule of the policy rejects; n_kept_without is what the policy keeps when the
    rule is taken out.
    """
    bits = ledger.select(F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).groupBy("bits").count()
    names = [name for name, _ in RULES]
    sums = []
    for rule in POLICIES[policy]:
        bit = F.lit(1 << names.index(rule)).cast("long")
        n = F.col("count")
        sums.append(
            F.struct(
                F.lit(rule).alias("rule"),
                F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, n)), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(F.col("bits") == bit, n)), F.lit(0)).alias("n_only"),
                F.coalesce(F.sum(F.when((F.col("bits") == bit) | (F.col("bits") == 0), n)), F.lit(0)).alias("n_kept_without"),
            )
        )
    return bits.agg(F.array(*sums).alias("found")).select(F.lit(policy).alias("policy"), F.inline("found"))


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    """The query's columns: the measurements of its contract, the base verdict, and the default policy's."""
    return rule_ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits",
        (~passes(F.col("failed_bits"), "base")).alias("base_failed"),
        passes(F.col("failed_bits")).alias("kept"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM t)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(x, '[^!]', '', 'g')) AS n_marks
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
),
b AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_letters >= 20 AND 10 * n_upper > 3 * n_letters THEN 8 ELSE 0 END
    + CASE WHEN 5 * n_marks > n_words THEN 16 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 64 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 128 ELSE 0 END AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits::BIGINT AS failed_bits,
  failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept
FROM b
"""
