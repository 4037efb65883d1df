"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is column expressions and Spark's own tree training. The model is fitted on a bounded sample of labelled
addresses; suffix statistics cover all of them, and every address is judged.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.llm.common import checkpointed
from mergescope.session import stored

#: Labelled addresses that the trees are fitted on, at most; those with the smallest hashes are taken.
TRAINING_ROWS = 20_000
BLOCK_FROM = 0.5
TREES, DEPTH, SEED = 12, 4, 42

# The query's rules (verdict, host and path), and name parts of advertising, gambling and similar hosts.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
UNWANTED = (
    "ads", "adserver", "bet", "bets", "betting", "casino", "cheap", "click", "crypto", "escort", "gambling", "loans",
    "lottery", "payday", "pills", "poker", "popup", "porn", "replica", "slots", "spam", "track", "tracker", "viagra", "xxx",
)

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy",
    "host_entropy", "parameters", "hyphens", "host_hyphens", "longest_label", "vowel_ratio", "has_fragment", "is_https",
    "suffix_urls", "suffix_length", "suffix_digits", "suffix_hyphens", "suffix_parameters",
)


def address_parts(url: Column) -> dict[str, Column]:
    """host: after the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; path: then up to `?`, `#` or
    the end. Both are empty for a null address or one without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return {"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rule_path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; zero for an empty one."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.coalesce(F.aggregate(letters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c))), F.lit(0.0))


def _ratio(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, pattern, "")) / n).otherwise(F.lit(0.0))


def with_features(urls: DataFrame) -> DataFrame:
    """Rows of (..., url, host, path) with lexical features and the statistics of their host's suffix, over all rows."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    named = urls.withColumns({
        "suffix": F.substring_index(host, ".", -2),
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]+")).cast("double"),
        "labels": F.regexp_count(host, F.lit("[^.]+")).cast("double"),
        "digit_ratio": _ratio(url, "[^0-9]"),
        "host_digit_ratio": _ratio(host, "[^0-9]"),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "parameters": F.regexp_count(query, F.lit("[^&;]+")).cast("double"),
        "hyphens": F.length(F.regexp_replace(url, "[^-_]", "")).cast("double"),
        "host_hyphens": F.length(F.regexp_replace(host, "[^-_]", "")).cast("double"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "vowel_ratio": _ratio(host, "[^aeiou]"),
        "has_fragment": F.instr(url, "#").cast("boolean").cast("double"),
        "is_https": F.startswith(F.lower(url), F.lit("https:")).cast("double"),
    })
    suffixes = stored(
        named.groupBy("suffix").agg(
            F.log1p(F.count("*")).alias("suffix_urls"), F.avg("url_length").alias("suffix_length"),
            F.avg("digit_ratio").alias("suffix_digits"), F.avg("host_hyphens").alias("suffix_hyphens"),
            F.avg("parameters").alias("suffix_parameters"),
        ),
        "url-suffixes",
    )
    # The stored table's size is known to the planner: it is broadcast if small, and joined with skew handling if not.
    return named.join(suffixes, "suffix", "left")


def fitted(labelled: DataFrame, rows: int = TRAINING_ROWS) -> GBTClassificationModel | None:
    """Trees fitted on at most `rows` rows of features and `label` (1.0: block); None unless both labels occur.

    The rows with the smallest hashes of their address are taken, half of them from each label where there are enough.
    """
    hashed = labelled.withColumn("_order", F.xxhash64("url"))
    halves = [hashed.where(F.col("label") == v).orderBy("_order", "url").limit(rows // 2) for v in (0.0, 1.0)]
    sample = checkpointed(halves[0].unionByName(halves[1]).select("label", *FEATURES).coalesce(4))
    if sample.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED)
    return trees.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(sample))


def scored(rows: DataFrame, model: GBTClassificationModel | None) -> DataFrame:
    """Rows of features with `score`, the probability that the address is unwanted; zero without a model."""
    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows)
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def name_label(host: Column) -> Column:
    """The label of addresses whose host says what it is: 1.0 where a part of its name is a known unwanted word, 0.0 for
    other named hosts, null where there is no host."""
    parts = F.split(host, r"[^a-z]+")
    known = F.arrays_overlap(parts, F.array(*[F.lit(w) for w in UNWANTED]))
    return F.when(host == "", F.lit(None)).when(known, 1.0).otherwise(0.0)


def judged(
    urls: DataFrame, labels: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id",
    url_col: str = "url", rows: int = TRAINING_ROWS,
) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of the addresses.

    labels: (url, label), 1 for block. Without them, addresses are labelled by the words of their hosts' names; the trees
    see no words, only lexical features. verdict: that of the longest rule that fits, else block where the trees' score
    is 0.5 or more, else allow. A null address, or one without `://`, has an empty host and path. Rows with equal or null
    ids are judged each for itself; other columns are ignored; an empty table gives no rows.
    """
    named = urls.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"))
    parts = address_parts(F.col("url"))
    features = checkpointed(with_features(named.withColumns(parts)).select("_id", "url", "host", "path", *FEATURES))
    if labels is None:
        known = features.withColumn("label", name_label(F.col("host")))
    else:
        known = features.join(labels.select("url", F.col("label").cast("double").alias("label")).distinct(), "url")
    found = scored(features, fitted(known.where("label IS NOT NULL AND url IS NOT NULL"), rows))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return found.select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")).alias("verdict"), "score",
    )
