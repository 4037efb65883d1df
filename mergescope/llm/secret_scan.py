"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything is column expressions and Spark's own tree training. A candidate is a long run of letters, digits and the
signs of encodings; the forest judges its length, character transitions, dictionary coverage, path and neighbouring
words. Texts are scanned whole where they are read; only candidates with their surroundings go on.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergescope.llm.common import checkpointed
from mergescope.llm.url_filter import entropy
from mergescope.session import stored

#: Labelled findings that the forest is fitted on, at most.
TRAINING_ROWS = 8_000
SECRET_FROM = 0.5
TREES, DEPTH, SEED = 24, 6, 42
AROUND = 48
MASK = "[secret]"

# The shape of candidates, key openings with their kinds, and words around and inside candidates.
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+"
KINDS = (
    ("aws_access_key", r"^(AKIA|ASIA)[A-Z0-9]{16}$"),
    ("github_token", r"^gh[pousr]_[A-Za-z0-9]{20,}$"),
    ("slack_token", r"^xox[abprs]-[A-Za-z0-9-]{10,}$"),
    ("api_key", r"^(sk|pk|rk)[-_][A-Za-z0-9_-]{16,}$"),
    ("google_key", r"^AIza[A-Za-z0-9_-]{30,}$"),
    ("json_web_token", r"^eyJ[A-Za-z0-9_-]{10,}$"),
    ("hex", r"^([0-9a-f]{16,}|[0-9A-F]{16,})$"),
)
NEAR_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private|credential|auth|bearer)"
DULL_WORDS = r"(?i)\b(sha-?\d+|md5(sum)?|hash|checksum|digest|commit|uuid|guid|example|sample|placeholder|revision|integrity)\b"
NEAR = 24
CODE_PATH = r"(?i)(\.(env|cfg|ini|conf|json|ya?ml|toml|properties|py|js|ts|java|go|rb|sh|tf)$|config|secret|\.env)"
TEST_PATH = r"(?i)(test|spec|example|sample|fixture|mock|docs?/|\.md$|\.lock$)"
DICTIONARY = (
    "able", "and", "ation", "configuration", "default", "der", "document", "ein", "en", "ent", "er", "example", "file",
    "for", "function", "ich", "ing", "ion", "ist", "keit", "lich", "ment", "name", "ness", "object", "of", "on", "que",
    "request", "response", "sample", "sch", "service", "st", "string", "test", "th", "the", "tion", "ung", "user", "value",
    "ver", "with",
)

FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "case_turns", "digit_turns", "entropy", "coverage", "vowels", "is_hex",
    "distinct", "known_kind", "assigned", "quoted", "near_words", "dull_words", "code_path", "test_path",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, value, start, n_occurrences, before, after, path): one row for each different candidate of each row.

    start: characters before its first occurrence; before and after: what stands around that. A null text has none.
    """
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    found = rows.withColumn("found", F.array_distinct(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))).where("size(found) > 0")
    around = F.transform("found", lambda v: F.struct(v.alias("value"), F.position(v, F.col("text")).alias("at"), F.expr("text").alias("t")))
    around = F.transform(around, lambda x: F.struct(
        x["value"].alias("value"), (x["at"] - 1).cast("long").alias("start"),
        ((F.length(x["t"]) - F.length(F.replace(x["t"], x["value"], F.lit("")))) / F.length(x["value"])).cast("long").alias("n_occurrences"),
        F.substring(x["t"], F.greatest(x["at"] - AROUND, F.lit(1)), F.least(x["at"] - 1, F.lit(AROUND))).alias("before"),
        F.substring(x["t"], x["at"] + F.length(x["value"]), F.lit(AROUND)).alias("after"),
    ))
    return found.select("id", "path", F.inline(around)).select("id", "value", "start", "n_occurrences", "before", "after", "path")


def kind_of(value: Column) -> Column:
    kind = F.lit("other")
    for name, pattern in reversed(KINDS):
        kind = F.when(value.rlike(pattern), name).otherwise(kind)
    return kind


def with_features(found: DataFrame) -> DataFrame:
    v, before, after, path = (F.coalesce(c, F.lit("")) for c in ("value", "before", "after", "path"))
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    flag = lambda condition: condition.cast("double")
    n = F.length(v)
    kind = kind_of(v)
    return found.withColumns({
        "kind": kind,
        "length": n.cast("double"),
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "lowers": count("[a-z]") / n,
        "signs": count("[^A-Za-z0-9]") / n,
        "case_turns": (count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")) / n,
        "digit_turns": (count("[A-Za-z](?=[0-9])") + count("[0-9](?=[A-Za-z])")) / n,
        "entropy": entropy(v),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(v), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")) / n,
        "vowels": F.regexp_count(F.lower(v), F.lit("[aeiou]")).cast("double") / n,
        "is_hex": flag(kind == "hex"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double"),
        "known_kind": flag(~kind.isin("hex", "other")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "near_words": flag(F.substring(before, -NEAR, NEAR).rlike(NEAR_WORDS)),
        "dull_words": flag(F.substring(before, -NEAR, NEAR).rlike(DULL_WORDS)),
        "code_path": flag(path.rlike(CODE_PATH)),
        "test_path": flag(path.rlike(TEST_PATH)),
    })


def example_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """(value, before, after, path, label): labelled findings written by rule, so that every kind of both labels occurs.

    Secrets are digests of numbers in the forms that keys have, next to words that name them; the rest are the usual false
    findings: words run together, identifiers, paths, repeated signs, checksums and unique ids named as such.
    """
    n = F.col("id")
    digest, wide = F.sha1(n.cast("string")), F.base64(F.unhex(F.sha2(n.cast("string"), 256)))
    letters = F.regexp_replace(wide, "[+/=]", "x")
    pick = lambda k, *values: F.element_at(F.array(*values), (F.pmod(F.xxhash64(n, F.lit(k)), F.lit(len(values))) + 1).cast("int"))
    text = lambda k, *values: pick(k, *[F.lit(x) for x in values])
    secret = pick(
        1, digest, F.upper(digest), F.md5(n.cast("string")), wide, letters, F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(letters, 1, 36)), F.concat(F.lit("sk-"), F.substring(letters, 1, 32)), F.sha2(n.cast("string"), 256),
    )
    word = lambda k: text(k, *DICTIONARY)
    words = F.concat(*[word(k) for k in range(10, 20)])
    dull = pick(
        2, words, F.initcap(words), F.concat_ws("_", *[word(k) for k in range(20, 26)]), F.concat_ws("/", *[word(k) for k in range(30, 36)]),
        F.concat_ws("-", *[word(k) for k in range(40, 47)]), F.repeat(text(3, "=", "-", "_", "ab", "x", "0"), 24), F.upper(words),
        F.concat(*[F.initcap(word(k)) for k in range(50, 56)]), F.lpad(F.abs(F.xxhash64(n)).cast("string"), 18, "1"),
    )
    near = text(4, "token = \"", "password: ", "api_key=", "secret = '", "Authorization: Bearer ", "access key ", "client_secret: \"", "TOKEN = \"")
    prose = text(5, "the end of ", "and ", "in der ", "see ", "", "that which ", "value ", "name = ", "path: ")
    named = text(6, "sha1: ", "commit ", "md5sum ", "checksum=", "uuid ", "integrity sha256-", "example token ")
    what = F.pmod(n, F.lit(8))
    return spark.range(rows).select(
        F.when(what < 4, secret).when(what < 5, digest).otherwise(dull).alias("value"),
        F.when(what < 4, near).when(what < 5, named).otherwise(prose).alias("before"),
        F.when(F.substring(near, -1, 1).isin("\"", "'") & (what < 4), F.substring(near, -1, 1)).otherwise(F.lit(" and")).alias("after"),
        text(7, "src/app.py", "config.yaml", "web", "page", "README.md", "src0").alias("path"),
        (what < 4).cast("double").alias("label"),
    )


def fitted(labelled: DataFrame, rows: int = TRAINING_ROWS) -> RandomForestClassificationModel | None:
    """A forest fitted on at most `rows` labelled findings, those with the smallest hashes; None unless both labels occur."""
    sample = with_features(labelled.orderBy(F.xxhash64("value", "before"), "value").limit(rows))
    sample = checkpointed(sample.select("label", *FEATURES).coalesce(4))
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(sample))


def secret_findings(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    path_col: str | None = "source",
) -> DataFrame:
    """(id, kind, value, start, n_occurrences, score, is_secret): one row for each different candidate of each document.

    labelled: (value, before, after, path, label) of known findings, label 1 for a secret; without them the forest is
    fitted on `example_findings`. score is the forest's share for a secret; is_secret from 0.5 on. A null or empty text
    has no findings; rows with equal or null ids are scanned each for itself; other columns are ignored; an empty table
    gives no rows.
    """
    model = fitted(example_findings(docs.sparkSession) if labelled is None else labelled)
    found = with_features(candidates(docs, id_col, text_col, path_col))
    if model is None:
        found = found.withColumn("score", F.lit(0.0))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(found)
        found = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return found.select(
        F.col("id").alias(id_col), "kind", "value", "start", "n_occurrences", "score", (F.col("score") >= SECRET_FROM).alias("is_secret")
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **how) -> DataFrame:
    """The documents with every occurrence of their secrets replaced by a mark, with the columns they came with.

    `length_col` is set to the new text's number of characters. Rows with a null id share their secrets.
    """
    secrets = secret_findings(docs, id_col=id_col, text_col=text_col, **how).where("is_secret")
    by_row = stored(
        secrets.groupBy(F.col(id_col).alias("_secret_id")).agg(F.sort_array(F.collect_set(F.struct(F.length("value"), "value")), asc=False).alias("_secrets")),
        "secrets",
    )
    # The stored table's size is known to the planner: it is broadcast if small, else both sides are shuffled.
    joined = docs.join(by_row, F.col(id_col).eqNullSafe(F.col("_secret_id")), "left")
    text = F.when(F.col("_secrets").isNull(), F.col(text_col)).otherwise(
        F.aggregate("_secrets", F.col(text_col), lambda t, s: F.replace(t, s["value"], F.lit(MASK)))
    )
    joined = joined.withColumn(text_col, text)
    if length_col:
        joined = joined.withColumn(length_col, F.when(F.col("_secrets").isNull(), F.col(length_col)).otherwise(F.length(text_col)))
    return joined.select(*docs.columns)
