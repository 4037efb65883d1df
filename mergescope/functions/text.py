"""Text column expressions: words, titles, repository addresses and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that separate words, and those that end a line.
ASCII_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21))))
WIDE_SPACES = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACES = ASCII_SPACES + WIDE_SPACES
ASCII_WORD = r"[^\t-\r\x1c-\x20]+"
LINE_BREAK_CLASS = r"\n-\r\x1c-\x1e\x85\x{2028}\x{2029}"

# The opening and the words that mark a title as a fix, matched without regard to case.
FIX_OPENING = r"^fix(?:\([^)]*\))?!?[\s:!/]"
FIX_WORDS = (
    r"fix(?:es|ed|ing)?", r"bug\s*fix", r"hotfix", r"bug", r"patch", r"resolv(?:e[ds]?|ing)", r"error", r"crash(?:es|ed|ing)?", r"defect",
    r"regression", r"broken",
)

# Commit types in matching order.
COMMIT_TYPES = (
    "feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "other", "revert",
)
TITLE_LABEL_REASON = "title provides conventional commit label"
TITLE_LABEL_CONFIDENCE = 10
DEFAULT_REASON = "No reason provided."

UNKNOWN = "Unknown"


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; NULL counts as zero."""
    known = F.coalesce(text, F.lit(""))
    # A class of ASCII characters alone matches several times faster, so other spaces are replaced first where text has any.
    plain = F.when(F.octet_length(known) == F.char_length(known), known).otherwise(
        F.translate(known, WIDE_SPACES, " " * len(WIDE_SPACES))
    )
    return F.regexp_count(plain, F.lit(ASCII_WORD))


def strip(text: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.btrim(text, F.lit(SPACES))


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, f"^[^{LINE_BREAK_CLASS}]*", 0)


def shorten(text: Column, limit: int = 30) -> Column:
    """Cut long text so that it ends in an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def within_bytes(text: Column, cap: int) -> Column:
    """The text, or NULL when its UTF-8 form is larger than the cap."""
    return F.when(F.octet_length(text) <= cap, text)


def match_key(repo: Column, number: Column) -> Column:
    """Key of a pull request that two collections agree on; NULL when a part is missing."""
    return F.concat(repo, F.lit("#"), number.cast("string"))


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.replace(text, F.lit(prefix), F.lit(""))


def is_fix_title(title: Column) -> Column:
    # One word boundary guards all words, so most positions of a long text are left after a single test.
    return F.coalesce(title, F.lit("")).rlike(rf"(?iU){FIX_OPENING}|\b(?:{'|'.join(FIX_WORDS)})\b")


def classify_title(title: Column) -> Column:
    """'fix' for titles that announce a repair, otherwise 'other'."""
    return F.when(is_fix_title(title), "fix").otherwise("other")


def conventional_label(title: Column) -> Column:
    """Commit type that opens the first line of the title, NULL when there is none."""
    line = first_line(title)
    hits = [
        F.when(line.rlike(rf"(?iU)^{kind}(\([^)]*\))?!?(?=\W|$)"), F.lit(kind)) for kind in COMMIT_TYPES
    ]
    return F.coalesce(*hits)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def repo_of(url: Column) -> Column:
    """owner/repo of a web or API address, NULL when the text holds none."""
    from_api = _found(url, r"github\.com/repos/([^/]+/[^/]+)", 1)
    from_web = _found(url, r"github\.com/([^/]+/[^/]+)", 1)
    return F.coalesce(from_api, from_web)


def canonical_url(url: Column) -> Column:
    """Web address cut after owner/repo with one closing slash; other text is kept."""
    base = _found(url, r"https?://github\.com/[^/]+/[^/]+", 0)
    return F.coalesce(F.concat(base, F.lit("/")), url)


def recover_name(full_name: Column, html_url: Column, repo_url: Column) -> Column:
    """Best known repository name: metadata first, then the two addresses."""
    return F.coalesce(F.nullif(full_name, F.lit(UNKNOWN)), repo_of(html_url), repo_of(repo_url), F.lit(UNKNOWN))


RESPONSE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("output", "confidence", "reason")]
)


def json_object(raw: Column) -> Column:
    """The answer fields of the first JSON object in a model's raw text; all NULL when there is none."""
    whole = F.from_json(strip(raw), RESPONSE_SCHEMA)
    embedded = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), RESPONSE_SCHEMA)
    answered = F.coalesce(*[whole[f.name] for f in RESPONSE_SCHEMA]).isNotNull()
    return F.when(answered, whole).otherwise(embedded)
