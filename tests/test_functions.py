"""Column functions against hand-worked values and the Python definitions they follow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergescope.functions.clock import hours_between, month_text, parse_utc, period_of
from mergescope.functions.numeric import (
    chi_square_p, clip, erfc, log10_scale, normal_two_sided_p, np_round, order_cell, pct_modification, percent, ratio, stars,
)
from mergescope.functions.text import (
    canonical_url, classify_title, conventional_label, first_line, match_key, recover_name, repo_of, shorten, strip, within_bytes,
    word_count,
)


def apply(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_erfc_matches_the_library(spark):
    xs = [float(x) for x in np.linspace(-6, 26, 1281)] + [0.46875, 4.0, 0.0]
    got = apply(spark, xs, "double", erfc)
    for x, y in zip(xs, got):
        assert y == pytest.approx(math.erfc(x), rel=1e-13, abs=1e-300)


def test_p_values_and_stars(spark):
    assert apply(spark, [3.841458820694124], "double", chi_square_p)[0] == pytest.approx(0.05, rel=1e-12)
    assert apply(spark, [1.959963984540054, -3.0], "double", normal_two_sided_p) == pytest.approx([0.05, 1.0], rel=1e-12)
    assert apply(spark, [0.0009, 0.001, 0.01, 0.049, 0.05, None], "double", stars) == ["***", "**", "*", "*", "ns", None]


def test_rounding_is_that_of_numpy(spark):
    values = [0.125, 2.675, 1.005, 0.5, 1.5, 2.5, -0.125, 12.345, 99.95]
    for digits in (0, 1, 2):
        assert apply(spark, values, "double", lambda x: np_round(x, digits)) == [float(v) for v in np.round(values, digits)]


def test_ratio_and_clip_keep_null(spark):
    assert apply(spark, [0, 4, None], "int", lambda x: ratio(F.lit(2), x)) == [None, 0.5, None]
    assert apply(spark, [0, 4], "int", lambda x: percent(F.lit(1), x, 1, empty=0.0)) == [0.0, 25.0]
    assert apply(spark, [1.0, 9.0, None], "double", lambda x: clip(x, 2.0, 8.0)) == [2.0, 8.0, None]
    assert apply(spark, [0.0, 100.0, None], "double", log10_scale) == [0.0, 2.0, None]
    assert apply(spark, [0, 4, None], "int", lambda x: pct_modification(F.lit(6), x)) == [None, 150.0, None]


def test_order_cells_are_monotone_and_few(spark):
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([rng.lognormal(3, 4, 3000), -rng.lognormal(1, 3, 1000), [0.0, 1.0, -1.0, 5e-324, 1.7e308]]))
    cells = apply(spark, [float(v) for v in values], "double", order_cell)
    assert cells == sorted(cells)
    assert apply(spark, [None], "double", order_cell) == [0]


def test_words_split_like_python(spark):
    texts = ["", "  ", "a", " a\tb\nc ", "x\xa0y z　w", "é\x1cù", "a b\x85c", "one​two", None, "ünï cödé  x"]
    assert apply(spark, texts, "string", word_count) == [len((t or "").split()) for t in texts]
    assert apply(spark, texts, "string", strip) == [None if t is None else t.strip() for t in texts]


TITLES = {
    "fix: x": "fix", "fix(ui)!: x": "fix", "prefix": "other", "FIXES y": "fix", "bug fix": "fix", "debug": "other", "resolved": "fix",
    "": "other", None: "other", "éfix": "other", "fix_it": "other", "Crashing app": "fix", "patches": "other", "broken": "fix",
    "errors": "other", "error": "fix", "bugfix": "fix", "fix/typo": "fix", "unresolved": "other", "hotfix!": "fix", "fix": "fix",
}


def test_fix_titles(spark):
    assert dict(zip(TITLES, apply(spark, list(TITLES), "string", classify_title))) == TITLES


LABELS = {
    "feat!": "feat", "feature x": None, "ci/cd": "ci", "fix(a)(b)": "fix", "FEAT: x": "feat", "docs(x)!: y": "docs", "test_x": None,
    "tests": None, "chore\nfix: y": "chore", "\nfix: y": None, "": None, None: None, "other": "other", "revert(": "revert", "perfé": None,
    "style": "style", "build:": "build",
}


def test_conventional_labels(spark):
    assert dict(zip(LABELS, apply(spark, list(LABELS), "string", conventional_label))) == LABELS


def test_text_pieces(spark):
    assert apply(spark, ["a\nb", "a\x0bb", "", "\r\nx"], "string", first_line) == ["a", "a", "", ""]
    assert apply(spark, ["x" * 30, "y" * 31], "string", shorten) == ["x" * 30, "y" * 27 + "..."]
    assert apply(spark, ["éé", "abcd", "abcde", None], "string", lambda t: within_bytes(t, 4)) == ["éé", "abcd", None, None]
    assert apply(spark, [3, None], "int", lambda n: match_key(F.lit("o/r"), n)) == ["o/r#3", None]


URLS = {
    "https://api.github.com/repos/o/r": ("o/r", "https://api.github.com/repos/o/r"),
    "https://github.com/o/r/pull/1": ("o/r", "https://github.com/o/r/"),
    "https://github.com/o/r/": ("o/r", "https://github.com/o/r/"),
    "http://github.com/o/r": ("o/r", "http://github.com/o/r/"),
    "not a url": (None, "not a url"),
    None: (None, None),
}


def test_addresses(spark):
    assert apply(spark, list(URLS), "string", repo_of) == [v[0] for v in URLS.values()]
    assert apply(spark, list(URLS), "string", canonical_url) == [v[1] for v in URLS.values()]
    rows = [("a/b", None, None), ("Unknown", "https://github.com/c/d/pull/2", None), (None, "x", "https://api.github.com/repos/e/f"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, h string, u string").orderBy("i")
    assert [r[0] for r in df.select(recover_name(F.col("n"), F.col("h"), F.col("u"))).collect()] == ["a/b", "c/d", "e/f", "Unknown"]


def test_times(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stamps = ["2025-07-31T00:00:00Z", "2025-07-31T00:00:01Z", "soon", None]
    assert [None if t is None else t.isoformat() for t in apply(spark, stamps, "string", lambda x: parse_utc(x).cast("timestamp_ntz"))] == [
        "2025-07-31T00:00:00", "2025-07-31T00:00:01", None, None
    ]
    assert apply(spark, stamps, "string", lambda x: period_of(parse_utc(x), "2025-07-31")) == ["before", "after", None, None]
    assert apply(spark, stamps[:1], "string", lambda x: month_text(parse_utc(x))) == ["2025-07"]
    assert apply(spark, stamps[:2], "string", lambda x: hours_between(F.lit("2025-07-30T12:00:00Z").cast("timestamp"), parse_utc(x))) == [
        12.0, 12.0 + 1 / 3600
    ]
