import random

from pyspark.sql import functions as F

from mergescope.llm import licenses, secret_scan, url_filter
from tests.llm.samples import documents, prose, with_odd_columns

URLS = [
    None, "", "no scheme/x", "http://", "https://A.ORG/", "https://a.org", "http://org/x", "http://x.example.org/es/1?b=://c",
    "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/en/1", "http://a.com/fr/1#f", "http://a.com/de/",
    "http://a.com/de", "http://a.net/de/x?y", "ftp://Host.NET?q=/fr/", "http://com#/fr/", "x://y://z.org/a", "http://a.org\n/b",
]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (not best or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


def test_hosts_paths_and_rules(spark):
    urls = URLS + [f"http://www.{n}.example.com/en/{i}" for i in range(40) for n in ("free-bets", "theword", "otherhost")]
    frame = with_odd_columns(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    rows = {r.page_id: r for r in url_filter.judged(frame).collect()}
    for i, url in enumerate(urls):
        r, (host, path, rule, verdict) = rows[i], brute_url(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert {rows[i].verdict for i in range(len(URLS), len(urls), 3)} == {"block"}


def test_trees_on_held_out_addresses(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 2 == 0
        name = "-".join(rng.choice(["win", "spin", "deal", "gold"]) for _ in range(3)) if bad else rng.choice(["garden", "river", "museum"]) + rng.choice("abcdefg")
        rows.append((f"http://{name}{rng.randrange(99) if bad else ''}.net/{'p?' + 'a=1&' * rng.randrange(4) if bad else 'page/' + str(i)}", float(bad), i))
    frame = spark.createDataFrame(rows, "url string, label double, page_id long")
    features = url_filter.with_features(frame.withColumns(url_filter.address_parts(F.col("url"))))
    model = url_filter.fitted(features.where("page_id % 4 != 0"))
    held = url_filter.scored(features.where("page_id % 4 = 0"), model)
    assert held.where("(score >= 0.5) != (label = 1)").count() <= 3
    assert url_filter.fitted(features.where("label = 0")) is None


def test_no_addresses(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(none).count() == 0


KEY = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"


def test_secrets_are_found_and_masked(spark):
    rows = [
        (1, f"some text token = \"{KEY}\" and {KEY} again", "src1"), (2, "password: ghp_" + "a1B2c3D4e5F6g7H8i9J0" * 2, "config.yaml"),
        (3, "ungkeitlichverenderdiestausch and informationsverarbeitung", "src2"), (4, None, "src2"), (5, "", None),
        (6, "=" * 80 + "\nthe-end-of-the-test-name-value", "README.md"), (None, f"secret = '{KEY}'", "x"), (7, "clean", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.secret_findings(with_odd_columns(docs).drop("id")).collect()
    secrets = {(r.doc_id, r.value) for r in found if r.is_secret}
    assert {(1, KEY), (None, KEY)} <= secrets and any(i == 2 for i, _ in secrets)
    assert not any(i in (3, 6) for i, _ in secrets)
    one = next(r for r in found if r.doc_id == 1)
    assert (one.start, one.n_occurrences) == (rows[0][1].index(KEY), 2)
    masked = {r.doc_id: r.text for r in secret_scan.masked(docs).collect()}
    assert masked[1] == rows[0][1].replace(KEY, secret_scan.MASK) and KEY not in masked[None] and masked[7] == "clean" and masked[4] is None
    assert secret_scan.masked(docs).columns == docs.columns
    assert secret_scan.secret_findings(docs.where("false")).count() == 0


def test_forest_on_held_out_findings(spark):
    labelled = secret_scan.example_findings(spark, 4000)
    part = F.pmod(F.xxhash64("value"), F.lit(4))
    model = secret_scan.fitted(labelled.where(part != 0))
    from pyspark.ml.feature import VectorAssembler

    held = VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="features").transform(secret_scan.with_features(labelled.where(part == 0)))
    rows = model.transform(held).select("label", "prediction").collect()
    assert sum(r.label == r.prediction for r in rows) >= 0.98 * len(rows)


def brute_licenses(text):
    """(template, containment) of the best window of each template's own length and a quarter more on each side."""
    words, found = licenses.words_of(text), {}
    for _, name, template in licenses.TEMPLATES:
        own = licenses.words_of(template)
        shingles = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        slack = len(own) // 4
        for at in range(-slack, len(words)):
            region = words[max(0, at - slack) : at + len(own) + slack]
            share = len(shingles & {tuple(region[i : i + 5]) for i in range(len(region) - 4)}) / len(shingles)
            if share >= 0.8:
                found[name] = max(found.get(name, 0), share)
    return found


def test_licenses_equal_brute_force(spark):
    rng, rows = random.Random(2), []
    for i, (_, _, template) in enumerate(licenses.TEMPLATES):
        words = template.split(" ")
        rows.append((2 * i, prose(i, 50) + "\n" + template.upper() + ".\n" + prose(i + 50, 30) + " " + template))
        for _ in range(len(words) // 60):
            words[rng.randrange(len(words))] = "altered"
        rows.append((2 * i + 1, prose(i, 9) + " (" + " ".join(words) + ") " + prose(i + 70, 9)))
    rows += [(900, None), (901, ""), (902, "mit license"), (903, prose(99, 4000))]
    docs = with_odd_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {}
    for r in licenses.license_matches(docs).collect():
        best = found.setdefault(r.doc_id, {})
        best[r.template] = max(best.get(r.template, 0), r.containment)
    assert found == {i: b for i, t in rows if (b := brute_licenses(t))}
    assert licenses.license_matches(docs).where("doc_id < 100 AND doc_id % 2 = 0").groupBy("doc_id", "template").count().where("count = 2").count() >= len(licenses.TEMPLATES)
    assert licenses.license_matches(documents(spark).where("false")).count() == 0
