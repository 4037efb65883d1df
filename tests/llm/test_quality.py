import re
from collections import Counter

from mergescope.llm import quality
from tests.llm.samples import documents, texts, with_odd_columns


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_and_base_rules(spark):
    rows = {r.doc_id: r for r in quality.op8_quality_rules(with_odd_columns(documents(spark))).collect()}
    for i, t in enumerate(texts()):
        r, m = rows[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r.base_failed and r.kept)


def test_ledger_policies_and_ablation(spark):
    ledger = quality.rule_ledger(documents(spark))
    bits = [r.failed_bits for r in ledger.select("failed_bits").collect()]
    for policy, rules in quality.POLICIES.items():
        mask = quality.mask(policy)
        found = {r.rule: r for r in quality.ablation(ledger, policy).collect()}
        assert set(found) == set(rules)
        for rule in rules:
            bit = 1 << [n for n, _ in quality.RULES].index(rule)
            assert found[rule].n_failed == sum(b & bit > 0 for b in bits)
            assert found[rule].n_only == sum(b & mask == bit for b in bits)
            assert found[rule].n_kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_filter_keeps_rows_as_they_are(spark):
    docs = with_odd_columns(documents(spark))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in quality.op8_quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == wanted and wanted


def test_empty_and_null_ids(spark):
    none = documents(spark).where("false")
    assert quality.op8_quality_rules(none).count() == 0 and quality.quality_filter(none).count() == 0
    assert quality.ablation(quality.rule_ledger(none)).count() == len(quality.POLICIES["v1"])
    odd = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert quality.op8_quality_rules(odd).count() == 2
