import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mergescope.llm import common, embed_dedup, line_dedup, simhash
from tests.llm.samples import SCHEMA, documents, prose, texts, with_odd_columns


def smallest_reachable(ids, linked):
    comp = {i: i for i in ids}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in linked[i])]) for i in ids}
        if new == comp:
            return comp
        comp = new


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randrange(200, 400)) for _ in range(80)] + [(5, 5), (None, 3)]
    ids = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    linked = {i: [b if a == i else a for a, b in edges if i in (a, b)] for i in ids}
    found = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == smallest_reachable(ids, linked)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_simhash(rows, distance):
    fps = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    ids = [i for i, _ in rows]
    linked = {i: [j for j, g in zip(ids, fps) if (f ^ g).bit_count() <= distance] for i, f in zip(ids, fps)}
    comp = smallest_reachable(ids, linked)
    return {i: (f"{f:016x}", comp[i]) for i, f in zip(ids, fps)}


@pytest.mark.parametrize(("distance", "many"), [(2, 2048), (2, 1), (5, 2)])
def test_simhash_equals_brute_force(spark, monkeypatch, distance, many):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda c, d, tables, total: links(c, d, tables, total, many))
    rows = list(enumerate(texts()))
    base = prose(9, 400).split(" ")
    for i in range(40):  # a crowd of near copies, and copies of it
        changed = base.copy()
        changed[i % 20] = "other"
        rows.append((100 + i, " ".join(changed)))
    docs = with_odd_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs, distance=distance).collect()}
    assert found == brute_simhash(rows, distance)


def test_simhash_drops_copies_and_keeps_the_rest(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(None, "no id", "en", "s", 5)], SCHEMA))
    kept = simhash.drop_near_copies(docs, words=5, tables=2, distance=5, total=19)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 4 in ids and 5 not in ids and None in ids and {14, 18, 19} <= ids
    assert simhash.simhash_groups(documents(spark).where("false")).count() == 0


def test_near_copies_equal_brute_force_jaccard(spark):
    by_shingles = {"words": 5, "tables": 2, "total": 40, "jaccard": 0.8}
    rng, rows, words = random.Random(12), [], by_shingles["words"]
    for k in range(60):  # similarities around 0.8, 0.85 and 0.9, by words changed at the end and in the middle
        base = [str(rng.randrange(10**6)) for _ in range(rng.choice([60, 104, 404]))]
        gone = round((len(base) - 4) * (0.11, 0.08, 0.05)[k % 3]) + rng.randrange(-1, 2)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-gone] + [str(rng.random()) for _ in range(gone)]))]
    for i in range(60):  # a chain, where only neighbours are near
        rows.append((200 + i, " ".join(str(i * 5 + j) for j in range(60))))
    rows += [(300, "a b a b a b a b a b a b q r s t u v w x y z"), (301, "a b a b a b a b a b a b q r s t u v w x y z"), (302, None), (303, " ")]
    sets = {i: frozenset(simhash.shingles_of(t, words)) for i, t in rows}
    linked = {i: [j for j in sets if sets[i] == sets[j] or sets[i] and sets[j] and line_dedup.similarity(sets[i], sets[j]) >= 0.8] for i in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs, **by_shingles).collect()}
    assert found == smallest_reachable(sets, linked)
    assert sum(found[2 * k + 1] == 2 * k for k in range(60)) >= 40


def brute_lines(rows):
    sets, occurrences, forms = [], [], {}
    for i, t in sorted(rows):
        for n, form in line_dedup.plain_lines(t):
            form = form.decode()
            if form not in forms:
                forms[form] = len(forms)
                sets.append(line_dedup.shingled(form))
            occurrences.append((i, n, forms[form]))
    linked = {a: [b for b in range(len(sets)) if line_dedup.similarity(sets[a], sets[b]) >= 0.8] for a in range(len(sets))}
    comp, seen, removed = smallest_reachable(range(len(sets)), linked), set(), {i: [] for i, _ in rows}
    for i, n, k in occurrences:
        if comp[k] in seen:
            removed[i].append(n)
        seen.add(comp[k])
    return removed


@pytest.mark.parametrize("together", [1024, 3])
def test_lines_equal_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(line_dedup, "TOGETHER", together)
    rows, base = list(enumerate(texts())), prose(11, 60).split(" ")
    for i in range(30):
        changed = base.copy()
        changed[2 * i] = "zzz"
        rows.append((50 + i, prose(60 + i, 20) + "\n\n" + " ".join(changed)))
    docs = with_odd_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r for r in line_dedup.fuzzy_lines(docs).collect()}
    expected = brute_lines(rows)
    assert {i: r.removed for i, r in found.items()} == expected
    assert all(r.n_removed == len(r.removed) and r.n_lines == len(list(line_dedup.plain_lines(dict(rows)[i]))) for i, r in found.items())
    cut = line_dedup.drop_fuzzy_lines(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        text = dict(rows)[r.doc_id]
        lines = text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in expected[r.doc_id])
        assert r.text == lines


def test_sparse_chains_of_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TOGETHER", 2)
    rng, rows = random.Random(14), []
    for k in range(80):  # four lines of which only neighbours are near, so two that are no first lines may be the only link
        words = [str(rng.randrange(10**5, 10**6)) for _ in range(30)]
        rows += [(4 * k + i, " ".join(words[2 * i : 2 * i + 24])) for i in range(4)]
    keys, checks = line_dedup.band_keys([t for _, t in rows])
    linked = {i: [] for i, _ in rows}
    for i in linked:  # links that are candidates: few others exist, and bands may miss them
        for j in range(i // 4 * 4, i // 4 * 4 + 4):
            candidate = (keys[i] == keys[j]).any() and line_dedup.agree(checks[i], checks[j])[0]
            if candidate and line_dedup.similarity(*(line_dedup.shingled(rows[x][1]) for x in (i, j))) >= 0.8:
                linked[i].append(j)
    first = smallest_reachable(linked, linked)
    found = line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in found} == {i: [0] if first[i] != i else [] for i in linked}


def test_crowds_of_lines_meet_in_a_forest():
    rng, forms = random.Random(15), ["abc", "abc def"]
    for k in range(3):  # three crowds, whose lines are mostly near, and lines with shingles of their own repeated
        base = [str(rng.randrange(1000, 10**4)) for _ in range(40)] + ["was"] * 20 * k
        forms += [" ".join(w if rng.random() > 0.04 else "changed" for w in base) for _ in range(60)]
    n = len(forms)
    sets, parts, cells = [line_dedup.shingled(x) for x in forms], np.array([i % 97 for i in range(n)]), np.arange(n) % 5
    near = {(i, j) for i in range(n) for j in range(i) if cells[i] != cells[j] and line_dedup.similarity(sets[i], sets[j]) >= 0.8}
    found = line_dedup.bridges(np.zeros(n, dtype=np.int64), cells, parts, forms)

    def joined(pairs):
        linked = {p: set() for p in set(parts.tolist())}
        for a, b in pairs:
            linked[a].add(b)
            linked[b].add(a)
        return smallest_reachable(linked, linked)

    assert joined(found) == joined({(int(parts[i]), int(parts[j])) for i, j in near})
    assert len(near) > 20 * len(found) and len(found) == 97 - len(set(joined(found).values()))


def test_texts_of_lines_without_candidates_are_not_shuffled(spark):
    rows = [(i, prose(300 + i, 30)) for i in range(200)]
    lines = [line_dedup.line_hash(form) for _, t in rows[:20] for _, form in line_dedup.plain_lines(t)]
    listed = line_dedup.line_filter(spark.createDataFrame([(x,) for x in lines], "id long"))
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    found = {r.line for r in texts.mapInArrow(line_dedup._texts(listed), "line long, form string").collect()}
    assert set(lines) <= found and len(found) <= len(lines) + 2
    nothing = line_dedup.line_filter(spark.createDataFrame([], "id long"))
    assert texts.mapInArrow(line_dedup._texts(nothing), "line long, form string").count() == 0


def test_signatures_estimate_similarity():
    a = prose(1, 80)
    b = a.replace(a[100:130], "something quite different here")
    x, y = line_dedup.signatures([a, b], 512)
    true = line_dedup.similarity(line_dedup.shingled(a), line_dedup.shingled(b))
    assert abs((x == y).mean() - true) < 0.08
    assert line_dedup.fuzzy_lines is not None and len(line_dedup.signatures(["a", ""], 96)) == 2


def test_lines_reached_are_not_compared_again(monkeypatch):
    text = prose(3, 40)
    lines = [text[: len(text) - i] + "x" * i for i in range(12)] + [prose(4, 40), "short"]
    calls, similarity = [], line_dedup.similarity
    monkeypatch.setattr(line_dedup, "similarity", lambda a, b: calls.append(1) or similarity(a, b))
    assert line_dedup.reached(lines) == [0] * 12 + [12, 13]
    assert len(calls) <= len(lines) * (len(lines) - 1) / 2


def test_lines_have_plain_forms():
    found = list(line_dedup.plain_lines(" A\tB \r\n\n \x0b\x0c \nÄ  É   x\x1fY\u00a0z\n\u2003Q"))
    assert found == [(0, b"a b"), (3, "Ä É x\x1fy\u00a0z".encode()), (4, "\u2003q".encode())]
    assert list(line_dedup.plain_lines(None)) == list(line_dedup.plain_lines("")) == []


def test_many_lines_are_reached_as_few_are(monkeypatch):
    rng, lines = random.Random(8), []
    for i in range(40):
        words = prose(200 + i // 8, 30).split(" ")
        for _ in range(rng.randrange(6)):
            words[rng.randrange(30)] = str(rng.random())
        lines.append(" ".join(words))
    by_matrix = line_dedup.reached(lines)
    monkeypatch.setattr(line_dedup, "COLUMNS_AT_ONCE", 7)
    assert line_dedup.reached(lines) == by_matrix
    monkeypatch.setattr(line_dedup, "FEW", 100)
    assert line_dedup.reached(lines) == by_matrix
    sets = [line_dedup.shingled(x) for x in lines]
    linked = {a: [b for b in range(40) if line_dedup.similarity(sets[a], sets[b]) >= 0.8] for a in range(40)}
    assert dict(enumerate(by_matrix)) == smallest_reachable(range(40), linked)


def test_lines_of_nothing(spark):
    none = documents(spark).where("false")
    assert line_dedup.fuzzy_lines(none).count() == 0 and line_dedup.drop_fuzzy_lines(none).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    rows = []
    for i in range(400):
        v = centers[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(30)] + [(430, [3.0] * 16, None), (431, None, 1), (432, [0.0] * 16, 1)]
    rows += [(433, [float("nan")] + [1.0] * 15, 1), (434, [None] + [1.0] * 15, 1), (435, [float("inf")] * 16, 1), (436, [], 0), (437, [1.0, 2.0], 0)]
    rows += [(438, [2.0, 4.0], 0), (439, [1e30] * 16, 0), (440, [1e-30] * 16, 0)]
    good = {i: np.array(v, float) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: l for i, _, l in rows}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    linked = {
        i: [j for j in unit if j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] if i in unit else []
        for i, *_ in rows
    }
    comp = smallest_reachable([i for i, *_ in rows], linked)
    frame = with_odd_columns(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "l")).drop("label").withColumnRenamed("l", "label")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_groups(frame).collect()}
    assert found == {i: (len(linked[i]), comp[i], comp[i] == i) for i in comp}
    assert embed_dedup.embedding_groups(frame.where("false")).count() == 0


def test_a_crowd_beyond_the_window_is_searched_in_full(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 1e-3).tolist(), 1) for i in range(300)]
    found = embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(1), neighbours=4)
    assert found.agg(F.min("n_links")).first()[0] >= 295
