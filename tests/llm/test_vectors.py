import hashlib
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from mergescope.llm import hard_negatives, vector_codes
from mergescope.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Product codes by full search in every round, one distance after the other."""
    def good(v):
        return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)

    kept = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if good(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def nearest():
        codes, errors = np.empty((len(kept), parts), int), np.zeros(len(kept), np.int64)
        for p in range(parts):
            for i in range(len(kept)):
                d = ((x[i, p] - books[p]) ** 2).sum(1)
                codes[i, p] = int(d.argmin())
                errors[i] += d.min()
        return codes, errors

    for _ in range(rounds):
        codes, _ = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = x[codes[:, p] == e, p]
                if len(mine):
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    codes, errors = nearest()
    total = defaultdict(int)
    for (_, _, label), e in zip(kept, errors.tolist()):
        total[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e.tolist()).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{c:02x}" for c in code), e, total[label], digest) for (i, _, label), code, e in zip(kept, codes.tolist(), errors.tolist())),
        key=repr,
    )


def codes_of(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).withColumns({n: F.lit(1) for n in ("id", "v", "codes", "key", "error", "upper")})
    found = vector_codes.op11_vector_codes(docs).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found), key=repr)


def test_codes_equal_a_full_search_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding", "label").collect()]
    assert codes_of(spark, rows) == brute_codes(rows)


def test_odd_vectors_ties_copies_and_null_labels(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 8) / 1024).tolist(), [None, 0, 0, 5][i % 4]) for i in range(700)]  # many equal distances
    rows += [(1000 + i, rows[7][1], 3) for i in range(400)] + [rows[3], rows[3]]
    rows += [(-5, None, 1), (2000, [1.0, None] * 4, 1), (2001, [float("nan")] * 8, 1), (2002, [float("inf")] + [0.0] * 7, 1), (2003, [], 1)]
    rows += [(None, [0.5] * 8, None), (-9, [-0.0005] * 8, None)]
    assert codes_of(spark, rows) == brute_codes(rows)


def test_few_vectors_other_lengths_large_components_and_empty_tables(spark):
    few = [(i, [float(i), -float(i), 0.25, 3.5], i) for i in range(3)]
    assert codes_of(spark, few) == brute_codes(few)
    others = [*few, (7, [1.0] * 8, 1), (8, [1.0] * 3, 1)]  # not as long as the vector of the smallest id
    assert codes_of(spark, others) == brute_codes(few)
    large = [(0, [1e6, -3e4, 9.0, 1.0], 1), (1, [-2e4, 3e4, 9.0, 1.0], 1), (2, [3e30, -3e30, 9.0, 1.0], 1)]
    held = [(i, [max(-32768.0, min(32768.0, c)) for c in v], label) for i, v, label in large]
    assert codes_of(spark, large) == brute_codes(held)
    assert codes_of(spark, []) == []


def test_bounds_spare_most_distances_and_never_hide_a_nearer_entry():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 40, (800, 16)) for m in (0, 300, -300, 900)]).astype(np.int64)
    history, state, spent = [x[:256].copy()], None, []
    for _ in range(6):
        codes, own, state, scanned = vector_codes.assigned(x, history, state)
        full = vector_codes._distances(x, history[-1])
        assert (codes == full.argmin(1)).all() and (own == full.min(1)).all()
        # What is kept must hold as it stands after one write and read.
        state = tuple(np.frombuffer(np.ascontiguousarray(s.astype(k)).tobytes(), k).reshape(s.shape) for s, k in zip(state, (np.int16, np.float16, np.int8, np.float16, np.int8)))
        spent.append(scanned)
        following = history[-1].copy()
        for e in np.unique(codes):
            following[e] = x[codes == e].sum(0) // (codes == e).sum()
        history.append(following)
    assert spent[0] == x.shape[0] * 256 and spent[-1] < spent[0] / 4


def test_net_displacement_is_never_more_than_the_sum_of_steps():
    rng = np.random.default_rng(2)
    history = [rng.integers(-50, 50, (32, 8))]
    for _ in range(5):
        history.append(history[-1] + rng.integers(-9, 10, (32, 8)))
    far = vector_codes.Displacements(history)
    steps = [np.sqrt(((b - a) ** 2).sum(1)) for a, b in zip(history, history[1:])]
    assert (far.entry[0] <= sum(steps) + 1e-6).all() and (far.entry[0] < sum(steps) * 0.9).any()


def test_codes_restore_their_entries(spark):
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings")
    coded, books = vector_codes.compressed(vectors)
    restored = {r.id: r.vector for r in vector_codes.restored(coded, books).collect()}
    x = {r.vec_id: np.floor(np.array(r.embedding, float) * 1024) for r in vectors.collect()}
    for r in coded.collect():
        assert r.error == int(((x[r.id] - np.array(restored[r.id]) * 1024) ** 2).sum())


def brute_negatives(rows, every=50):
    """Every anchor against every row, one pair after the other."""
    def good(v):
        return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)

    by_id = {}
    for i, v, label in rows:
        if i is not None and label is not None and good(v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            row = (label, [math.floor(256 * c) for c in v])
            by_id[i] = min(by_id.get(i, row), row)
    lengths = {i: len(v) for i, (_, v) in by_id.items()}
    out = []
    for a, (label, v) in by_id.items():
        if a % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in by_id.items() if i != a and lengths[i] == lengths[a]
        )
        positives = [(i, -s) for s, i, other in scored if other == label][:5]
        for p, best in positives:
            fits = [(i, -s) for s, i, other in scored if other != label and 50 * best <= -100 * s <= 95 * best][:3]
            out += [(a, p, rank, i, best, s) for rank, (i, s) in enumerate(fits, 1)]
    return sorted(out)


def negatives_of(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).withColumns({n: F.lit(1) for n in ("id", "v", "row", "at", "anchor", "score", "windows")})
    found = hard_negatives.op13_hard_negatives(docs).collect()
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found)


def test_negatives_equal_every_pair_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding", "label").collect()]
    expected = brute_negatives(rows)
    assert expected and negatives_of(spark, rows) == expected


def test_negatives_with_ties_copies_zero_scores_and_rows_left_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)  # several blocks of anchors
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-2, 3, 6) / 16).tolist(), int(rng.integers(0, 3))) for i in range(500)]  # equal scores everywhere
    rows += [(600 + i, rows[50][1], i % 4) for i in range(200)] + [rows[50], rows[100], (50, [9.0] * 6, 9)]
    rows += [(1000, [0.0] * 6, 1), (1050, [0.5] * 4, 1), (1051, [0.4] * 4, 1), (1052, [0.3] * 4, 2), (-50, [0.25] * 6, 2)]
    rows += [(None, [1.0] * 6, 1), (1100, None, 1), (1150, [None] * 6, 1), (1200, [float("nan")] * 6, 1), (1250, [1.0] * 6, None), (1300, [], 1)]
    expected = brute_negatives(rows)
    assert expected and negatives_of(spark, rows) == expected


def test_negatives_of_large_scores_and_empty_tables(spark):
    rows = [(50, [30000.0] * 8, 1), (1, [30000.0] * 8, 1), (2, [20000.0] * 8, 2), (3, [-20000.0] * 8, 2)]
    assert negatives_of(spark, rows) == brute_negatives(rows) and negatives_of(spark, rows)
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(50, [1.0], 1), (51, [0.7], 2)]) == []


def test_the_best_of_many_offers_are_held():
    rng = np.random.default_rng(4)
    best, offers = hard_negatives.Best(5, 3), []
    for _ in range(30):
        slots, score, ids = rng.integers(0, 4, 40), rng.integers(-5, 5, 40), rng.permutation(40) + 1000 * len(offers)
        best.offer(slots, score, ids)
        offers += zip(slots.tolist(), score.tolist(), ids.tolist())
    held = sorted(zip(*(x.tolist() for x in best.held())))
    assert held == sorted(x for s in range(4) for x in sorted((o for o in offers if o[0] == s), key=lambda o: (-o[1], o[2]))[:3])
