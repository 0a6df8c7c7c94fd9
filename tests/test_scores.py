"""Score curves against sums over all pairs and all cuts, ties, nulls and empty tables included."""

import random

from trailmesh.operators import scores

KIND = "score double, y int"


def rows(n, seed):
    r = random.Random(seed)
    return [(float(r.randrange(40)), int(r.random() < 0.3)) for _ in range(n)]


def test_curves_equal_brute_force(spark):
    for n in (2, 60, 400):
        data = rows(n, n) + [(1.0, 1), (2.0, 0)]
        df = spark.createDataFrame([*data, (None, 1), (3.0, None)], KIND)
        pos, neg = ([s for s, y in data if y == k] for k in (1, 0))
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
        assert abs(scores.auc(df, "score", "y").first()[0] - want) < 1e-12
        f1 = {c: 2 * sum(p >= c for p in pos) / (sum(s >= c for s, _ in data) + len(pos)) for c, _ in data}
        best = scores.best_f1(df, "score", "y").first()
        top = max(f1.values())
        assert abs(best.f1 - top) < 1e-12 and best.score == min(c for c in f1 if f1[c] == top)
        got = {r.cut: (r.tp, r.fp) for r in scores.sweep(df, "score", "y", 5).collect()}
        assert got == {c: (sum(p >= c for p in pos), sum(q >= c for q in neg)) for c in {s // 5 * 5 for s, _ in data}}


def test_few_ranges_give_the_same_sums(spark):
    hist = scores.histogram(spark.createDataFrame(rows(200, 7), KIND), "score", "y")
    assert sorted(scores.running(hist, 3).collect()) == sorted(scores.running(hist).collect())


def test_empty_and_one_label(spark):
    empty = spark.createDataFrame([], KIND)
    assert scores.auc(empty, "score", "y").collect()[0][0] is None
    assert scores.best_f1(empty, "score", "y").count() == scores.sweep(empty, "score", "y", 5).count() == 0
    assert scores.auc(spark.createDataFrame([(1.0, 1)], KIND), "score", "y").first()[0] is None
