"""Reports and track edits against brute force and by hand."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trailmesh.operators import edits as E
from trailmesh.operators import reports as R


def test_pair_scores_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), i, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 7, 8, 9])) for i in range(50)]
    r = R.pair_scores(spark.createDataFrame(rows, "cam string, local int, person int, gid int")).first()
    known = [x for x in rows if x[2] and x[3]]
    pairs = [(a[2] == b[2], a[3] == b[3]) for a, b in combinations(known, 2) if a[0] != b[0]]
    tp, found, true = sum(p and g for p, g in pairs), sum(g for _, g in pairs), sum(p for p, _ in pairs)
    p, q = tp / found, tp / true
    assert np.allclose([r.precision, r.recall, r.f1], [p, q, 2 * p * q / (p + q)]) and r.n_tracklet == len(known)
    ids = lambda i, j: sum(len({x[j] for x in known if x[i] == k}) > 1 for k in {x[i] for x in known})
    assert (r.broken, r.merged) == (ids(2, 3), ids(3, 2))
    none = R.pair_scores(spark.createDataFrame([], "cam string, local int, person int, gid int")).first()
    assert (none.precision, none.recall, none.n_tracklet) == (1.0, 1.0, 0)


def test_decomposition_adds_up(spark):
    rows = [(1, 5, 10), (1, None, 3), (2, None, 4), (3, 5, 1), (3, 6, 1)]
    r = R.id_decomposition(spark.createDataFrame(rows, "gid int, person int, n_frames int")).first()
    assert (r.n_ids, r.junk, r.covered, r.surplus, r.merges, r.frames, r.frames_unknown) == (3, 1, 2, 1, 1, 19, 7)


def test_point_classes_and_matches(spark):
    rows = [(0, 1, None), (0, 2, 5), (0, 2, 6), (0, 3, 7), (0, 3, None), (0, 4, 8), (0, 5, 8), (0, 6, 9), (1, 4, 8)]
    got = {(r.frame, r.gid): r["class"] for r in R.point_classes(spark.createDataFrame(rows, "frame int, gid int, person int")).collect()}
    assert got == {(0, 1): "junk", (0, 2): "mixed", (0, 3): "partial", (0, 4): "split", (0, 5): "split", (0, 6): "solo", (1, 4): "solo"}
    points = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 0.6, 0.0), (0, 3, 9.0, 9.0)], "frame int, gid int, x double, y double")
    truth = spark.createDataFrame([(0, 5, 0.5, 0.0), (0, 6, 1.5, 0.0)], "frame int, person int, x double, y double")
    assert sorted((r.gid, r.person) for r in R.point_matches(points, truth, 1.0).collect()) == [(1, 5), (2, 6)]


def test_edge_ids_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, f, rng.choice([None, 1, 2, 3])) for k in range(12) for f in range(10)]
    df = spark.createDataFrame(rows, "k int, f int, gid int")
    for tail in (False, True):
        got = {r.k: r.gid for r in R.edge_ids(df, ["k"], "f", 4, tail).collect()}
        for k in range(12):
            ids = [g for _, _, g in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if tail else r[1]) if g][:4]
            counts = Counter(ids)
            assert got.get(k) == next((g for g in ids if counts[g] == max(counts.values())), None)


def test_latency_samples_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(t, float(b), float(b + rng.randint(20, 60))) for t in range(3) for b in np.cumsum([rng.choice([80, 120, 900]) for _ in range(8)])]
    got = sorted(r.latency for r in R.frame_latency_samples(spark.createDataFrame(rows, "tracklet int, t0 double, t4 double")).collect())
    pairs = [(a, b) for t in range(3) for a, b in zip(*(lambda s: (s, s[1:]))(sorted((r for r in rows if r[0] == t), key=lambda r: r[2])))]
    gap = float(np.median([b[2] - a[2] for a, b in pairs]))
    step, want = min(10.0, max(gap / 10, 1.0)), []
    for a, b in pairs:
        at = b[1]
        while at > max(a[1], b[1] - 2 * gap) + 1e-9:
            want.append(b[2] - at)
            at -= step
    assert np.allclose(got, sorted(want))


def test_clock_fits(spark):
    rows = [("a", 100 + 1.002 * p + (0.0 if p % 5 == 2 else 0.3), float(p)) for p in range(2, 60)] + [("a", 500.0, 1.0)] + [("b", 7.5, 0.5), ("b", 8.2, 1.0)]
    got = {r.k: r for r in R.clock_fits(spark.createDataFrame(rows, "k string, t double, p double"), ["k"]).collect()}
    a, b = got["a"], got["b"]
    assert abs(a.drift - 0.002) < 1e-3 and abs(a.offset_s - 100) < 0.1 and a.n_samples == 58 and a.n_bins == 12
    assert (b.drift, b.offset_s, b.n_bins, b.n_samples) == (0.0, 7.0, 1, 2) and abs(b.jitter_ms - 200) < 1e-6


def test_small_reports(spark):
    v = spark.createDataFrame([(1, 2.0, 0.0), (2, 0.0, 2.0), (3, 0.01, 0.0)], "tid int, vx double, vy double")
    h = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "a", "c")], "src_tid int, src string, dst string")
    d = R.fit_exit_directions(h, v, 0.5, 2).first()
    assert np.allclose([d.dx, d.dy], [0.5**0.5] * 2) and d.n == 2
    kinds = spark.createDataFrame([("empty: x",), ("taken",), ("odd: y",), ("threshold: a: b",)], "r string").select(R.reason_kind(F.col("r")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["empty", "", "", "threshold"]
    s = R.sweep_rates(spark.createDataFrame([(0.5, 3, 1)], "cut double, tp int, fp int"), 4, 2).first()
    assert (s.precision, s.retained, s.removed) == (0.75, 0.75, 0.5)
    parts = spark.createDataFrame([("train", "s1"), ("test", "s2")], "part string, session string")
    assert R.check_disjoint(parts).count() == 2
    with pytest.raises(R.LeakageError, match="s1"):
        R.check_disjoint(parts.unionByName(spark.createDataFrame([("test", "s1")], parts.schema)))
    scores = spark.createDataFrame([(0, "a", 70.0, 900.0), (1, "b", 70.0, 800.0), (2, "c", 99.0, 1000.0)], "place int, name string, hota double, p95_ms double")
    assert R.best_setting(scores).first().name == "a"
    with pytest.raises(PySparkException, match="fast enough"):
        R.best_setting(scores, 1.0).collect()
    links = {r.local: r.gid for r in R.perfect_links(spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("a", 3, None), ("a", 4, None)], "cam string, local int, person int")).collect()}
    assert links[1] == links[2] == 10 and links[3] != links[4] and links[3] % 2 == links[4] % 2 == 1


@pytest.fixture(scope="module")
def boxes(spark):
    rows = [("a", 0, "ann", f, float(f), 0.0, f + 10.0, 20.0, f in (0, 9)) for f in range(10)] + [("a", 1, "", f, 5.0, 5.0, 9.0, 9.0, True) for f in (12, 13)] + [("a", 2, "ann", 4, 5.0, 5.0, 9.0, 9.0, True)]
    return spark.createDataFrame(rows, "cam string, track int, person string, frame int, x1 double, y1 double, x2 double, y2 double, keyframe boolean")


def frames(df, track):
    return {r.frame: r for r in df.filter(F.col("track") == track).collect()}


def test_track_edits(boxes):
    out, new = E.split(boxes, "a", 0, 6, "bob")
    assert new == 3 and sorted(frames(out, 0)) == list(range(6)) and sorted(frames(out, 3)) == list(range(6, 10))
    assert frames(out, 0)[5].keyframe and frames(out, 3)[6].keyframe and frames(out, 3)[6].person == "bob"
    for bad in (0, 99):
        with pytest.raises(E.EditError, match="both sides"):
            E.split(boxes, "a", 0, bad)
    hidden = frames(E.hide(boxes, "a", 0, 3, 5), 0)
    assert sorted(hidden) == [0, 1, 2, 6, 7, 8, 9] and hidden[2].keyframe and hidden[6].keyframe
    joined = frames(E.merge(boxes, "a", 1, 0), 1)
    assert len(joined) == 12 and {r.person for r in joined.values()} == {"ann"}
    with pytest.raises(E.EditError, match="the first is 4"):
        E.merge(boxes, "a", 0, 2)
    with pytest.raises(E.EditError, match="no track"):
        E.hide(boxes, "a", 77, 0, 1)


def test_a_set_box_pulls_the_frames_around_it(boxes):
    moved = frames(E.set_box(boxes, "a", 0, 5, (15.0, 0.0, 25.0, 20.0)), 0)
    assert moved[5].x1 == 15 and moved[5].keyframe and moved[2].x1 == 6.0 and moved[7].x1 == 12.0 and (moved[0].x1, moved[9].x1) == (0.0, 9.0)
    linked = frames(E.set_box(boxes, "a", 0, 13, (17.0, 0.0, 27.0, 20.0), link=True), 0)
    assert sorted(linked) == list(range(14)) and [linked[f].x1 for f in (9, 10, 11, 13)] == [9.0, 11.0, 13.0, 17.0] and linked[11].person == "ann"
    alone = frames(E.set_box(boxes, "a", 0, 20, (1.0, 0.0, 2.0, 2.0)), 0)
    assert len(alone) == 11 and alone[9].x1 == 9.0
    with pytest.raises(E.EditError, match="x2 > x1"):
        E.set_box(boxes, "a", 0, 5, (1.0, 0.0, 1.0, 2.0))


def test_edit_issues(boxes):
    assert sorted((r.track, r.issue, r["first"], r["last"], r.n) for r in E.edit_issues(boxes).collect()) == [(1, "no_name", 12, 13, 2), (2, "clash", 4, 4, 1)]
