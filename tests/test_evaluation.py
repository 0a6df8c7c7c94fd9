import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmesh.operators import evaluation as E
from trailmesh.operators import ground as G


def test_zip_frames_needs_alignment(spark):
    a = spark.createDataFrame([("c", 0, 1), ("c", 1, 2)], "cam string, frame int, x int")
    b = a.select("cam", "frame", (F.col("x") * 2).alias("y"))
    assert sorted((r.x, r.y) for r in E.zip_frames(a, b, ["cam", "frame"]).collect()) == [(1, 2), (2, 4)]
    with pytest.raises(Exception, match="not aligned at c 1"):
        E.zip_frames(a, b.filter("frame = 0"), ["cam", "frame"]).collect()


def test_following_row_or_the_last(spark):
    left = spark.createDataFrame([(1, "p", 95), (2, "p", 103), (3, "p", 131), (4, "q", 0)], "id int, k string, t long")
    right = spark.createDataFrame([(10, "p", 94), (11, "p", 100), (12, "p", 130)], "id int, k string, t long")
    got = {r.left_id: (r.right_id, r.gap) for r in E.asof_following(left, right, ["k"], "t", 20, "id", "id").collect()}
    assert got == {1: (11, 5), 3: (12, -1)}


def test_exit_velocity_against_least_squares(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(0, 4000, 30))
    x, y = rng.normal(size=30), rng.normal(size=30)
    rows = [("a", int(i), float(u), float(v)) for i, u, v in zip(t, x, y, strict=True)] + [("b", 0, 1.0, 1.0)]
    got = G.exit_velocity(spark.createDataFrame(rows, "k string, t long, x double, y double"), ["k"], "t", "x", "y", 1500).collect()
    own = t >= t[-1] - 1500
    assert [r.k for r in got] == ["a"]
    assert np.allclose([got[0].vx, got[0].vy], [np.polyfit(t[own] / 1000, v[own], 1)[0] for v in (x, y)])


def test_exit_contradictions(spark):
    c = spark.createDataFrame([(1, "a", "b", -1.0, 0.0), (2, "a", "b", 1.0, 0.0), (3, "a", "b", -0.1, 0.0), (4, "b", "a", -1.0, 0.0)], "id int, src string, dst string, vx double, vy double")
    d = spark.createDataFrame([("a", "b", 1.0, 0.0)], "src string, dst string, dx double, dy double")
    assert {r.id: r.cos for r in G.exit_contradictions(c, d, 0.5, 0.0).collect()} == {1: -1.0, 2: None, 3: None, 4: None}


def test_entry_flags(spark):
    s = spark.createDataFrame([("c", 900.0, 0.0, 300.0, 50.0), ("c", 0.0, 0.0, 10.0, 10.0), ("d", 0.0, 0.0, 1.0, 1.0)], "cam string, x double, y double, w double, h double")
    grids = spark.createDataFrame([("c", 0, 3, 0.9, 10), ("c", 0, 0, 0.9, 2)], "cam string, row int, col int, p_entry double, n int")
    sizes = spark.createDataFrame([("c", 1000.0, 500.0, 2, 4)], "cam string, frame_w double, frame_h double, rows int, cols int")
    assert [r.is_entry for r in G.entry_flags(s, grids, sizes, 0.5, 5).orderBy("cam", F.desc("x")).collect()] == [True, False, False]


def test_suppression_is_greedy(spark):
    rows = [(1, 5, 0.0, 0.0, 2), (1, 6, 1.0, 0.0, 3), (1, 7, 2.0, 0.0, 2), (1, 8, 1.5, 0.0, 1), (2, 1, 0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "f int, gid int, x double, y double, s int")
    assert sorted((r.f, r.gid) for r in G.ground_nms(df, ["f"], "gid", "x", "y", "s", 1.0).collect()) == [(1, 6), (2, 1)]
    assert sorted(r.gid for r in G.ground_nms(df.filter("f = 1"), ["f"], "gid", "x", "y", "s", 0.9).collect()) == [5, 6, 7]


def test_vectors_boxes_and_paths(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, float("nan")],), ([1.0],), ([1.0, float("inf")],), (None,), ([1.0, None],)], "v array<double>")
    assert [r.v is not None for r in df.select(G.sane_embedding(F.col("v"), 2).alias("v")).collect()] == [True, False, False, False, False, False]
    box = lambda *v: tuple(F.lit(float(e)) for e in v)
    one = spark.range(1).select(G.giou(box(0, 0, 1, 1), box(0, 0, 1, 1)).alias("same"), G.giou(box(0, 0, 1, 1), box(3, 0, 1, 1)).alias("far")).first()
    assert one.same == 1.0 and one.far == -0.5
    kept = spark.range(1).select(G.decimated(F.sequence(F.lit(1), F.lit(9)), 4).alias("p")).first().p
    want = []
    for i in range(1, 10):
        want.append(i)
        want = want[::2] if len(want) > 4 else want
    assert kept == want


def test_boxes_between_are_filled(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 4, 8.0), ("a", 20, 1.0), ("b", 3, 2.0)], "k string, f long, x double")
    got = sorted((r.k, r.f, r.x, r.filled) for r in E.interpolate_boxes(df, ["k"], "f", ["x"], 5).collect())
    assert got == [("a", 0, 0.0, False), ("a", 1, 2.0, True), ("a", 2, 4.0, True), ("a", 3, 6.0, True), ("a", 4, 8.0, False), ("a", 20, 1.0, False), ("b", 3, 2.0, False)]


def test_runs_times_and_sizes(spark):
    r = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "run_id string, line int")
    assert [E.select_run(r, k, "line").count() for k in ("last", "all", "y")] == [2, 3, 1]
    t = spark.createDataFrame([(1,), (3,)], "f long").select(E.frame_ts(F.col("f"), 2000.0).alias("t"))
    assert [x.t for x in t.collect()] == [0, 2]
    f = spark.createDataFrame([("c", 5, 640, 480), ("c", 4, 640, 480), ("d", 1, 10, 10)], "cam_id string, ts_ms long, frame_width int, frame_height int")
    c = spark.createDataFrame([("c", 1920, 1080), ("d", 10, 10)], "cam_id string, width int, height int")
    assert [(x.cam_id, x.ts_ms) for x in E.size_mismatches(f, c).collect()] == [("c", 4)]


def test_summary_of_nothing(spark):
    s = E.run_summary(spark.createDataFrame([], "cam string, track int, person int"), "cam", "track", "person", 0).first()
    assert (s.n_detections, s.match_rate, s.recall, s.purity_median) == (0, 0.0, 0.0, 0.0)
