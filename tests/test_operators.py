from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmesh.functions import geometry
from trailmesh.functions.vectors import l2_normalize
from trailmesh.operators.assign import hungarian, match_groups
from trailmesh.operators.association import Associator, Config, associate_offline, transit_ok
from trailmesh.sources import frames
from trailmesh.streaming import online


def test_hungarian_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.normal(size=(n, m)).round(1)
        pairs = hungarian(cost)
        small, large = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))
        assert len(pairs) == min(n, m) and abs(sum(cost[r, c] for r, c in pairs) - best) < 1e-9


def test_match_groups_gates_before_or_after(spark):
    rows = [(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.7), (1, "b", "y", 0.05)]
    df = spark.createDataFrame(rows, "f int, l string, r string, s double")
    assert {(r.l, r.r) for r in match_groups(df, ["f"], "l", "r", "s", 0.3).collect()} == {("a", "y"), ("b", "x")}
    few = match_groups(df.filter("l = 'b'"), ["f"], "l", "r", "s", 0.8, gate_first=True)
    assert few.count() == 0


def test_homography_is_recovered():
    h = np.array([[1.2, 0.1, 3], [0.05, 0.9, -2], [0.001, 0.002, 1]])
    p = np.random.default_rng(2).uniform(0, 100, (12, 2))
    q = np.column_stack([p, np.ones(12)]) @ h.T
    assert np.allclose(geometry.fit_homography(p, q[:, :2] / q[:, 2:]), h)
    with pytest.raises(ValueError):
        geometry.fit_homography(p[:3], p[:3])


def test_normalize_rejects_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert df.select(l2_normalize("v").alias("v")).first().v == [0.6, 0.8]
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(l2_normalize("v")).collect()


def test_transit_bounds():
    c = Config(transitions={("a", "b"): (100, 200)}, overlaps={("a", "c")}, unknown_pairs=False)
    assert [transit_ok(c, "a", "b", e) for e in (99, 100, 200, 201)] == [False, True, True, False]
    assert transit_ok(c, "c", "a", -50) and transit_ok(c, "a", "a", 9) and not transit_ok(c, "b", "a", 150)


def test_association_links_across_sources(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("s", i, cam, t, t + 10, v) for i, (cam, t, v) in enumerate([("c1", 0, a), ("c1", 5, b), ("c2", 5000, a), ("c2", 5001, b), ("c3", 9000, [-0.7, -0.7])])]
    df = spark.createDataFrame(rows, "site string, tid int, cam string, start long, end long, vec array<double>")
    out = {r.tid: r for r in associate_offline(df, Config()).collect()}
    assert out[2].gid == out[0].gid and out[3].gid == out[1].gid and out[0].gid != out[1].gid
    assert out[0].reason == "empty" and out[4].reason in ("threshold", "no_candidate")
    again = {r.tid: r.gid for r in associate_offline(df.orderBy(F.rand(3)), Config()).collect()}
    assert again == {k: r.gid for k, r in out.items()}


def test_same_source_overlap_is_never_merged():
    e = Associator(Config())
    v = np.array([1.0, 0.0])
    got = e.round([dict(cam="c", tid=i, start=0, end=10, vec=v) for i in range(2)])
    assert got[0][0] != got[1][0]
    e.prune(10 + 120_001)
    assert not e.tracks


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{s:02d}") for k in "ab" for s in (0, 1, 2, 30, 31)] + [("z", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "k string, ts string").selectExpr("k", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    out = online.tracklets_of_stream(stream, ["k"], "ts", "5 seconds", "10 seconds", 2)
    q = out.writeStream.format("memory").queryName("tracklets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n_frames) for r in spark.table("tracklets").collect()) == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]


def test_a_step_of_the_gap_stays_in_its_session(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 5, 11)] + [("z", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "k string, ts string").selectExpr("k", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    out = online.tracklets_of_stream(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), ["k"], "ts", "5 seconds", "10 seconds")
    out.writeStream.format("memory").queryName("strict").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n_frames for r in spark.table("strict").collect()) == [1, 2]


def test_upsert_is_idempotent(spark, tmp_path):
    write, read = online.upsert_by_key(str(tmp_path / "t"), ["k"], "t")
    one = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "k string, t int, v int")
    write(one, 0)
    write(one, 0)
    write(spark.createDataFrame([("a", 3, 7), ("b", 1, 1)], "k string, t int, v int"), 1)
    assert sorted((r.k, r.v) for r in read(spark).collect()) == [("a", 7), ("b", 1)]


def test_frame_files(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"schema_version":1,"cam_id":"c","frame_id":0,"ts_ms":1,"detections":[]}\n{"schema_version":1,"cam_id":"c","frame_id":1,"ts_ms":2,"detections":[{"local_track_id":7,"bbox":[1,2,3,4],"confidence":0.5}]}\n')
    d = frames.detections(frames.read_frames(spark, str(tmp_path / "f.jsonl")))
    assert sorted((r.frame_id, r.local_track_id) for r in d.collect()) == [(0, None), (1, 7)]
    (tmp_path / "g.jsonl").write_text('{"schema_version":2,"cam_id":"c"}\n')
    with pytest.raises(Exception, match="schema_version"):
        frames.read_frames(spark, str(tmp_path / "g.jsonl")).collect()


def test_mot_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(pd.DataFrame({"frame": [2, 1], "id": [1, 2], "x": [0.5, 1], "y": [0.0, 1], "w": [1.0, 2], "h": [1.0, 2], "conf": [1.0, 0.5]}))
    frames.write_mot(rows, str(tmp_path / "m"))
    assert sorted((r.frame, r.id, r.a) for r in frames.read_mot(spark, str(tmp_path / "m")).collect()) == [(1, 2, -1.0), (2, 1, -1.0)]


def test_spans_are_kept_by_camera():
    e = Associator(Config(window_ms=10))
    v = np.array([1.0, 0.0])
    first = e.round([dict(cam="a", tid=0, start=0, end=100, vec=v)])[0][0]
    for k in range(1, 10):
        assert e.round([dict(cam=f"c{k}", tid=k, start=200 * k, end=200 * k + 9, vec=v)])[0][0] == first
    assert e.round([dict(cam="a", tid=10, start=50, end=120, vec=v)])[0][0] != first


def test_tracklets_without_vectors_found_identities():
    e = Associator(Config())
    none, v = dict(cam="a", tid=0, start=0, end=1, vec=None), np.array([1.0, 0.0])
    one = e.round([none])[0]
    two = e.round([dict(cam="b", tid=1, start=2, end=3, vec=v)])[0]
    assert one[0] != two[0] and e.round([dict(cam="c", tid=2, start=4, end=5, vec=v)])[0][0] == two[0]


def test_match_groups_over_many_frames(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), int(a), int(b), float(rng.random().__round__(3))) for f in range(40) for a in range(3) for b in range(3) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "f int, l int, r int, s double").repartition(3)
    got = match_groups(df, ["f"], "l", "r", "s", 0.2).toPandas()
    total = got.groupby("f")["s"].sum()
    for f in range(40):
        own = {(a, b): s for g, a, b, s in rows if g == f}
        best = max(tuple(own.get((a, p[a]), 0.0) for a in range(3)) for p in sorted(permutations(range(3)), key=lambda p: sum(own.get((a, p[a]), 0.0) for a in range(3)))[-1:])
        assert abs(sum(s for s in best if s >= 0.2) - total.get(f, 0.0)) < 1e-9
    assert match_groups(df.limit(0), ["f"], "l", "r", "s", 0.2).count() == 0
