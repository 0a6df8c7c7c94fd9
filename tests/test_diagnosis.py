"""Calibration, diagnosis, validation and settings against brute force and by hand."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trailmesh.functions.geometry import fit_homography
from trailmesh.operators import calibration as C
from trailmesh.operators import diagnosis as D
from trailmesh.operators import validation as V
from trailmesh.operators.association import Config, common_distance
from trailmesh.sources import settings


def projected(h, p):
    q = np.hstack([p, np.ones((len(p), 1))]) @ h.T
    return q[:, :2] / q[:, 2:]


def test_fits_equal_the_plain_transform(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for cam in "ab":
        h = np.array([[0.02, -0.001, -3], [0.0005, 0.03, -9], [0.0001, 0.0002, 1]]) + rng.normal(scale=1e-5, size=(3, 3))
        image = rng.uniform(0, 900, (80, 2))
        world = projected(h, image) + rng.normal(scale=0.01, size=(80, 2))
        world[:6] += 5  # feet that are not on the ground
        keep = np.arange(80)
        fit = fit_homography(image, world)
        for _ in range(2):
            e = np.linalg.norm(projected(fit, image[keep]) - world[keep], axis=1)
            keep = keep[np.argsort(e)[: round(len(keep) * 0.9)]]
            fit = fit_homography(image[keep], world[keep])
        e = np.linalg.norm(projected(fit, image[keep]) - world[keep], axis=1)
        want[cam] = (fit.ravel(), len(keep), np.sqrt((e**2).mean()), np.median(e), np.percentile(e, 95))
        rows += [(cam, *p, *q) for p, q in zip(image.tolist(), world.tolist())]
    rows += [("few", 1.0, 2.0, 3.0, 4.0)] * 3
    points = spark.createDataFrame(rows, "cam string, u double, v double, x double, y double").repartition(3)
    got = {r.cam: r for r in C.fit_homographies(points).collect()}
    for cam, (matrix, n, rmse, median, p95) in want.items():
        r = got[cam]
        assert np.allclose(r.matrix, matrix, rtol=1e-4, atol=1e-7) and (r.n_points, r.n_input) == (n, 80)
        assert np.allclose([r.rmse_m, r.median_m, r.p95_m], [rmse, median, p95], rtol=1e-4)
    assert got["few"].matrix is None and got["few"].n_input == 3
    cams = spark.createDataFrame([(c, got[c].matrix) for c in want], "cam string, matrix array<double>")
    check = C.projection_check(points, cams).first()
    e = np.concatenate([np.linalg.norm(projected(np.reshape(got[c].matrix, (3, 3)), np.array([r[1:3] for r in rows if r[0] == c])) - np.array([r[3:] for r in rows if r[0] == c]), axis=1) for c in want])
    assert np.allclose([check.p50_m, check.p95_m, check.pair_p95_m], [np.median(e), np.percentile(e, 95), np.percentile(e, 95) * 2**0.5])


def test_fits_write_no_point(spark, monkeypatch):
    """Repeated points at the cut stay as often as they fit in; what is computed ahead has a row a camera, not a row a point."""
    sizes, real = [], C.computed_once
    for module in (C, C.ranks):
        monkeypatch.setattr(module, "computed_once", lambda df: sizes.append((out := real(df)).count()) or out, raising=False)
    rng = np.random.default_rng(9)
    h = np.array([[0.02, -0.001, -3], [0.0005, 0.03, -9], [0.0001, 0.0002, 1]])
    image = rng.uniform(0, 900, (60, 2))
    world = projected(h, image) + rng.normal(scale=0.01, size=(60, 2))
    rows = [("a", *p, *q) for p, q in zip(image.tolist(), world.tolist())] * 7
    image, world = np.repeat(image, 7, 0), np.repeat(world, 7, 0)
    keep, fit = np.arange(420), fit_homography(image, world)
    for _ in range(2):
        e = np.linalg.norm(projected(fit, image[keep]) - world[keep], axis=1)
        keep = keep[np.argsort(e, kind="stable")[: round(len(keep) * 0.9)]]
        fit = fit_homography(image[keep], world[keep])
    e = np.linalg.norm(projected(fit, image[keep]) - world[keep], axis=1)
    points = spark.createDataFrame(rows, "cam string, u double, v double, x double, y double").repartition(3)
    r = C.fit_homographies(points).first()
    assert (r.n_points, r.n_input) == (len(keep), 420) and len(keep) % 7
    assert np.allclose(r.matrix, fit.ravel(), rtol=1e-4, atol=1e-7)
    assert np.allclose([r.rmse_m, r.median_m, r.p95_m], [np.sqrt((e**2).mean()), np.median(e), np.percentile(e, 95)], rtol=1e-4)
    assert sizes and max(sizes) == 1


def test_correspondences(spark):
    boxes = spark.createDataFrame([("a", 10.0, 20.0, 30.0, 50.0, 481), ("a", 1.0, 20.0, 30.0, 50.0, 0), ("a", 10.0, 20.0, 30.0, 79.0, 0)], "cam string, x double, y double, w double, h double, position long")
    assert [tuple(r) for r in C.correspondences(boxes, 100, 100).collect()] == [("a", 25.0, 70.0, -2.975, -8.975)]


def test_identities_that_are_no_person(spark):
    boxes = [("c", 1, 7)] * 20 + [("c", 2, None)] * 9 + [("c", 2, 7)] + [("c", 3, 7)] * 6 + [("c", 3, 8)] * 6 + [("c", 4, 5)] * 3
    votes = D.track_votes(spark.createDataFrame(boxes, "cam string, local int, person int"))
    seen = [(1, "c", 1, 20), (1, "c", 2, 10), (2, "c", 2, 10), (2, "c", 3, 10), (3, "c", 9, 5), (4, "c", 4, 3)]
    v = D.track_verdicts(spark.createDataFrame(seen, "gid int, cam string, local int, n_frames int"), votes)
    assert sorted((r.gid, r.local, r["class"], r.why) for r in v.collect()) == [(1, 1, "person", "eligible"), (1, 2, "detector", ""), (2, 2, "detector", ""), (2, 3, "person", "impure"), (3, 9, "missing", ""), (4, 4, "person", "few_frames")]
    assert {r.gid: (r["class"], r.frames) for r in D.identity_verdicts(v).collect()} == {1: ("person", 30), 2: ("detector", 20), 3: ("detector", 5), 4: ("person", 3)}
    assert {r.local: r.person for r in votes.collect()} == {1: 7, 2: 7, 3: 7, 4: 5}


def test_false_positive_regions(spark):
    kind = "cam string, frame int, box int, x double, y double, w double, h double"
    truth = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, 10.0, 10.0)], kind)
    found = [("a", 0, 1, 1.0, 0.0, 10.0, 10.0), ("a", 0, 2, 6.0, 0.0, 10.0, 10.0), ("a", 0, 3, 50.0, 0.0, 10.0, 10.0), ("a", 1, 1, 90.0, 0.0, 10.0, 10.0)]
    cams = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "cam string, matrix array<double>")
    got = {r.bucket: r.n for r in D.false_positive_regions(spark.createDataFrame(found, kind), truth, cams, F.col("gx") < 80).collect()}
    assert got == {"tp": 1, "near_truth": 1, "no_truth": 1, "outside": 1}


def test_pair_geometry_equals_brute_force(spark):
    rng = random.Random(8)
    tracks = [(0, i, "ab"[i % 2], i // 2 % 3, s := rng.randint(0, 300), s + rng.randint(0, 200)) for i in range(14)]
    points = [(t[1], ts, rng.uniform(0, 4), rng.uniform(0, 4)) for t in tracks if t[1] != 5 for ts in sorted(rng.sample(range(t[4], t[5] + 1), min(6, t[5] - t[4] + 1)))]
    df = spark.createDataFrame(tracks, "session int, tid int, cam string, person int, start long, end long")
    pairs = D.sampled_pairs(df, 12, 3)
    out = D.pair_geometry(pairs, spark.createDataFrame(points, "tid int, ts long, x double, y double"), df, 10, 2.0, 5.0).collect()
    assert sum(not r.same for r in out) == 12 and sorted(D.sampled_pairs(df, 12, 3).collect()) == sorted(pairs.collect())
    assert sum(r.same for r in out) == sum(a[3] == b[3] and a[2] != b[2] for a in tracks for b in tracks if a[1] < b[1])
    span = {t[1]: t[4:] for t in tracks}
    for r in out:
        own = {s: tuple(p[1:] for p in points if p[0] == s) for s in (r.a, r.b)}
        synced = common_distance(own[r.a], own[r.b], 10)
        assert (r.synced_m is None) == (synced is None) and (synced is None or abs(r.synced_m - synced) < 1e-9)
        first, second = (r.a, r.b) if span[r.a][1] <= span[r.b][1] else (r.b, r.a)
        gap = max(0, span[second][0] - span[first][1])
        far = np.hypot(own[first][-1][1] - own[second][0][1], own[first][-1][2] - own[second][0][2]) if own[first] and own[second] else None
        allow = synced <= 2 if synced is not None else far is None or far <= 2 + 5 * gap / 1000
        assert (r.gap_ms, r.feasible_reject, r.feasible_allow) == (gap, synced is not None and synced <= 2, bool(allow))
    ceiling = {r.same: r for r in D.evidence_ceiling(spark.createDataFrame(out)).collect()}
    assert ceiling[False].n_pairs == 12 and abs(ceiling[True].feasible_allow - np.mean([r.feasible_allow for r in out if r.same])) < 1e-12


def test_pairs_are_made_where_tracklets_lie(spark, monkeypatch):
    """Neither pairs nor their points are shuffled, tasks grow with the tracklets, and one task sorts few of the drawn pairs."""
    rng = random.Random(2)
    tracks = [(i // 40, i, "ab"[i % 2], i // 4 % 10, s := rng.randint(0, 900), s + 40, [(t, rng.random(), rng.random()) for t in sorted(rng.sample(range(s, s + 40), 1 + i % 3))]) for i in range(200)]
    df = spark.createDataFrame(tracks, "session int, tid int, cam string, person int, start long, end long, path array<struct<ts: long, x: double, y: double>>").cache()
    sizes = []
    monkeypatch.setattr(D, "TRACKLETS", 10)
    monkeypatch.setattr(D, "computed_once", lambda d: sizes.append(d._jdf.queryExecution().optimizedPlan().toString()) or d)
    pairs = D.sampled_pairs(df, 7, 3, ("start", "end", "path"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"xxhash64\(3, session[^)]*\) < -?\d", sizes[0])
    out = D.geometry(pairs.filter("same"), 10, 0.3, 5.0)
    assert plan(out).count("Exchange hashpartitioning") == 2 and out.rdd.getNumPartitions() == 20
    points = df.select("tid", F.explode("path").alias("p")).select("tid", "p.*")
    plain = D.pair_geometry(pairs.select("session", "a", "b", "same"), points, df, 10, 0.3, 5.0)
    key = lambda r: (r.a, r.b)
    assert sorted(D.geometry(pairs, 10, 0.3, 5.0).collect(), key=key) == sorted(plain.collect(), key=key)
    every = [(a, b) for a in tracks for b in tracks if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]]
    assert D._negatives(df) == sum(a[3] != b[3] for a, b in every)
    draw = {(r.a, r.b): r.h for r in spark.createDataFrame([(a[0], a[1], b[1]) for a, b in every if a[3] != b[3]], "session int, a int, b int").withColumn("h", F.xxhash64(F.lit(3), "session", "a", "b")).collect()}
    assert {(r.a, r.b) for r in pairs.filter("NOT same").collect()} == set(sorted(draw, key=draw.get)[:7])
    few = D.sampled_pairs(df.filter("tid < 6"), 100, 3)
    assert few.filter("NOT same").count() == sum(a[3] != b[3] for a, b in every if b[1] < 6)


DET = "array<struct<local_track_id: bigint, x: double, y: double, w: double, h: double, confidence: double, embedding: array<float>>>"


def test_frame_contract(spark):
    good, unit = (1, 0.0, 0.0, 10.0, 10.0, 0.5, None), [1.0, 0.0]
    rows = [
        (0, 1, "a", 100, 100, 5, 2, [good, (2, 0.0, 0.0, 10.0, 10.0, 1.0, unit)]),
        (1, 2, "", 0, 100, 0, 2, []),
        (2, 1, "a", 100, 100, 5, 2, [good, good, (3, 0.0, 0.0, 0.0, 5.0, 1.5, [1.0, 1.0]), (4, 95.0, 0.0, 10.0, 5.0, -1.0, [1.0])]),
        (3, 1, "a", 100, 100, 5, 0, [(1, -2.0, 0.0, 103.9, 5.0, 0.0, [1.0])]),
        (4, None, None, None, None, None, None, None),
    ]
    df = V.frame_issues(spark.createDataFrame(rows, f"i int, schema_version int, cam_id string, frame_width int, frame_height int, ts_ms long, embed_dim int, detections {DET}"))
    got = {r.i: r.issues for r in df.collect()}
    assert got[0] == [] and got[1] == ["version", "camera", "frame_size", "ts"] and got[3] == [] and got[4] == ["version", "camera", "frame_size", "ts"]
    assert got[2] == ["duplicate:1", "box_side:3", "confidence:3", "norm:3", "overflow:4", "confidence:4", "dimension:4"]
    assert V.strictly(df.filter("i = 0")).count() == 1
    with pytest.raises(PySparkException, match="norm:3"):
        V.strictly(df.filter("i = 2")).collect()


def test_ground_regions(spark):
    d = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0), ("a", 4.0, 0.0, 2.0, 2.0), ("b", 99.0, 0.0, 2.0, 2.0)], "cam string, x double, y double, w double, h double")
    cams = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "cam string, matrix array<double>")
    topology = {"cameras": {"a": {"ground_roi": {"x_m": [0, 5]}}, "b": None}}
    rois = settings.regions(spark, topology)
    kept = lambda m: sorted((r.cam, r.x, r.kept) for r in V.in_region(d, cams, rois, m).collect())
    assert kept(0.0) == [("a", 0.0, True), ("a", 4.0, False), ("b", 99.0, True)] and kept(0.5)[1][2]
    assert {r.cam: (r.n_dropped, r.n_total) for r in V.dropped_by_camera(V.in_region(d, cams, rois)).collect()} == {"a": (1, 2), "b": (0, 1)}
    with pytest.raises(PySparkException, match="without a calibration"):
        V.in_region(d, cams.limit(0), rois).collect()
    for bad in ({"x": [0, 1]}, {"x_m": [3, 1]}):
        with pytest.raises(ValueError, match="ground_roi"):
            settings.regions(spark, {"cameras": {"a": {"ground_roi": bad}}})


def test_settings_files(spark, tmp_path):
    topology = {"cameras": {"a": {"overlaps_with": ["b"]}, "b": {"overlaps_with": ["a"]}, "c": {}}, "transitions": [{"from": "a", "to": "c", "min_ms": 5, "max_ms": 9, "bidirectional": True}], "unknown_pair_policy": "reject"}
    (tmp_path / "t.json").write_text(json.dumps(topology))
    c = settings.with_topology(Config(), settings.load_mapping(spark, str(tmp_path / "t.json")))
    assert c.overlapping("a", "b") and c.transitions == {("a", "c"): (5, 9), ("c", "a"): (5, 9)} and not c.unknown_pairs
    for change, told in ((("cameras", {"a": {"overlaps_with": ["b"]}, "b": {}, "c": {}}), "overlaps"), (("unknown_pair_policy", "x"), "policy"), (("transitions", [{"from": "a", "to": "z", "max_ms": 1}]), "unknown camera"), (("transitions", [{"from": "a", "to": "c", "min_ms": 3, "max_ms": 1}]), "transition")):
        with pytest.raises(ValueError, match=told):
            settings.with_topology(Config(), topology | dict([change]))
    errors = {"kind": "ground_sigma", "fit_date": "x", "pairs": {"b|a": {"cell_m": 1, "sigma_ref": 2, "default": {"mu": [0, 1], "sigma": 4}, "cells": [{"ix": 1, "iy": 0, "mu": [1, 0], "sigma": 2}]}}}
    ways = {"kind": "exit_direction", "window_ms": 500, "min_speed_m_s": 0.5, "min_cos": 0.1, "pairs": {"a>c": {"direction": [1, 0]}}}
    c = settings.with_learned(c, errors, ways)
    assert c.ground_errors["a", "b"]["cells"] == {(1, 0): (1.0, 0.0, 2.0)} and c.directions == {("a", "c"): (1.0, 0.0)} and c.direction_rule == (500, 0.5, 0.1)
    with pytest.raises(ValueError, match="kind"):
        settings.with_learned(c, ways)
    assert settings.settings_hash({"a": 1}, {"m": errors}) == settings.settings_hash({"a": 1}, {"m": errors | {"fit_date": "y"}}) != settings.settings_hash({"a": 2}, {"m": errors})
    assert settings.with_override({"a": {"b": 1, "c": 2}}, "a.b", 5) == {"a": {"b": 5, "c": 2}}
    with pytest.raises(KeyError):
        settings.with_override({"a": {}}, "a.z", 1)
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.yaml").write_text(json.dumps({"cam_id": "a", "matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "image_size": [640, 480]}))
    assert [tuple(r) for r in settings.calibrations(spark, str(tmp_path / "h")).collect()] == [("a", [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], 640, 480)]


def test_output_records_round_trip(spark, tmp_path):
    row = (1, "a", 2, 3, 4, [1.0, 2.0, 3.0, 4.0], [0.0, 1.0], 0.5, True, False, 2, "empty")
    df = spark.createDataFrame([row], settings.UPDATE)
    settings.write_updates(df, str(tmp_path / "u"))
    assert settings.read_updates(spark, str(tmp_path / "u")).collect() == df.collect()
    (tmp_path / "v.json").write_text('{"global_id":1,"cam_id":"a","local_track_id":2,"tracklet_id":3,"ts_ms":4,"bbox":[1,2,3,4]}\n')
    assert tuple(settings.read_updates(spark, str(tmp_path / "v.json")).first())[6:] == ([0.0, 0.0], 0.0, False, False, 1, "")
    (tmp_path / "w.json").write_text('{"global_id":1,"bbox":[1,2]}\n')
    with pytest.raises(PySparkException, match="four numbers"):
        settings.read_updates(spark, str(tmp_path / "w.json")).collect()
