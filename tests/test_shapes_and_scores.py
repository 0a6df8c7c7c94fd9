"""Footprints, keyframes, box clusters, tracking scores, separability, lags and annotation files."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trailmesh.operators import separability, shapes, signals
from trailmesh.operators import tracking_scores as T
from trailmesh.operators.assign import hungarian
from trailmesh.sources import annotations

BOXES = "seq string, frame int, id int, x double, y double, w double, h double"


def iou(a, b):
    w, h = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    size = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return w * h / (size(a) + size(b) - w * h)


def test_footprints(spark):
    flat = [0.01, 0.0, 0.0, 0.0, 0.02, 0.0, 0.0, 0.0, 1.0]  # a centimetre a pixel across, two down
    rows = [("whole", flat, 400, 200), ("coarse", [v * 9 for v in flat[:8]] + [1.0], 400, 200), ("behind", [*flat[:8], -1.0], 400, 200), ("wide", flat, 60_000, 200)]
    tilted = [0.01, 0.0, 0.0, 0.0, 0.01, 0.0, 0.0, 0.004, 0.2]
    out = {r.cam: r for r in shapes.footprints(spark.createDataFrame([*rows, ("tilted", tilted, 400, 200)], "cam string, matrix array<double>, width int, height int")).withColumn("area", shapes.area(F.col("polygon"))).collect()}
    assert abs(out["whole"].area - 4.0 * 4.0) < 1e-9 and out["whole"].cut == 0
    assert out["coarse"].cut is None and out["coarse"].polygon == [] and out["behind"].polygon == [] and out["behind"].area == 0
    assert abs(out["wide"].area - 200 * 4.0) < 1e-9 and max(p.x for p in out["wide"].polygon) == 200
    ground = lambda v: 0.01 * v / (0.004 * v + 0.2)
    x = lambda v: 0.01 * 200 / (0.004 * v + 0.2)
    size = lambda v: np.hypot(ground(v) - ground(v - 1), x(v) - x(v - 1))
    v = 200.0
    while v - 1 >= 0 and size(v - 1) <= 0.05:
        v -= 1
    assert out["tilted"].cut == v


def test_keyframes_keep_every_box_overlapped(spark):
    rng = random.Random(6)
    rows = []
    for track in range(6):
        x, y = 100.0, 100.0
        for frame in range(0, 120, 2):
            x, y = x + rng.uniform(-6, 12), y + rng.uniform(-5, 6)
            if not (track == 3 and 40 <= frame < 60):
                rows.append((track, frame, x, y, x + 40, y + 90 + rng.uniform(0, 9)))
    df = spark.createDataFrame(rows, "track int, frame int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    keys = shapes.keyframes(df, ["track"], "frame", 2, 200, 0.7).collect()
    assert len(keys) < len(rows) / 2
    for track in range(6):
        own = sorted((k.frame, k.outside, tuple(k)[2:6]) for k in keys if k.track == track)
        true = {f: b for t, f, *b in rows if t == track}
        assert sum(o for _, o, _ in own) == (2 if track == 3 else 1)
        for (f0, o0, a), (f1, _, b) in itertools.pairwise(own):
            if not o0:
                for f in range(f0, f1 + 1, 2):
                    if f in true:
                        t = (f - f0) / (f1 - f0)
                        assert iou([p + (q - p) * t for p, q in zip(a, b)], true[f]) >= 0.7 - 1e-9 or f == f1
    assert shapes.keyframe_places(np.array([0]), np.zeros((1, 4)), 0.5) == [0]


def test_cleaned_tracks(spark):
    rows = [(7, f, 10.0) for f in (5, 6, 7)] + [(3, f, 10.0) for f in (1, 2)] + [(9, f, 10.0) for f in (2, 3, 4)] + [(9, 1, 1.0)]
    out = shapes.cleaned_tracks(spark.createDataFrame(rows, "track int, frame int, foot double"), "track", "frame", "foot", 3, 5.0).collect()
    assert sorted((r.track, r.frame) for r in out) == [(0, 2), (0, 3), (0, 4), (1, 5), (1, 6), (1, 7)]


def test_box_clusters_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(f, i, rng.randint(0, 60) * 1.0, rng.randint(0, 60) * 1.0, 30.0, 30.0, rng.randint(0, 5) / 5) for f in range(12) for i in range(9)]
    got = shapes.box_clusters(spark.createDataFrame(rows, "frame int, id int, x double, y double, w double, h double, score double"), ["frame"], "id", "score", 0.4, 4).collect()
    for f in range(12):
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[6], r[1])):
            if len(kept) < 4 and all(iou([r[2], r[3], r[2] + 30, r[3] + 30], [k[2], k[3], k[2] + 30, k[3] + 30]) < 0.4 for k in kept):
                kept.append(r)
        assert sorted((r.place, r.id) for r in got if r.frame == f) == [(i, k[1]) for i, k in enumerate(kept)]


def box(seq, frame, i, x=0.0, y=0.0):
    return (seq, frame, i, float(x), float(y), 10.0, 10.0)


def scores(spark, truth, found):
    a, b = spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, BOXES)
    return {r.seq: r for r in T.hota_means(T.hota(a, b)).collect()}, {r.seq: r for r in T.identity_f1(a, b).collect()}, {(r.seq, r.alpha): r for r in T.hota(a, b).collect()}


def test_scores_of_worked_examples(spark):
    truth = [box(s, f, 1) for s in ("same", "split", "half", "none") for f in range(4)]
    found = [box("same", f, 9) for f in range(4)] + [box("split", f, 8 + f // 2) for f in range(4)] + [box("half", f, 9) for f in range(2)] + [box("extra", 0, 5)]
    mean, ids, each = scores(spark, truth, found)
    assert (mean["same"].hota, ids["same"].idf1) == (1.0, 1.0)
    # Two halves of two frames: each match shares 2 of 4 frames, so association is a half; detection is whole.
    assert abs(mean["split"].ass_a - 0.5) < 1e-9 and mean["split"].det_a == 1.0 and abs(mean["split"].hota - 0.5**0.5) < 1e-9
    assert (ids["split"].idtp, ids["split"].idfn, ids["split"].idfp, ids["split"].idf1) == (2, 2, 2, 0.5)
    assert abs(mean["half"].det_a - 0.5) < 1e-9 and abs(mean["half"].ass_a - 0.5) < 1e-9 and ids["half"].idf1 == 4 / 6
    assert mean["none"].hota == 0 and (each["none", 0.5].fn, each["extra", 0.5].fp) == (4, 1) and ids["extra"].idf1 == 0


def test_scores_fall_with_localisation(spark):
    _, _, each = scores(spark, [box("s", f, 1) for f in range(3)], [box("s", f, 1, x=2.5) for f in range(3)])
    similarity = 7.5 / 12.5
    assert [each["s", a / 100].tp for a in T.ALPHAS] == [3 if a / 100 <= similarity + 1e-9 else 0 for a in T.ALPHAS]


def test_identities_cross_over(spark):
    # Two people, the tracker swaps them for the last quarter.
    truth = [box("s", f, p, x=50 * p) for f in range(8) for p in (0, 1)]
    found = [box("s", f, (p if f < 6 else 1 - p) + 10, x=50 * p) for f in range(8) for p in (0, 1)]
    mean, ids, _ = scores(spark, truth, found)
    assert ids["s"].idtp == 12 and abs(ids["s"].idf1 - 0.75) < 1e-9
    assert abs(mean["s"].ass_a - (12 * 6 / 10 + 4 * 2 / 14) / 16) < 1e-9


def test_virtual_frames_and_identities(spark):
    rows = spark.createDataFrame([("b", 0, 5), ("a", 0, 5), ("a", 1499, 9)], "cam string, frame bigint, ts bigint").withColumn("local", F.lit(1))
    out = {(r.cam, r.frame): r.virtual for r in T.virtual_frames(rows).collect()}
    assert out == {("a", 0): 1, ("a", 1499): 1500, ("b", 0): 10_001}
    spans = spark.createDataFrame([("a", 1, 0, 6, 3), ("a", 1, 5, 9, 4)], "cam string, local int, start bigint, end bigint, gid bigint")
    assert sorted((r.cam, r.ts, r.gid) for r in T.identified(rows, spans).collect() if r.gid) == [("a", 5, 3), ("a", 9, 4)]


def test_separability_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(2):
        for i in range(40):
            v = rng.normal(size=4) + 3 * np.eye(4)[i % 4]
            start = int(rng.integers(0, 100))
            rows.append((s, i, "abc"[int(rng.integers(3))], i % 4, start, start + int(rng.integers(1, 30)), (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame(rows, "session int, tid int, cam string, person int, start bigint, end bigint, vec array<double>")
    got = {(r.session, r.tid, r.mode): r for r in separability.nearest(df, block=7).collect()}
    for q in rows:
        for mode in ("cross", "same_camera"):
            gallery = [g for g in rows if g[0] == q[0] and (g[2] != q[2] if mode == "cross" else g[2] == q[2] and g[1] != q[1] and (g[5] < q[4] or g[4] > q[5]))]
            far = {True: [], False: []}
            for g in gallery:
                far[g[3] == q[3]].append(1 - float(np.dot(q[6], g[6])))
            r = got[q[0], q[1], mode]
            assert (r.n_right, r.n_wrong) == (len(far[True]), len(far[False]))
            assert np.allclose([r.right, r.wrong], [min(far[True], default=np.inf), min(far[False], default=np.inf)])
    table = {r.mode: r for r in separability.rank_one(separability.nearest(df, block=7), 0.4).collect()}
    own = [r for r in got.values() if r.mode == "cross" and r.n_right]
    assert table["cross"].n == len(own) and abs(table["cross"].rank1 - np.mean([r.right <= r.wrong for r in own])) < 1e-12


def test_early_vectors(spark):
    rows = [(1, 0, 0.5, [1.0, 0.0]), (1, 1, 0.9, [0.0, 1.0]), (1, 2, 0.9, [3.0, 0.0])]
    out = {r.first_n: r.vec for r in separability.early_vectors(spark.createDataFrame(rows, "t int, o int, confidence double, vec array<double>"), ["t"], "o", (1, 3), 2).collect()}
    assert out[1] == [1.0, 0.0] and np.allclose(out[3], np.array([3.0, 1.0]) / 10**0.5)


def test_planted_lags_are_found(spark):
    rng, rate = np.random.default_rng(5), 1000
    base = rng.normal(scale=0.01, size=20_000)
    for at in (3000, 7100, 15_500):
        base[at : at + 60] += rng.normal(size=60)
    late, early = np.concatenate([rng.normal(scale=0.01, size=1500), base])[:20_000] * 0.2, base[700:]
    rows = [("s", "a", base.tolist()), ("s", "b", late.tolist()), ("s", "c", early.tolist()), ("t", "a", [0.0] * 3), ("t", "b", None)]
    lags = signals.recording_lags(spark.createDataFrame(rows, "session string, cam string, samples array<double>"), "a", rate)
    got = {(r.session, r.cam): r for r in lags.collect()}
    assert abs(got["s", "b"].lag_s - 1.5) <= 0.011 and abs(got["s", "c"].lag_s + 0.7) <= 0.011 and got["s", "a"].lag_s == 0
    assert got["s", "b"].confidence > 2 and got["t", "b"].lag_s is None
    window = signals.common_window(lags.filter("session = 's'")).first()
    assert abs(window.start_s - 0.7) < 0.02 and abs(window.end_s - 18.5) < 0.02


def test_lag_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.normal(size=rng.integers(1, 12)), rng.normal(size=rng.integers(1, 12))
        value = lambda k: sum(a[i] * b[i + k] for i in range(len(a)) if 0 <= i + k < len(b))
        lags = [k for k in range(1 - len(a), len(b)) if abs(k) <= 5]
        assert signals.best_lag(a, b, 5, 1)[0] == max(lags, key=value)


def test_sync_plan(spark):
    fits = spark.createDataFrame([("s", "a", 100.0, 0.0, 60.0), ("s", "b", 98.0, 0.001, 60.0), ("t", "a", 0.0, 0.0, 1.0), ("t", "b", 50.0, 0.0, 1.0)], "session string, cam string, offset_s double, drift double, duration_s double")
    out = {r.cam: r for r in signals.sync_plan(fits, "a").collect()}
    assert set(out) == {"a", "b"} and out["a"].lag_s == 0 and (out["b"].start_s, out["b"].end_s) == (100.0, 158.06)
    wall = (100 + 158.06) / 2
    assert abs(out["b"].lag_s - ((wall - 98) / 1.001 - (wall - 100))) < 1e-9 and out["b"].edge_error_ms > 20


def test_annotation_round_trip(spark, tmp_path):
    keys = [(t, f, 10.0 * t, 5.0, 10.0 * t + 20.25, 60.0, f == 9) for t in (0, 1) for f in (0, 4, 9)]
    path = str(tmp_path / "xml")
    annotations.write_tracks(spark.createDataFrame(keys, "track bigint, frame bigint, x1 double, y1 double, x2 double, y2 double, outside boolean"), path)
    got = annotations.read_tracks(spark, path).collect()
    assert sorted((r.track, r.frame, r.x, r.y, r.w, r.h, r.person) for r in got) == [(t, f, 10.0 * t, 5.0, 20.25, 55.0, "") for t in (0, 1) for f in (0, 4)]


XML = """<annotations><version>1.1</version><meta><task><start_frame>10</start_frame><stop_frame>30</stop_frame><frame_filter>step=5</frame_filter>
<original_size><width>640</width><height>480</height></original_size></task></meta>
<track id="3" label="person"><attribute name="person_id">ann</attribute>
<box frame="{a}" outside="0" occluded="1" xtl="1" ytl="2" xbr="4" ybr="8"><attribute name="person_id"></attribute></box>
<box frame="{b}" outside="1" occluded="0" xtl="1" ytl="2" xbr="4" ybr="8"></box></track>
<track id="4" label="person"><box frame="{b}" outside="0" occluded="0" xtl="1" ytl="2" xbr="{x}" ybr="8"><attribute name="person_id"> bob </attribute></box></track>
<track id="5" label="dog"><box frame="0" outside="0" occluded="0" xtl="1" ytl="2" xbr="4" ybr="8"></box></track></annotations>"""


def test_annotations_by_hand(spark, tmp_path):
    for name, a, b, x in (("abs", 10, 30, 4), ("rel", 0, 4, 4), ("stray", 11, 900, 4), ("hole", 10, 30, "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.xml").write_text(XML.format(a=a, b=b, x=x))
    for name in ("abs", "rel"):
        boxes, meta = annotations.read_tracks(spark, str(tmp_path / name)), annotations.read_meta(spark, str(tmp_path / name))
        assert tuple(meta.drop("file").first()) == (10, 30, 5, 640, 480)
        out = sorted(annotations.to_video_frames(boxes, meta).collect())
        assert [(r.track, r.frame, r.person, r.numbering, r.occluded) for r in out] == [(3, 10, "ann", name, True), (4, 30, "bob", name, False)]
        assert sorted((r.track, r.gid) for r in annotations.person_numbers(boxes).collect()) == [(3, 1), (4, 2)]
    stray = annotations.to_video_frames(annotations.read_tracks(spark, str(tmp_path / "stray")), annotations.read_meta(spark, str(tmp_path / "stray")))
    with pytest.raises(PySparkException, match="not of the task"):
        stray.collect()
    with pytest.raises(PySparkException, match="without a number"):
        annotations.read_tracks(spark, str(tmp_path / "hole")).collect()
    twice = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b")], "file string, track bigint, person string")
    with pytest.raises(PySparkException, match="several identities"):
        annotations.person_numbers(twice).collect()


def test_position_files(spark, tmp_path):
    view = lambda n, *b: dict(zip(("viewNum", "xmin", "ymin", "xmax", "ymax"), (n, *b)))
    (tmp_path / "00000005.json").write_text(json.dumps([{"personID": 7, "positionID": 456, "views": [view(0, 1, 2, 5, 9), view(1, -1, -1, -1, -1)]}]))
    got = annotations.read_positions(spark, str(tmp_path)).drop("file").collect()
    assert [tuple(r) for r in got] == [(5, 7, 456, 0, 1.0, 2.0, 4.0, 7.0)]


def test_a_small_file_of_cameras_goes_to_all_tasks(spark):
    h = [0.02, 0.0, -3.0, 0.0, 0.03, -9.0, 0.0, 0.0002, 1.0]
    cams = spark.createDataFrame([(i, [x * (1 + i / 50) for x in h], 640, 480) for i in range(40)] + [(40, None, 640, 480)], "cam int, matrix array<double>, width int, height int").coalesce(1)
    out = shapes.footprints(cams, metres_per_pixel=0.04, reach_m=6.0)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = {r.cam: r.cut for r in out.collect()}
    assert found.pop(40) is None
    for cam, cut in found.items():
        m = np.array([x * (1 + cam / 50) for x in h]).reshape(3, 3)
        at = lambda v, m=m: (m @ [320, v, 1])[:2] / (m @ [320, v, 1])[2]
        rows = [480 - i * 2.4 for i in range(201)]
        fine = [np.hypot(*(at(v) - at(v - 1))) <= 0.04 for v in rows]
        last = (fine.index(False) if False in fine else 201) - 1
        assert cut == (rows[last] if last >= 0 else None)


def test_hota_over_stretches_equals_brute_force(spark):
    rng = random.Random(4)
    frames = [("a", f) for f in (0, 1, 998, 999, 1000, 1001, 2500)] + [("b", f) for f in (-1, 0, 7)]
    boxes = lambda ids: [box(s, f, i, rng.randint(0, 12), rng.randint(0, 3)) for s, f in frames for i in ids if rng.random() < 0.8]
    truth, found = boxes((1, 2, 3)), boxes((11, 12, 13, 14))
    n = lambda rows, s, i: sum(r[0] == s and r[2] == i for r in rows)
    _, _, each = scores(spark, truth, found)
    for s in "ab":
        at, common = {}, {}
        for f in {f for q, f in frames if q == s}:
            g, p = ([r for r in rows if r[:2] == (s, f)] for rows in (truth, found))
            m = np.array([[iou([a[3], a[4], a[3] + 10, a[4] + 10], [b[3], b[4], b[3] + 10, b[4] + 10]) for b in p] for a in g]).reshape(len(g), len(p))
            at[f] = ([r[2] for r in g], [r[2] for r in p], m)
            for i, j in zip(*np.nonzero(m), strict=True):
                key = g[i][2], p[j][2]
                common[key] = common.get(key, 0) + m[i, j] / (m[i].sum() + m[:, j].sum() - m[i, j])
        align = lambda a, b: common[a, b] / (n(truth, s, a) + n(found, s, b) - common[a, b]) if (a, b) in common else 0.0  # noqa: B023, E731
        hits = []
        for g, p, m in at.values():
            if m.size:
                value = m * [[align(a, b) for b in p] for a in g]
                hits += [(g[i], p[j], m[i, j]) for i, j in hungarian(-value) if value[i, j] > 0]
        for a in T.ALPHAS:
            kept = [(g, p) for g, p, v in hits if v >= a / 100 - 1e-9]
            ass = sum(kept.count(k) / (n(truth, s, k[0]) + n(found, s, k[1]) - kept.count(k)) for k in kept) / max(len(kept), 1)
            assert each[s, a / 100].tp == len(kept) and abs(each[s, a / 100].ass_a - ass) < 1e-9


def test_boxes_of_unknown_place_are_counted_and_match_nothing(spark):
    truth = [box("s", 0, 1), box("s", None, 1), box("s", 0, None, 50), box(None, 0, 1)]
    found = [box("s", 0, 9), box("s", None, 9), box("s", 0, 8, 50), box(None, 0, 9), box(None, 1, 9)]
    out = T.hota(spark.createDataFrame(truth, BOXES), spark.createDataFrame(found, BOXES)).filter("alpha = 0.5").collect()
    assert sorted(((r.seq or ""), r.tp, r.fn, r.fp) for r in out) == [("", 0, 0, 2), ("", 0, 1, 0), ("s", 1, 2, 2)]
    assert abs(next(r.ass_a for r in out if r.seq) - 1 / 3) < 1e-9  # 1 frame of 2 and 2


def test_hota_shuffles_boxes_once_for_all_passes(spark, tmp_path):
    from trailmesh import shape_queries

    rows = [(o, i, float(i), 0.01 * i, 0.01) for o in range(400) for i in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = shape_queries.hota_scores(spark, str(tmp_path))
    assert len(df.collect()) == 2 * len(T.ALPHAS)
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 2  # the lines of the truth and of the found
    assert sum("REPARTITION_BY_NUM" in line and "Reused" not in line for line in plan.splitlines()) == 1
