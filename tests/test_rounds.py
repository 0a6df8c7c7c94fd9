"""The round engine: gallery, stitching, revision, ground evidence, and streaming against batch."""

import copy
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmesh.operators.association import Associator, Config, common_distance, exit_speed
from trailmesh.operators.gallery import Gallery, Tracklet
from trailmesh.operators.rounds import RoundEngine, associate_frames, frames_of, last_decisions, next_ids
from trailmesh.streaming import rounds as streaming

A, B = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]


def det(local, vec=None, x=None, y=None, confidence=1.0, clean=True, entry=False):
    return {"local": local, "confidence": confidence, "clean": clean, "entry": entry, "x": x, "y": y, "vec": vec}


def whole(tid, cam, start, end, vec=A, **more):
    return Tracklet.whole({"tid": tid, "cam": cam, "start": start, "end": end, "vec": vec, **more})


def fed(config, frames, **ids):
    engine = RoundEngine(config, **ids)
    return [r for f in [*frames, ("", None, [])] for r in engine.feed(*f)], engine


# --- gallery


def test_quota_equals_a_plain_list():
    rng = random.Random(4)
    for size in (1, 3, 5):
        g = Gallery(size=size)
        k = g.create(whole(0, "a", 0, 0, [1.0, 0.0]))
        plain = [("a", 1.0, 0, 0)]
        for step in range(1, 60):
            tid = rng.choice([step, rng.randrange(step)])
            cam, confidence = "abc"[tid % 3], rng.randint(1, 4) / 4
            g.absorb(k, whole(tid, cam, step, step, [1.0, step], confidence=confidence))
            plain = [e for e in plain if e[3] != tid] + [(cam, confidence, step, tid)]
            while len(plain) > size:
                counts = {}
                for e in plain:
                    counts.setdefault(e[0], []).append(e)
                most = max(len(v) for v in counts.values())
                crowded = next(v for v in counts.values() if len(v) == most)
                plain.remove(min(crowded, key=lambda e: (e[1], e[2])))
            assert [(a.cam, a.confidence, a.ts, a.tid) for a in k.appearances] == plain


def test_a_replaced_tracklet_closes_with_its_former_owner():
    e = Associator(Config())
    old, new = Tracklet(1, "a", 1, 0, 10, 5), Tracklet(2, "a", 2, 20, 30, 5)
    old.best, new.best = [(1, 1.0, 1, np.array(A))], [(1, 1.0, 1, np.array(A))]
    first = e.round([old])[0].gid
    assert e.round([new])[0].gid == first and e.gallery.owner_of(old) is None
    old.closed = True
    again = e.round([old])[0]
    assert (again.gid, again.is_update) == (first, True) and e.gallery.owner_of(new).gid == first
    assert e.gallery.pop_former(old) is None


def test_detach_undoes_an_assignment():
    g = Gallery()
    k = g.create(whole(1, "a", 0, 10, A))
    before = copy.deepcopy(k)
    t = whole(2, "b", 20, 30, B)
    g.absorb(k, t)
    g.detach(k, t)
    assert (k.members, k.spans, k.owned, k.last_seen, k.last_cam, k.created) == (before.members, before.spans, before.owned, before.last_seen, before.last_cam, before.created)
    assert np.allclose(k.centroid, before.centroid) and g.owner_of(t) is None
    g.detach(k, whole(1, "a", 0, 10, A))
    g.drop(k)
    assert not g.open


def test_similarity_is_the_best_appearance():
    both = [whole(1, "a", 0, 1, A), whole(2, "b", 10, 11, B)]
    near = {}
    for mode in ("max", "centroid"):
        e = Associator(Config(similarity=mode, max_cost=2.0))
        for t in both:
            e.round([t])
        near[mode] = e.similarities([whole(3, "c", 20, 21, A)], e.tracks)[0][0]
    assert abs(near["max"] - 1) < 1e-9 and near["centroid"] < 0.95
    with pytest.raises(ValueError, match="similarity"):
        Config(similarity="median")


# --- one round


def test_pieces_of_one_person_in_a_round_are_stitched():
    e = Associator(Config())
    got = e.round([whole(1, "a", 0, 10, A), whole(2, "a", 20, 30, A), whole(3, "a", 5, 25, A), whole(4, "a", 40, 50, B)])
    assert [d.gid for d in got] == [1, 1, 2, 3]
    assert [d.reason for d in got] == ["empty", "stitched", "empty", "empty"]


def test_stitching_equals_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        rows = [whole(i, "a", s := rng.randint(0, 50), s + rng.randint(0, 12), list(np.array([np.cos(t := rng.uniform(0, 1.5)), np.sin(t)]))) for i in range(6)]
        got = [d.gid for d in Associator(Config(similarity="max")).round(rows)]
        made, want = [], {}
        for t in sorted(rows, key=lambda t: (t.start, t.tid)):
            fits = [(1 - max(float(t.best[0][3] @ o.best[0][3]) for o in g), i) for i, g in enumerate(made) if all(t.start > o.end or t.end < o.start for o in g)]
            if fits and min(fits)[0] < 0.5:
                made[min(fits)[1]].append(t)
                want[t.tid] = min(fits)[1] + 1
            else:
                made.append([t])
                want[t.tid] = len(made)
        assert got == [want[t.tid] for t in rows]


def test_ground_evidence():
    c = Config(overlaps={("a", "b")}, ground_weight=0.1, max_ground_m=1.0, max_speed_m_s=2.0, ground_tol_ms=50)
    e = Associator(c)
    path = [(t, float(t) / 100, 0.0) for t in range(0, 1000, 100)]
    e.round([whole(1, "a", 0, 900, A, path=path)])
    k = e.tracks[0]
    near = e.pair(whole(2, "b", 100, 900, A, path=[(t + 20, x, y + 0.5) for t, x, y in path]), k, 1.0)
    assert abs(near.cost - 0.05) < 1e-9 and near.measured
    assert e.pair(whole(2, "b", 100, 900, A, path=[(t, x, y + 3) for t, x, y in path]), k, 1.0).rule == "distance"
    later = whole(3, "a", 2900, 3000, A, path=[(2900, 12.0, 0.0), (3000, 12.1, 0.0)])
    link = e.pair(later, k, 1.0)  # 3 m after 2 s is a walk, 10 m is not
    assert abs(link.cost - 0.1) < 1e-9 and link.gap == 2000
    assert e.pair(whole(3, "a", 2900, 3000, A, path=[(2900, 20.0, 0.0)]), k, 1.0).rule == "distance"
    apart = whole(4, "b", 2900, 3000, A, path=[(2900, 9.5, 0.0)])
    assert e.pair(apart, k, 1.0).rule == ""
    e.config.reject_without_common_time = True
    assert e.pair(apart, k, 1.0).rule == "no_common_time"
    e.config.evidence_gap_ms = 1000
    assert not e.pair(later, k, 1.0).measured


def test_limits_of_measured_pairs():
    base = {"overlaps": {("a", "b")}, "max_cost": 0.1, "max_cost_ground": 0.5, "ground_weight": 0.0}
    path, turned = [(0, 0.0, 0.0), (100, 0.0, 0.0)], [0.8, 0.6, 0.0]
    e = Associator(Config(**base))
    e.round([whole(1, "a", 0, 100, A, path=path)])
    assert e.round([whole(2, "b", 0, 100, turned, path=path)])[0].gid == 1  # seen at one place
    assert e.round([whole(3, "c", 200, 300, B)])[0].gid == 2
    e = Associator(Config(**base))
    e.round([whole(1, "a", 0, 100, A, path=path)])
    assert e.costs([whole(2, "a", 200, 300, turned, path=[(200, 0.0, 0.0)])], e.tracks)[1][0][0] == 0.5
    assert e.costs([whole(2, "a", 200, 300, turned, path=[(200, 0.0, 0.0)], entry=True)], e.tracks)[1][0][0] == 0.1
    e.round([whole(5, "c", 0, 100, turned)])
    e.config.contested_gap_ms = 50
    assert list(e.costs([whole(2, "a", 200, 300, turned, path=[(200, 0.0, 0.0)])], e.tracks)[1][0]) == [0.1, 0.1]


def test_transit_direction_and_overdue():
    c = Config(transitions={("a", "b"): (100, 1000)}, directions={("a", "b"): (1.0, 0.0)}, direction_rule=(1000, 0.5, 0.0))
    e = Associator(c)
    e.round([whole(1, "a", 0, 900, A, path=[(t, -t / 500, 0.0) for t in range(0, 1000, 100)])])
    assert e.pair(whole(2, "b", 1200, 1300), e.tracks[0], 1.0).rule == "direction"
    c.directions[("a", "b")] = (-1.0, 0.0)
    assert e.pair(whole(2, "b", 1200, 1300), e.tracks[0], 1.0).rule == ""
    late = whole(2, "b", 2500, 2600)
    assert e.pair(late, e.tracks[0], 1.0).rule == "transit"
    c.overdue_cost = 0.2
    assert e.pair(late, e.tracks[0], 0.9).rule == "" and e.pair(late, e.tracks[0], 0.7).rule == "transit"
    assert exit_speed(((0, 0.0, 0.0),), 1000) is None


def test_common_distance_equals_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        a, b = (tuple(sorted((rng.randint(0, 40), rng.random(), rng.random()) for _ in range(rng.randint(1, 6)))) for _ in "ab")
        near = [min(b, key=lambda q: (abs(q[0] - p[0]), q[0])) for p in a]
        hits = [float(np.hypot(p[1] - q[1], p[2] - q[2])) for p, q in zip(a, near) if abs(p[0] - q[0]) <= 3]
        got = common_distance(a, b, 3)
        if len({q[0] for q in b}) == len(b):  # rows of one moment are not told apart
            assert (got is None) == (not hits) and (not hits or abs(got - float(np.median(hits))) < 1e-9)


class Plain(Associator):
    """One tracklet by the matrices of many."""

    def likenesses(self, t, tracks):
        return self.similarities([t], tracks)[0].tolist()

    def within(self, t, tracks, near):
        return {j: float(c) for j, c in enumerate(self.costs([t], tracks)[0][0]) if c < self.config.max_cost}


@pytest.mark.parametrize("more", [{}, {"similarity": "centroid"}, {"max_cost": 0.9, "same_camera": False}])
def test_one_tracklet_is_decided_like_many(more):
    for seed in range(4):
        frames = [(c, t, d) for _, _, c, t, d in random_frames(seed)]
        engines = [RoundEngine(Config(**RULES | more)) for _ in range(2)]
        engines[1].associator = Plain(engines[1].config)
        rows = [[r for f in [*frames, ("", None, [])] for r in e.feed(*f)] for e in engines]
        assert rows[0] == rows[1] and {"first", "update", "close"} <= {r[1] for r in rows[0]}


def test_one_tracklet_makes_no_matrices(monkeypatch):
    """Most rounds have one new tracklet: no matrices for it, and only the identity it joined stacks its vectors anew."""
    e = Associator(Config())
    e.round([whole(1, "a", 0, 10, A), whole(2, "a", 5, 15, B)])
    monkeypatch.setattr(Associator, "costs", lambda *_: pytest.fail("a matrix of costs for one tracklet"))
    assert e.round([whole(3, "a", 20, 30, A)])[0].gid == 1
    before = [k.vectors() for k in e.tracks]
    assert e.round([whole(4, "b", 40, 50, B)])[0].gid == 2 and e.round([whole(5, "b", 60, 70, [0.0, 0.0, 1.0])])[0].is_new
    now = [k.vectors() for k in e.tracks]
    assert now[0] is before[0] and now[1] is not before[1] and all(np.array_equal(k.vectors(), [a.vec for a in k.appearances]) for k in e.tracks)
    t = whole(6, "c", 80, 90, A)
    assert t.query(8) is t.query(8)
    t.add(95, 1.0, True, None, np.array(B), False, 8, 8)
    assert not np.array_equal(t.query(8), A) and copy.deepcopy(t).asked is None and copy.deepcopy(e.tracks[0]).rows is None


# --- rounds over frames


def test_windows_follow_the_data():
    frames = [("a", t, [det(1, A)]) for t in range(0, 2600, 100)]
    rows, _ = fed(Config(), frames)
    assert [r[0] for r in rows] == [1000, 2000, 2500] and [r[1] for r in rows] == ["first", "update", "close"]
    rows, _ = fed(Config(position_ms=250), frames)
    assert [r[0] for r in rows][:5] == [1000, 1300, 1600, 1900, 2000] and {r[8] for r in rows} == {1}


def test_an_id_given_anew_runs_an_early_round():
    rows, _ = fed(Config(idle_ms=300, window_ms=10_000), [("a", 0, [det(1, A)]), ("a", 100, [det(1, A)]), ("a", 500, [det(1, B)]), ("a", 600, [det(1, B)])])
    assert [(r[0], r[1], r[2], r[8]) for r in rows] == [(500, "first", 1, 1), (500, "first", 2, 2), (600, "close", 2, 2)]


def test_late_detections_join_their_tracklet():
    rows, _ = fed(Config(min_frames=3), [("a", 500, [det(1, A)]), ("a", 600, [det(1, A)]), ("a", 300, [det(1, A)]), ("b", 600, [det(1, B)])])
    assert [(r[5], r[6], r[7]) for r in rows] == [(300, 600, 3)]  # the other one is too short


def test_a_first_decision_is_revised_once():
    mixed = [0.6, 0.8, 0.0]
    frames = [("a", t, [det(1, A)]) for t in (0, 100, 200)] + [("a", t, [det(2, B)]) for t in (300, 400, 500)]
    frames += [("b", 1500, [det(1, mixed)]), ("b", 2600, [det(1, A, confidence=50.0)]), ("b", 2700, [det(1, A, confidence=50.0)]), ("b", 3800, [det(1, A)]), ("b", 4900, [det(1, B, confidence=900.0)])]
    c = Config(window_ms=1000, idle_ms=5000, max_cost=0.7, revise_after=3, transitions={("a", "b"): (0, 10_000)})
    rows, engine = fed(c, frames)
    b = [r for r in rows if r[3] == "b"]
    assert [r[1] for r in b][:2] == ["first", "update"] and [r[8] for r in b if r[1] == "revised"] == [1]
    assert sum(r[1] == "revised" for r in b) == 1 and b[0][8] == 2 and b[-1][8] == 1
    assert len(engine.associator.gallery.open) == 2
    same, _ = fed(Config(window_ms=1000, idle_ms=5000, revise_after=3), [("a", t, [det(1, A)]) for t in range(0, 3000, 500)])
    assert {r[8] for r in same} == {1} and "revised" not in {r[1] for r in same}


def random_frames(seed, n=220):
    rng, out, ts = random.Random(seed), [], 0
    people = [(np.eye(6)[i] + 0.05).tolist() for i in range(6)]
    for seq in range(n):
        ts += rng.choice([10, 30, 60, 120])
        who = rng.sample(range(6), rng.randint(0, 3))
        noise = lambda v: [x + rng.uniform(-0.2, 0.2) for x in v]
        out.append((f"s{seq % 2}", seq, rng.choice("abc"), ts - rng.choice([0, 0, 0, 150]), [det(p if rng.random() < 0.9 else p + 10, noise(people[p]) if rng.random() < 0.9 else None, float(p), rng.random(), rng.random()) for p in who]))
    return out


FRAME = "site string, seq bigint, cam string, ts bigint, detections array<struct<local: bigint, confidence: double, clean: boolean, entry: boolean, x: double, y: double, vec: array<double>>>"
RULES = {"window_ms": 500, "idle_ms": 900, "ttl_ms": 6000, "min_frames": 2, "revise_after": 4, "overlaps": {("a", "b")}, "position_ms": 50, "max_points": 8, "gallery_size": 4}


def as_rows(frames):
    return [(s, q, c, t, [tuple(d[k] for k in ("local", "confidence", "clean", "entry", "x", "y", "vec")) for d in ds] if ds is not None else None) for s, q, c, t, ds in frames]


def test_batch_equals_a_plain_walk(spark):
    frames = random_frames(1)
    got = associate_frames(spark.createDataFrame(as_rows(frames), FRAME).repartition(4), Config(**RULES)).collect()
    for site in ("s0", "s1"):
        want, _ = fed(Config(**RULES), [(c, t, d) for s, _, c, t, d in frames if s == site])
        assert [tuple(r)[1:] for r in got if r.site == site] == [tuple(None if v is None else v for v in r) for r in want]
    kinds = {r.kind for r in got}
    assert {"first", "update", "close", "position"} <= kinds


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_for_any_boundaries(spark, tmp_path, seed):
    frames = random_frames(seed)
    ends = [(s, 10_000 + i, "", None, None) for i, s in enumerate(("s0", "s1"))]
    want = sorted((tuple(r) for r in associate_frames(spark.createDataFrame(as_rows(frames), FRAME), Config(**RULES)).collect()), key=str)
    for k, v in streaming.STATE_STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(frames)), 4))
    parts = [frames[a:b] for a, b in zip([0, *cuts], [*cuts, len(frames)])] + [ends]
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = lambda: streaming.associate_stream(spark.readStream.schema(FRAME).parquet(str(source)), Config(**RULES))
    for part in parts:  # each query starts again from the checkpoint of the one before
        spark.createDataFrame(as_rows(part), FRAME).coalesce(1).write.mode("append").parquet(str(source))
        stream().writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(r) for r in spark.read.schema(f"site string, {streaming.DECISIONS}").parquet(str(sink)).collect()), key=str)
    assert got == want


def test_numbers_go_on_after_a_restart(spark):
    frames = spark.createDataFrame(as_rows(random_frames(3)), FRAME)
    first = associate_frames(frames, Config(**RULES))
    ids = next_ids(first)
    again = associate_frames(frames, Config(**RULES), ids)
    highest = {r.site: (r.tid, r.gid) for r in ids.collect()}
    lowest = {r.site: (r.t, r.g) for r in again.groupBy("site").agg(F.min("tid").alias("t"), F.min("gid").alias("g")).collect()}
    assert all(lowest[s][0] >= highest[s][0] and lowest[s][1] == highest[s][1] for s in highest)
    held = last_decisions(first).collect()
    assert len(held) == len({(r.site, r.tid) for r in held})


def test_frames_of_detections(spark):
    rows = spark.createDataFrame([("s", "a", 5, 2, 0.5), ("s", "a", 5, 1, 0.7), ("s", "b", 5, 1, 0.9)], "site string, cam string, ts bigint, id bigint, conf double")
    out = {r.cam: r for r in frames_of(rows, ["site", "cam", "ts"], F.col("ts"), local=F.col("id"), confidence=F.col("conf")).collect()}
    assert [d.local for d in out["a"].detections] == [1, 2] and out["b"].detections[0].confidence == 0.9 and out["b"].detections[0].vec is None
