"""Pair costs against brute force, and what they move."""

import math
import random

import pytest

from trailmesh.operators import pair_cost

SPAN = "array<struct<cam:string,start:bigint,end:bigint>>"


def shuffled_mb(spark, df):
    """The rows of df, and the megabytes that its stages wrote for shuffles."""
    sc, group = spark.sparkContext, f"shuffled-{random.random()}"
    sc.setJobGroup(group, group)
    rows = df.collect()
    sc._jsc.clearJobGroup()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return rows, sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages) / 1e6


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pairs_by_brute_force_move_few_copies(spark, shuffled_joins):
    r = random.Random(5)
    cams, limits = "abcde", (60_000, 43_200_000)
    vecs = [[r.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    place = lambda i, n: (None, None) if i % n == 0 else (r.uniform(-150, 150), r.uniform(-150, 150))
    starts = [("s", i, r.choice(cams), a := r.randrange(30 * 86_400_000), a + 1000, *place(i, 7), None if i % 11 == 0 else vecs[i % 12]) for i in range(1500)]
    tracks = []
    for i in range(1500):
        seen, cam = r.randrange(30 * 86_400_000), r.choice(cams)
        spans = [(cam, seen - 1000, seen)] + [(c, seen, seen + 40_000_000) for c in cams[:2] if i % 5 == 0]
        tracks.append(("s", i, cam, seen, *place(i, 9), spans, [] if i % 13 == 0 else [vecs[i % 12], vecs[i % 5]]))
    hop = [(a, b, *limits) for a in cams for b in cams if a != b]
    want = {}
    for _, tid, cam, start, end, x, y, vec in starts:
        for _, gid, own, seen, kx, ky, spans, entries in tracks:
            far = None if x is None or kx is None else math.hypot(x - kx, y - ky)
            if cam == own or not limits[0] <= start - seen <= limits[1] or vec is None or not entries or any(c == cam and a <= end and b >= start for c, a, b in spans):
                continue
            if far is None or far <= 5.0 + 0.001 * (start - seen) / 1000:
                near = max(sum(p * q for p, q in zip(vec, e, strict=True)) for e in entries)
                want[tid, gid] = (start - seen, near, 1 - near + 0.01 * (5.0 if far is None else min(far, 5.0)))  # as in the SQL
    out = pair_cost.pair_costs(
        spark.createDataFrame(starts, "site string, tid long, cam string, start long, end long, x double, y double, vec array<double>"),
        spark.createDataFrame(tracks, f"site string, gid long, cam string, seen long, x double, y double, spans {SPAN}, entries array<array<double>>"),
        spark.createDataFrame(hop, "src string, dst string, min_ms long, max_ms long"), weight=0.01, max_ground_m=5.0, max_speed_m_s=0.001, bucket_ms=21_600_000,
    )
    rows, mb = shuffled_mb(spark, out)
    assert len(rows) == len(want) > 1000 and {(x.tid, x.gid) for x in rows} == set(want)
    for x in rows:
        assert (x.elapsed, x.similarity, x.cost) == pytest.approx(want[x.tid, x.gid], abs=1e-9)
    assert mb < 3  # 4.2 with vectors in each pair and tracks in all cells around them
