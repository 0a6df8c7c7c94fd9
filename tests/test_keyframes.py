"""Keyframes of long and many stretches, walked in order and not gathered in arrays."""

import random

import numpy as np
import pytest

from trailmesh.operators import shapes


def places(frames, boxes, least):
    """One stretch, halved at its worst box, by the rule alone."""
    def over(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
        both = w * h if w > 0 and h > 0 else 0.0
        union, hull = area(a) + area(b) - both, (max(a[2], b[2]) - min(a[0], b[0])) * (max(a[3], b[3]) - min(a[1], b[1]))
        return both / union, both / union - (hull - union) / hull

    keep, todo = {0, len(frames) - 1}, [(0, len(frames) - 1)]
    while todo:
        lo, hi = todo.pop()
        worst = []
        for i in range(lo + 1, hi):
            t = (frames[i] - frames[lo]) / (frames[hi] - frames[lo])
            share, rank = over([p + (q - p) * t for p, q in zip(boxes[lo], boxes[hi], strict=True)], boxes[i])
            if share < least and rank < 1:
                worst.append((rank, i))
        if worst:
            at = min(worst)[1]
            keep.add(at)
            todo += [(lo, at), (at, hi)]
    return sorted(keep)


@pytest.fixture
def small_batches(spark, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(shapes, "HELD", 20)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stretches_over_many_batches(spark, small_batches):
    r, rows, want = random.Random(3), [], set()
    for track in range(60):
        frame, stretch = 0, []
        n = 150 if track == 7 else r.choice([1, 2, 3, 9])
        for i in range(n):
            x, y = r.uniform(0, 40), r.uniform(0, 40)
            box = (x, y, x + r.uniform(20, 60), y + r.uniform(20, 60))
            stretch.append((frame, box))
            gap = r.random() < 0.2 and track != 7
            frame += 50 if gap else r.randrange(1, 11)
            if gap or i == n - 1:
                frames, boxes = [s[0] for s in stretch], [s[1] for s in stretch]
                want |= {(track, frames[k], *boxes[k], False) for k in places(frames, boxes, 0.5)}
                if frames[-1] + 10 <= 400:
                    want.add((track, frames[-1] + 10, *boxes[-1], True))
                rows += [(track, f, *b) for f, b in stretch]
                stretch = []
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "track int, frame long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    out = shapes.keyframes(df, ["track"], "frame", 10, 400, 0.5)
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert shapes.keyframes(df.limit(0), ["track"], "frame", 10, 400, 0.5).count() == 0


def test_equal_boxes_choose_the_first():
    boxes = np.array([[0, 0, 10, 10], [50, 50, 60, 60], [50, 50, 60, 60], [0, 0, 10, 10]], float)
    assert shapes.keyframe_places(np.arange(4), boxes, 0.5) == places([0, 1, 2, 3], boxes.tolist(), 0.5)
