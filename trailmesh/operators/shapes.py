"""Shapes in the image and on the ground: view footprints, keyframes of a track, clusters of detector boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.functions import geometry as G

#: Image rows that a footprint looks at.
ROWS = 200


def footprints(cameras: DataFrame, matrix: str = "matrix", width: str = "width", height: str = "height", metres_per_pixel: float = 0.05, reach_m: float = 200.0) -> DataFrame:
    """Add ``cut`` and ``polygon``: the ground that a camera sees and can place.

    From the bottom of the image up, rows count while one pixel covers at most ``metres_per_pixel``
    of ground (in the middle column); ``cut`` is the last such row. The projected
    rectangle below it is clipped to ``reach_m`` around the origin. A camera whose bottom row is behind it, or
    already too coarse, has a null cut and an empty polygon.
    """
    # A camera is a few bytes and much work: a small file of them still goes to all tasks.
    cameras = cameras.repartition(4 * cameras.sparkSession.sparkContext.defaultParallelism)
    h = [F.element_at(F.col(matrix), i) for i in range(1, 10)]
    tall = F.col(height).cast("double")

    @F.pandas_udf("double")
    def cut(matrices: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        out = np.full(len(matrices), np.nan)
        known = np.flatnonzero(matrices.notna() & widths.notna() & heights.notna())
        for at in np.array_split(known, -(-len(known) // 2000) or 1):
            if len(at):
                out[at] = cut_rows(np.array([list(m) for m in matrices.iloc[at]], float), widths.iloc[at].to_numpy(float), heights.iloc[at].to_numpy(float), metres_per_pixel)
        return pd.Series(out, dtype=object).where(~np.isnan(out), None)

    out = cameras.withColumn("cut", cut(F.col(matrix), F.col(width).cast("double"), tall))
    corners = [(F.lit(0.0), F.col("cut")), (F.col(width).cast("double"), F.col("cut")), (F.col(width).cast("double"), tall), (F.lit(0.0), tall)]
    empty = F.array().cast("array<struct<x:double,y:double>>")
    seen = F.filter(F.array(*[G.project(h, a, b) for a, b in corners]), lambda p: p.isNotNull())
    out = out.withColumn("polygon", F.when(F.col("cut").isNull(), empty).otherwise(seen))
    for a, b in ((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)):
        out = out.withColumn("polygon", F.when(F.size("polygon") < 3, empty).otherwise(clipped(F.col("polygon"), a, b, reach_m)))
    return out.withColumn("polygon", F.when(F.size("polygon") < 3, empty).otherwise(F.col("polygon")))


def cut_rows(m: np.ndarray, width: np.ndarray, height: np.ndarray, metres_per_pixel: float) -> np.ndarray:
    """The last row from the bottom up, before the first too coarse one, of many cameras; NaN for none."""
    u, tall, step = width[:, None] / 2.0, height[:, None], np.maximum(1.0, height[:, None] / ROWS)
    c = [m[:, k : k + 1] for k in range(9)]
    i = np.arange(ROWS + 1)[None, :]
    v = tall - i * step
    with np.errstate(all="ignore"):
        d0, d1 = c[6] * u + c[7] * v + c[8], c[6] * u + c[7] * (v - 1.0) + c[8]
        x = (c[0] * u + c[1] * v + c[2]) / d0 - (c[0] * u + c[1] * (v - 1.0) + c[2]) / d1
        y = (c[3] * u + c[4] * v + c[5]) / d0 - (c[3] * u + c[4] * (v - 1.0) + c[5]) / d1
        fine = (np.hypot(x, y) <= metres_per_pixel) & (np.abs(d0) >= 1e-9) & (np.abs(d1) >= 1e-9) & (i <= np.floor(tall / step))
    last = np.where(fine.all(1), ROWS + 1, np.argmin(fine, 1)) - 1
    in_front = (c[6] * u + c[7] * tall + c[8])[:, 0] > 0
    return np.where(in_front & (last >= 0), height - last * step[:, 0], np.nan)


def clipped(polygon: Column, a: float, b: float, c: float) -> Column:
    """The part of a convex polygon (array of x, y) where a x + b y + c >= 0."""
    side = lambda p: a * p["x"] + b * p["y"] + c
    nothing = F.array().cast("array<struct<x:double,y:double>>")

    def piece(p: Column, i: Column) -> Column:
        q = F.element_at(polygon, (i + 1) % F.size(polygon) + 1)
        t = side(p) / (side(p) - side(q))
        cross = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        return F.concat(F.when(side(p) >= 0, F.array(p)).otherwise(nothing), F.when((side(p) >= 0) != (side(q) >= 0), F.array(cross)).otherwise(nothing))

    return F.flatten(F.transform(polygon, piece))


def area(polygon: Column) -> Column:
    """Area of a simple polygon, 0 if it is empty."""
    cross = F.transform(polygon, lambda p, i: p["x"] * F.element_at(polygon, (i + 1) % F.size(polygon) + 1)["y"] - F.element_at(polygon, (i + 1) % F.size(polygon) + 1)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


#: Boxes that a task looks at together, about.
HELD = 100_000


def keyframe_mask(frames: np.ndarray, boxes: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_iou: float) -> np.ndarray:
    """Whether to keep each box (x1, y1, x2, y2) of many stretches, so that lines between kept ones overlap every box by at least ``min_iou``.

    All stretches are halved at their worst boxes at the same time.
    """
    keep = np.zeros(len(frames), bool)
    lo, hi = starts, ends - 1
    keep[lo] = keep[hi] = True
    size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    while len(lo := lo[(inner := hi - lo > 1)]):
        hi = hi[inner]
        n = hi - lo - 1
        first, part = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        at, a, b = np.arange(len(part)) - (first - lo - 1)[part], lo[part], hi[part]
        t = ((frames[at] - frames[a]) / (frames[b] - frames[a]))[:, None]
        guess, true = boxes[a] + (boxes[b] - boxes[a]) * t, boxes[at]
        sides = np.minimum(guess[:, 2:], true[:, 2:]) - np.maximum(guess[:, :2], true[:, :2])
        both = np.where((sides > 0).all(1), sides.prod(1), 0.0)
        union = size(guess) + size(true) - both
        hull = (np.maximum(guess[:, 2:], true[:, 2:]) - np.minimum(guess[:, :2], true[:, :2])).prod(1)
        over = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        # Boxes apart all overlap by 0; the empty share of their hull still ranks them.
        rank = np.where((union > 0) & (hull > 0), over - (hull - union) / np.where(hull > 0, hull, 1.0), 0.0)
        rank = np.where((over < min_iou) & (rank < 1.0), rank, np.inf)
        least = np.minimum.reduceat(rank, first)
        hits = np.flatnonzero(rank == least[part])
        worst = at[hits[np.unique(part[hits], return_index=True)[1]]]  # the first of equal ones
        bad = np.isfinite(least)
        cut = worst[bad]
        keep[cut] = True
        lo, hi = np.concatenate([lo[bad], cut]), np.concatenate([cut, hi[bad]])
    return keep


def keyframe_places(frames: np.ndarray, boxes: np.ndarray, min_iou: float) -> list[int]:
    """Places to keep of one stretch."""
    return np.flatnonzero(keyframe_mask(frames, boxes, np.array([0]), np.array([len(frames)]), min_iou)).tolist()


def keyframes(boxes: DataFrame, keys: list[str], frame: str, step: int, stop_frame: int, min_iou: float, box: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Keyframes of each track (keys): keys, frame, box and ``outside``.

    A gap of more than ``step`` frames ends a stretch; after it, if the video goes on, its last box is
    repeated as an outside key. A task walks its sorted boxes and holds some stretches, at least one: one
    person in view without a gap.
    """
    order = W.partitionBy(*keys).orderBy(frame)
    new = F.lag(F.lit(True)).over(order).isNull() | F.coalesce(F.col(frame) - F.lag(frame).over(order) > step, F.lit(False))
    rows = boxes.select(*keys, F.col(frame).cast("bigint").alias(frame), *[F.col(c).cast("double").alias(c) for c in box]).withColumn("_new", new)
    kinds = dict(boxes.dtypes)

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        frames, bodies = rows[frame].to_numpy(), np.stack([rows[c].to_numpy() for c in box], 1)
        starts = np.flatnonzero(rows["_new"].to_numpy())
        ends = np.append(starts[1:], len(frames))
        kept = np.flatnonzero(keyframe_mask(frames, bodies, starts, ends, min_iou))
        last = ends[frames[ends - 1] + step <= stop_frame] - 1
        at, outside = np.concatenate([kept, last]), np.repeat([False, True], [len(kept), len(last)])
        cols = [pa.array(frames[at] + step * outside), *[pa.array(bodies[at, i]) for i in range(4)], pa.array(outside)]
        yield from pa.table([*[rows[k].take(pa.array(at)) for k in keys], *cols], [*keys, frame, *box, "outside"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            begun = np.flatnonzero(batch.column("_new").to_numpy(zero_copy_only=False))
            if len(begun) and sum(b.num_rows for b in held) >= HELD:
                ended = sum(b.num_rows for b in held[:-1]) + int(begun[-1])  # the last stretch may go on
                rows = pa.Table.from_batches(held)
                if ended:
                    yield from solved(rows.slice(0, ended))
                held = rows.slice(ended).to_batches()
        if sum(b.num_rows for b in held):
            yield from solved(pa.Table.from_batches(held))

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{frame} bigint", *[f"{c} double" for c in box], "outside boolean"])
    return rows.sortWithinPartitions(*keys, frame).mapInArrow(run, schema)


def cleaned_tracks(boxes: DataFrame, track: str, frame: str, foot: str, min_frames: int, min_foot: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Boxes of tracks with enough frames, their numbers dense from 0 by first frame, then old number; ``keys`` name the video.

    Only one row per track is ranked.
    """
    keys = keys or []
    kept = boxes if min_foot is None else boxes.filter(F.col(foot) >= min_foot)
    spans = kept.groupBy(*keys, track).agg(F.count("*").alias("_n"), F.min(frame).alias("_first")).filter(F.col("_n") >= min_frames)
    number = F.row_number().over((W.partitionBy(*keys) if keys else W).orderBy("_first", track)) - 1
    ranked = spans.withColumn("_number", number.cast("bigint")).select(*keys, track, "_number")
    return kept.join(ranked, [*keys, track]).withColumn(track, F.col("_number")).drop("_number")


def box_clusters(boxes: DataFrame, keys: list[str], box_id: str, score: str, iou: float, top_k: int, box: tuple[str, ...] = ("x", "y", "w", "h")) -> DataFrame:
    """The boxes that remain of each frame (keys): by score, then number, without those that overlap a kept one by ``iou``; at most ``top_k``.

    A frame's boxes are one array: as many as a detector gives, whatever the table's size.
    """
    names = ("x", "y", "w", "h")
    one = F.struct((-F.col(score)).alias("s"), F.col(box_id).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(box, names, strict=True)])
    apart = lambda kept, p: F.forall(kept, lambda q: G.iou(tuple(p[n] for n in names), tuple(q[n] for n in names)) < iou)
    framed = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_b"))
    kept = F.aggregate("_b", F.filter("_b", lambda b: F.lit(False)), lambda k, b: F.when((F.size(k) < top_k) & apart(k, b), F.concat(k, F.array(b))).otherwise(k))
    out = framed.select(*keys, F.posexplode(kept).alias("place", "_k"))
    return out.select(*keys, F.col("_k.id").alias(box_id), (-F.col("_k.s")).alias(score), "place")
