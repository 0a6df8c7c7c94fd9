"""Rules on detections and transits, with their models as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.functions import geometry as G


def learned_foot(detections: DataFrame, models: DataFrame, margin: float = 20.0) -> DataFrame:
    """Add ``foot_y`` to detections(cam, y, h, frame_h): the box's bottom, or where a cut box's feet would be.

    models(cam, a, b): people at foot line v stand a v + b pixels tall. A box that ends within ``margin`` of the frame's
    bottom is cut; its feet are at least at its bottom. Cameras without a model, and slopes of 1 or more, keep the bottom.
    """
    d = detections.join(models.select("cam", F.col("a").alias("_a"), F.col("b").alias("_b")), "cam", "left")
    bottom = F.col("y") + F.col("h")
    cut = (bottom >= F.col("frame_h") - margin) & (F.col("_a") < 1)
    return d.withColumn("foot_y", F.when(cut, F.greatest(bottom, (F.col("y") + F.col("_b")) / (1 - F.col("_a")))).otherwise(bottom)).drop("_a", "_b")


def clean_flags(detections: DataFrame, keys: list[str], box_id: str, margin: float | None, most_covered: float | None) -> DataFrame:
    """Add ``clean`` to detections(keys, x, y, w, h, frame_w, frame_h): far from all edges and not covered by another box of its frame.

    A rule that is None does not count. Covered is the largest share of the box under one other box.
    """
    ok = F.lit(True)
    if margin is not None:
        edge = F.least(F.col("x"), F.col("y"), F.col("frame_w") - F.col("x") - F.col("w"), F.col("frame_h") - F.col("y") - F.col("h"))
        ok = ok & (edge >= margin)
    if most_covered is None:
        return detections.withColumn("clean", ok)
    names = ("x", "y", "w", "h")
    # The other boxes of a frame are one array, as many as are in view.
    others = detections.groupBy(*keys).agg(F.collect_list(F.struct(F.col(box_id).alias("_id"), *names)).alias("_others"))
    mine = tuple(F.col(c) for c in names)
    share = F.transform(F.filter("_others", lambda o: o["_id"] != F.col(box_id)), lambda o: G.intersection(mine, tuple(o[c] for c in names)) / (F.col("w") * F.col("h")))
    covered = F.coalesce(F.array_max(share), F.lit(0.0))
    return detections.join(others, keys).withColumn("clean", ok & (covered <= most_covered)).drop("_others")


def transit_verdicts(candidates: DataFrame, transitions: DataFrame, overlaps: DataFrame, unknown_pairs: bool = True, overdue: bool = False) -> DataFrame:
    """Add ``verdict`` to candidates(src, dst, elapsed): same, overlap, ok, unknown, too_early, too_late, or overdue; and ``feasible``.

    transitions(src, dst, least, most); overlaps(a, b) both ways round. An overlapping pair may be apart by its ``most``, if it has
    one. With ``overdue`` a pair that is only late stays feasible, for a stricter limit of appearance.
    """
    both = overlaps.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(overlaps.select("b", "a")).distinct().withColumn("_near", F.lit(True))
    c = candidates.join(transitions.select("src", "dst", "least", "most"), ["src", "dst"], "left").join(both, ["src", "dst"], "left")
    e, late = F.col("elapsed"), F.lit("overdue" if overdue else "too_late")
    verdict = (
        F.when(F.col("src") == F.col("dst"), "same")
        .when(F.col("_near") & (F.col("most").isNull() | (F.abs(e) <= F.col("most"))), "overlap")
        .when(F.col("_near"), "too_late")
        .when(F.col("most").isNull(), "unknown")
        .when(e < F.col("least"), "too_early")
        .when(e <= F.col("most"), "ok")
        .otherwise(late)
    )
    good = ["same", "overlap", "ok", "overdue", *(["unknown"] if unknown_pairs else [])]
    return c.select(*candidates.columns, verdict.alias("verdict")).withColumn("feasible", F.col("verdict").isin(*good))


def interest(point: Column, x: tuple[float, float], y: tuple[float, float]) -> Column:
    """Whether a ground point (x, y) is in a half-open rectangle."""
    return F.coalesce((point["x"] >= x[0]) & (point["x"] < x[1]) & (point["y"] >= y[0]) & (point["y"] < y[1]), F.lit(False))
