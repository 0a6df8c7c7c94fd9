"""Costs of tracklets and open identities as a join: only pairs that time and place allow ever meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.functions import vectors as V


def pair_costs(
    tracklets: DataFrame,
    tracks: DataFrame,
    transitions: DataFrame,
    weight: float = 0.4,
    max_ground_m: float = 1.0,
    max_speed_m_s: float = 2.0,
    bucket_ms: int = 60_000,
    cell_m: float | None = None,
) -> DataFrame:
    """site, tid, gid, elapsed, distance, similarity, cost of all feasible pairs.

    tracklets(site, tid, cam, start, end, x, y, vec): where and when each begins. tracks(site,
    gid, cam, seen, x, y, spans(cam, start, end), entries): where and when each was last
    seen, its spans by camera and its vectors. transitions(src, dst, min_ms, max_ms): the
    time from one camera to the next, also from a camera to itself; a pair without a row is not
    feasible. x, y are metres and null where a camera has no projection: such pairs go by
    appearance. A side without a vector has no pairs.

    A track is dealt to the cameras it can reach, to the time buckets in which its person can
    arrive; a tracklet to the ground cells (``cell_m``, by default the longest walk that any
    transition allows) around its first point, so neither a camera nor a crowded hour is one group.
    """
    bucket = lambda t: F.floor(t / bucket_ms).cast("bigint")
    if cell_m is None:
        cell_m = max_ground_m + max_speed_m_s * (transitions.agg(F.max("max_ms")).first()[0] or 0) / 1000.0
    cell = lambda c, i: F.floor(F.col(c) / cell_m).cast("bigint") + i
    key = lambda i, j: F.concat_ws(":", cell("x", i), cell("y", j))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    # Known points meet by cell, an unknown one meets all of its time. A tracklet has one time and one camera,
    # so it is the one that is dealt to the cells around it.
    around = F.when(placed, F.array(F.lit("any"), *[key(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])).otherwise(F.array(F.lit("none"), F.lit("any")))
    own = F.when(placed, F.array(F.lit("none"), key(0, 0))).otherwise(F.array(F.lit("any")))

    wide = F.lit(max_ground_m) + max_speed_m_s * F.col("max_ms") / 1000.0 > cell_m
    # Tracks of equal vectors, and tracklets of equal ones, share them under a name of 128 bits.
    name = lambda c: F.struct(F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c))
    k = tracks.filter(F.size("entries") > 0).withColumn("_kv", name("entries")).join(transitions.withColumn("_wide", wide).withColumnRenamed("src", "cam"), "cam")
    arrives = F.sequence(bucket(F.col("seen") + F.col("min_ms")), bucket(F.col("seen") + F.col("max_ms")))
    # A walk longer than a cell meets all cells of its time. Of its spans a track takes along those in the camera.
    k = k.select(
        "site", "gid", "seen", "min_ms", "max_ms", F.col("dst").alias("cam"), F.col("x").alias("kx"), F.col("y").alias("ky"), "_kv", F.filter("spans", lambda s: s["cam"] == F.col("dst")).alias("spans"),
        F.explode(F.when(F.col("_wide"), F.array(F.lit("any"))).otherwise(own)).alias("_cell"), arrives.alias("_times"),
    ).withColumn("_time", F.explode("_times")).drop("_times")
    # A pair meets once: a track has either "any" or the other keys, and a tracklet has one of each.
    t = tracklets.filter(F.col("vec").isNotNull()).select("site", "tid", "cam", "start", "end", "x", "y", name("vec").alias("_tv"), bucket(F.col("start")).alias("_time"), F.explode(around).alias("_cell"))
    elapsed = F.col("start") - F.col("seen")
    pairs = t.join(k, ["site", "cam", "_time", "_cell"]).withColumn("elapsed", elapsed).filter(elapsed.between(F.col("min_ms"), F.col("max_ms")))
    busy = F.exists("spans", lambda s: (s["cam"] == F.col("cam")) & (s["start"] <= F.col("end")) & (s["end"] >= F.col("start")))
    away = F.hypot(F.col("x") - F.col("kx"), F.col("y") - F.col("ky"))
    pairs = pairs.withColumn("distance", away).filter(F.col("distance").isNull() | (F.col("distance") <= max_ground_m + max_speed_m_s * F.abs("elapsed") / 1000.0))
    # Keys alone are dealt out; vectors join the pairs that are left, each one of a site once.
    pairs = pairs.filter(~busy).select("site", "tid", "gid", "elapsed", "distance", "_kv", "_tv")
    held = tracks.filter(F.size("entries") > 0).select("site", name("entries").alias("_kv"), "entries").distinct()
    asked = tracklets.filter(F.col("vec").isNotNull()).select("site", name("vec").alias("_tv"), "vec").distinct()
    pairs = pairs.join(held, ["site", "_kv"]).join(asked, ["site", "_tv"])
    best = F.array_max(F.transform("entries", lambda v: V.dot(F.col("vec"), v)))
    pairs = pairs.withColumn("similarity", best)
    cost = 1.0 - F.col("similarity") + F.coalesce(weight * F.least(F.col("distance"), F.lit(max_ground_m)), F.lit(0.0))
    return pairs.select("site", "tid", "gid", "elapsed", "distance", "similarity", cost.alias("cost"))


def feasible_order(pairs: DataFrame) -> DataFrame:
    """Pairs in order of cost, then of their numbers."""
    return pairs.orderBy("cost", "tid", "gid")
