"""Comparisons of runs with reference tracks, and reports on latency records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.operators import ranks

#: Frames of a camera that one task spells out.
STRETCH = 10_000


def asof_following(left: DataFrame, right: DataFrame, keys: list[str], t: str, tolerance: int, left_id: str, right_id: str) -> DataFrame:
    """The first right row at or after each left row; past the key's last right row, that one. Within the tolerance only.

    Not the nearest row: one just before is passed over. Time buckets as wide as the
    tolerance make it an equi join that splits a busy key.
    """
    bucket = F.floor(F.col(t) / tolerance)
    ends = right.groupBy(*keys).agg(F.max(t).alias("_end"))
    a = left.select(*keys, F.col(t).alias("_lt"), F.col(left_id).alias("left_id"), bucket.alias("_b")).join(ends, keys)
    b = right.select(*keys, F.col(t).alias("_rt"), F.col(right_id).alias("right_id"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    near = a.join(b, [*keys, "_b"]).withColumn("gap", F.col("_rt") - F.col("_lt"))
    near = near.filter((F.abs("gap") <= tolerance) & ((F.col("gap") >= 0) | (F.col("_rt") == F.col("_end"))))
    best = near.groupBy("left_id").agg(F.min(F.struct((F.col("gap") < 0).alias("before"), "_rt", "right_id", "gap")).alias("m"))
    return best.select("left_id", "m.right_id", "m.gap")


def zip_frames(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two fixtures side by side; a frame that only one of them has is an error."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full")
    fault = F.raise_error(F.concat_ws(" ", F.lit("not aligned at"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    return both.filter(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(True)).otherwise(fault)).drop("_a", "_b")


def common_time_distance(paths: DataFrame, keys: list[str], track: str, x: str, y: str, least: int = 1) -> DataFrame:
    """Median distance of every two tracks over the moments (keys) that both have; at least ``least`` of them."""
    a, b = (paths.select(*keys, F.col(track).alias(f"track_{s}"), F.col(x).alias(f"_x{s}"), F.col(y).alias(f"_y{s}")) for s in "ab")
    met = a.join(b, keys).filter("track_a < track_b")
    far = F.hypot(F.col("_xa") - F.col("_xb"), F.col("_ya") - F.col("_yb"))
    return met.groupBy("track_a", "track_b").agg(F.percentile(far, F.lit(0.5)).alias("distance"), F.count("*").alias("n")).filter(F.col("n") >= least)


def interpolate_boxes(boxes: DataFrame, keys: list[str], frame: str, values: list[str], most: int) -> DataFrame:
    """Rows for the frames between two boxes of a track, in a straight line; gaps over ``most`` frames stay."""
    run = W.partitionBy(*keys).orderBy(frame)
    nxt = boxes.withColumns({"_f": F.lead(frame).over(run), **{f"_{v}": F.lead(v).over(run) for v in values}})
    fill = F.col("_f") - F.col(frame) <= most
    rows = nxt.withColumn("_at", F.explode(F.when(fill, F.sequence(F.col(frame), F.col("_f") - 1)).otherwise(F.array(frame))))
    share = (F.col("_at") - F.col(frame)) / (F.col("_f") - F.col(frame))
    line = lambda v: F.when(F.col("_at") == F.col(frame), F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}") - F.col(v)) * share)
    return rows.select(*keys, F.col("_at").alias(frame), *[line(v).alias(v) for v in values], (F.col("_at") != F.col(frame)).alias("filled"))


def assemble_frames(rows: DataFrame, spans: DataFrame, cam: str, frame: str, step: int = 1) -> DataFrame:
    """One row per camera and frame of spans(cam, first, last) with its detections in order; empty frames stay."""
    # A long camera is cut into stretches that many tasks spell out.
    whole = lambda c: F.col(c).cast("bigint")
    cuts = spans.select(cam, whole("last").alias("_last"), F.explode(F.sequence(whole("first"), whole("last"), F.lit(step * STRETCH).cast("bigint"))).alias("_a")).repartition(cam, "_a")
    spine = cuts.select(cam, F.explode(F.sequence("_a", F.least("_last", F.col("_a") + step * (STRETCH - 1)), F.lit(step).cast("bigint"))).alias(frame))
    rest = [c for c in rows.columns if c not in (cam, frame)]
    own = rows.groupBy(cam, frame).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("detections"))
    none = F.array().cast(own.schema["detections"].dataType)
    return spine.join(own, [cam, frame], "left").withColumn("detections", F.coalesce("detections", none))


def run_summary(rows: DataFrame, cam: str, track: str, person: str, n_reference: int) -> DataFrame:
    """Match rate, recall, tracks of several persons, and purity of rows; an unmatched detection has a null person."""
    votes = rows.groupBy(cam, track, person).agg(F.count("*").alias("_n"))
    own = F.when(F.col(person).isNotNull(), F.col("_n"))
    tracks = votes.groupBy(cam, track).agg(F.sum("_n").alias("all"), F.coalesce(F.sum(own), F.lit(0)).alias("hit"), F.count(person).alias("persons"), (F.max(own) / F.sum(own)).alias("purity"))
    hits = F.coalesce(F.sum("hit"), F.lit(0))
    sums = tracks.agg(
        F.coalesce(F.sum("all"), F.lit(0)).alias("n_detections"),
        hits.alias("n_matched"),
        F.coalesce(F.sum("hit") / F.sum("all"), F.lit(0.0)).alias("match_rate"),
        (hits / n_reference if n_reference else F.lit(0.0)).cast("double").alias("recall"),
        F.count("*").alias("n_tracks"),
        F.count_if(F.col("persons") > 1).alias("n_multi_identity"),
    )
    marks = ranks.quantiles(tracks, [], "purity", {"purity_median": 0.5, "purity_p10": 0.1})
    both = sums.join(marks.drop("n"), how="left")  # one row each
    return both.fillna(0.0, ["purity_median", "purity_p10"])


def decision_log(decisions: DataFrame) -> DataFrame:
    """Add ``decision`` and, for splits, ``why``; rows without a reference person go.

    decisions(person, chosen, chosen_person, has_true, blocked_by, true_cost, true_limit):
    chosen is null for a new identity; has_true says whether an identity of the person was
    open; blocked_by names the rule that forbade it.
    """
    merged = F.when(F.col("chosen_person") == F.col("person"), "merge_ok").otherwise("merge_wrong")
    kind = F.when(F.col("chosen").isNotNull(), merged).when(F.col("has_true"), "split").otherwise("new_ok")
    lost = F.when(F.col("true_cost") >= F.col("true_limit"), "over_threshold").otherwise("lost_to_other")
    why = F.when(F.col("blocked_by").isNotNull(), F.concat(F.lit("infeasible:"), "blocked_by")).when(F.col("true_cost").isNull(), "unknown").otherwise(lost)
    return decisions.filter("person IS NOT NULL").withColumn("decision", kind).withColumn("why", F.when(F.col("decision") == "split", why))


def trail(last: int, keys: list[str], order: list[str], *values: str) -> Column:
    """The last positions of a track up to each row, oldest first."""
    return F.collect_list(F.struct(*values)).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - last, 0))


def select_run(records: DataFrame, run: str, order: str) -> DataFrame:
    """Records of one run: its id, ``all``, or ``last``, the run of the last record by ``order``."""
    if run == "all":
        return records
    if run != "last":
        return records.filter(F.col("run_id") == run)
    return records.join(records.agg(F.max_by("run_id", order).alias("run_id")), "run_id", "left_semi")


def latency_by(records: DataFrame, field: str, start: str = "t0", end: str = "t4") -> DataFrame:
    """n, median, p90 and p99 of the time from start to end by any field."""
    took = records.withColumn("_v", F.col(end) - F.col(start)).filter("_v IS NOT NULL")
    return ranks.quantiles(took, [field], "_v", {"median": 0.5, "p90": 0.9, "p99": 0.99})


def latency_warnings(records: DataFrame, stamps: list[str], source: str = "t0_source", tolerance: float = 0.0) -> DataFrame:
    """(warning, n): records whose start comes from the probe, and negative samples of each segment; one pass."""
    counts = {"probe_t0": F.count_if(F.col(source) == "probe")}
    for a, b in [*zip(stamps, stamps[1:], strict=False), (stamps[0], stamps[-1])]:
        counts[f"negative_{a}_{b}"] = F.count_if(F.col(b) - F.col(a) < -tolerance)
    one = records.agg(*[c.alias(name) for name, c in counts.items()])
    rows = reduce(lambda done, name: [*done, F.struct(F.lit(name).alias("warning"), F.col(name).alias("n"))], counts, [])
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("n > 0")


def frame_ts(frame: Column, fps: float, start_ms: int = 0) -> Column:
    """Milliseconds of a frame; halves go to the even one."""
    return start_ms + F.bround(frame * 1000 / F.lit(float(fps)), 0).cast("bigint")


def size_mismatches(frames: DataFrame, calibrated: DataFrame) -> DataFrame:
    """One row for each camera whose frames differ in size from calibrated(cam_id, width, height): its first such frame."""
    odd = frames.join(calibrated, "cam_id").filter((F.col("frame_width") != F.col("width")) | (F.col("frame_height") != F.col("height")))
    return odd.groupBy("cam_id").agg(F.min(F.struct("ts_ms", "frame_width", "frame_height", "width", "height")).alias("m")).select("cam_id", "m.*")
