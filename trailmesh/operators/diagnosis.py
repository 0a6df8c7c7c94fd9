"""What went wrong in a run: identities that are no person, regions of false detections, and what ground evidence could decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.functions import geometry as G
from trailmesh.operators import ranks
from trailmesh.operators.assign import match_groups
from trailmesh.operators.lineage import computed_once
from trailmesh.operators.spread import spread

#: Tracklets whose pairs one task makes, about.
TRACKLETS = 500_000


def track_votes(boxes: DataFrame) -> DataFrame:
    """cam, local, n_detections, n_matched, person, purity of boxes(cam, local, person); the smaller person of a tie, null without votes."""
    votes = boxes.groupBy("cam", "local", "person").agg(F.count("*").alias("_n"))
    own = F.when(F.col("person").isNotNull(), F.struct(F.col("_n").alias("n"), (-F.col("person")).alias("p")))
    t = votes.groupBy("cam", "local").agg(F.sum("_n").alias("n_detections"), F.coalesce(F.sum(F.when(F.col("person").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_matched"), F.max(own).alias("_w"))
    return t.select("cam", "local", "n_detections", "n_matched", (-F.col("_w.p")).alias("person"), F.coalesce(F.col("_w.n") / F.col("n_matched"), F.lit(0.0)).alias("purity"))


def track_verdicts(appearances: DataFrame, votes: DataFrame, least_rate: float = 0.3, least_purity: float = 0.7, least_matched: int = 10) -> DataFrame:
    """Add n_detections, n_matched, match_rate, person, purity, class and why to appearances(gid, cam, local, n_frames, ...).

    A track whose detections seldom meet a person is ``detector``; one that does is ``person`` with
    ``few_frames``, ``impure`` or ``eligible``; one without detections is ``missing``.
    """
    v = appearances.join(votes, ["cam", "local"], "left")
    rate = F.coalesce(F.when(F.col("n_detections") > 0, F.col("n_matched") / F.col("n_detections")), F.lit(0.0))
    kind = F.when(F.col("n_detections").isNull(), "missing").when((rate < least_rate) | F.col("person").isNull(), "detector").otherwise("person")
    why = F.when(F.col("n_matched") < least_matched, "few_frames").when(F.col("purity") < least_purity, "impure").otherwise("eligible")
    return v.withColumn("match_rate", rate).withColumn("class", kind).withColumn("why", F.when(F.col("class") == "person", why).otherwise(""))


def identity_verdicts(verdicts: DataFrame) -> DataFrame:
    """gid, frames, class: the side that most frames of its tracks vote for; a tie, or only missing tracks, is ``detector``."""
    weight = F.greatest(F.col("n_frames"), F.lit(1))
    person = F.sum(F.when(F.col("class") == "person", weight).otherwise(0))
    return verdicts.groupBy("gid").agg(F.sum("n_frames").alias("frames"), F.when(person > F.sum(weight) - person, "person").otherwise("detector").alias("class"))


def false_positive_regions(detections: DataFrame, truth: DataFrame, cameras: DataFrame, inside: Column, least_iou: float = 0.5, near_iou: float = 0.1) -> DataFrame:
    """cam, bucket, n: matched detections (``tp``) and where the others stand: ``outside``, ``near_truth`` or ``no_truth``.

    detections and truth(cam, frame, box, x, y, w, h); cameras(cam, matrix); ``inside`` is a condition on the
    ground point (gx, gy). A frame is matched for most pairs over ``least_iou``, then for most overlap.
    """
    a = detections.select("cam", "frame", F.col("box").alias("det"), *[F.col(c).alias(f"_{c}") for c in "xywh"])
    b = truth.select("cam", "frame", F.col("box").alias("gt"), *[F.col(c).alias(f"_t{c}") for c in "xywh"])
    pairs = a.join(b, ["cam", "frame"]).withColumn("iou", G.iou(tuple(F.col(f"_{c}") for c in "xywh"), tuple(F.col(f"_t{c}") for c in "xywh")))
    hits = match_groups(pairs.filter("iou > 0"), ["cam", "frame"], "det", "gt", "iou", least_iou, gate_first=True).select("cam", "frame", "det", F.lit(True).alias("hit"))
    best = pairs.groupBy("cam", "frame", "det").agg(F.max("iou").alias("best"))
    d = a.join(hits, ["cam", "frame", "det"], "left").join(best, ["cam", "frame", "det"], "left").join(cameras.select("cam", "matrix"), "cam", "left")
    m = [F.element_at("matrix", i) for i in range(1, 10)]
    d = d.withColumn("_g", G.project(m, F.col("_x") + F.col("_w") / 2, F.col("_y") + F.col("_h"))).withColumns({"gx": F.col("_g.x"), "gy": F.col("_g.y")})
    bucket = F.when(F.col("hit"), "tp").when(F.col("gx").isNull() | ~F.coalesce(inside, F.lit(False)), "outside").when(F.col("best") >= near_iou, "near_truth").otherwise("no_truth")
    return d.groupBy("cam", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def with_paths(tracklets: DataFrame, points: DataFrame) -> DataFrame:
    """Add path, the ground points (ts, x, y) of points(tid, ts, x, y) in order of time; null without points."""
    p = points.filter("ts IS NOT NULL").groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("ts", "x", "y"))).alias("path"))
    return tracklets.join(p, "tid", "left")


def _negatives(tracklets: DataFrame) -> int:
    """How many pairs of a session are of two cameras and two persons: all, less those of one camera and those of one person."""
    n = tracklets.filter("cam IS NOT NULL AND person IS NOT NULL").groupBy("session", "cam", "person").agg(F.count("*").alias("n"))
    of = lambda *by: F.sum("n").over(W.partitionBy("session", *by))
    return (n.select((F.col("n") * (of() - of("cam") - of("person") + F.col("n"))).alias("m")).agg(F.sum("m")).first()[0] or 0) // 2


def sampled_pairs(tracklets: DataFrame, most_negative: int, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of tracklets(session, tid, cam, person, ...) of two cameras of a session: all of one person, and a seeded sample of others.

    a, b, same, and the columns ``carry`` of both as ``a_`` and ``b_``. Which others are drawn depends on their
    numbers and the seed alone. Pairs are made where their tracklets lie, in tasks that grow in number with the tracklets.
    """
    n = tracklets.count()
    out = ["session", "a", "b", "same", *[f"{s}_{c}" for s in "ab" for c in carry]]

    def met(keys: list[str], differ: str) -> DataFrame:
        dealt = spread(tracklets, keys, n, TRACKLETS)
        own = {"tid": "", "cam": "_cam", "person": "_person"} | {c: f"_{c}" for c in carry}
        a, b = (dealt.select(*keys, *[F.col(c).alias(s + to) for c, to in own.items() if c not in keys]) for s in "ab")
        return a.join(b.hint("merge"), keys).filter(f"a < b AND a_cam <> b_cam AND {differ}").withColumn("same", F.lit("person" in keys))

    positive = met(["session", "person"], "true").select(*out)
    others = met(["session"], "a_person <> b_person")
    draw = F.xxhash64(F.lit(seed), "session", "a", "b")
    drawn = lambda df: df.orderBy(draw, "session", "a", "b").limit(most_negative).select(*out)
    # Draws are even over 64 bits: the first of twice as many as are wanted hold the sample, or all are sorted.
    share = (2 * most_negative + 1000) / max(_negatives(tracklets), 1)
    if share < 1:
        negative = computed_once(drawn(others.filter(draw < int(share * 2**64) - 2**63)))
        if negative.count() == most_negative:
            return positive.unionByName(negative)
    return positive.unionByName(computed_once(drawn(others)))


def _synced(tol_ms: int) -> Column:
    """Median distance of the points of a_path from the nearest in time of b_path within the tolerance, null if there are none."""
    near = lambda p: F.array_min(F.transform(F.filter("b_path", lambda q: F.abs(p["ts"] - q["ts"]) <= tol_ms), lambda q: F.struct(F.abs(p["ts"] - q["ts"]), q["ts"], q["x"].alias("x"), q["y"].alias("y"))))
    away = F.transform(F.array_distinct("a_path"), lambda p: F.transform(F.array(near(p)), lambda m: F.hypot(p["x"] - m["x"], p["y"] - m["y"]))[0])
    # Few pairs share a moment, and only those look at their points.
    meet = (F.col("a_path")[0]["ts"] <= F.element_at("b_path", -1)["ts"] + tol_ms) & (F.col("b_path")[0]["ts"] <= F.element_at("a_path", -1)["ts"] + tol_ms)
    sorted_ = F.sort_array(F.filter(away, lambda d: d.isNotNull()))
    return F.when(meet, F.transform(F.array(sorted_), lambda m: F.when(F.size(m) > 0, (m[F.floor((F.size(m) - 1) / 2).cast("int")] + m[F.ceil((F.size(m) - 1) / 2).cast("int")]) / 2))[0])


def geometry(pairs: DataFrame, tol_ms: int, max_m: float, speed_m_s: float) -> DataFrame:
    """Add to pairs(a_start, a_end, a_path, b_start, b_end, b_path, ...), instead of these: synced_m, endpoint_m, gap_ms, feasible_reject and feasible_allow.

    Paths are arrays of ground points (ts, x, y) in order of time. ``synced_m`` is the median distance of a's
    points from b's nearest in time within the tolerance, null without a common moment; then ``reject``
    forbids the pair and ``allow`` compares the end of the earlier with the start of the later, over a
    walk of the gap. A side without points is not forbidden by ``allow``.
    """
    a_first = F.col("a_end") <= F.col("b_end")
    pick = lambda x, y: F.when(a_first, x).otherwise(y)
    first, last = (lambda s: F.col(f"{s}_path")[0]), (lambda s: F.element_at(f"{s}_path", -1))
    gap = F.greatest(F.lit(0), pick(F.col("b_start"), F.col("a_start")) - pick(F.col("a_end"), F.col("b_end")))
    out = pairs.withColumns({"synced_m": _synced(tol_ms), "_from": pick(last("a"), last("b")), "_to": pick(first("b"), first("a")), "gap_ms": gap})
    out = out.withColumn("endpoint_m", F.hypot(F.col("_from.x") - F.col("_to.x"), F.col("_from.y") - F.col("_to.y")))
    synced_ok = F.col("synced_m") <= max_m
    walk = F.coalesce(F.col("endpoint_m") <= max_m + speed_m_s * F.col("gap_ms") / 1000.0, F.lit(True))
    out = out.withColumns({"feasible_reject": F.coalesce(synced_ok, F.lit(False)), "feasible_allow": F.coalesce(synced_ok, walk)})
    used = {f"{s}_{c}" for s in "ab" for c in ("start", "end", "path")}
    return out.select(*[c for c in pairs.columns if c not in used], "synced_m", "endpoint_m", "gap_ms", "feasible_reject", "feasible_allow")


def pair_geometry(pairs: DataFrame, points: DataFrame, spans: DataFrame, tol_ms: int, max_m: float, speed_m_s: float) -> DataFrame:
    """The ``geometry`` of pairs(a, b, ...), with ground points(tid, ts, x, y) and spans(tid, start, end) to be joined."""
    s = with_paths(spans.select("tid", "start", "end"), points)
    side = lambda n: s.select(*[F.col(c).alias(n if c == "tid" else f"{n}_{c}") for c in s.columns])
    return geometry(pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, *[f"{n}_{c}" for n in "ab" for c in ("start", "end", "path")]), tol_ms, max_m, speed_m_s)


def evidence_ceiling(geometry: DataFrame) -> DataFrame:
    """same, n_pairs, share_common, feasible_reject, feasible_allow and quantiles of the synced distance and the gap."""
    share = lambda c: F.avg(c.cast("double"))
    base = geometry.groupBy("same").agg(F.count("*").alias("n_pairs"), share(F.col("synced_m").isNotNull()).alias("share_common"), *[share(F.col(c)).alias(c) for c in ("feasible_reject", "feasible_allow")])
    # Both values are ranked in the same passes over the pairs, which are made anew in each.
    marks, values = {"p10": 0.1, "p50": 0.5, "p90": 0.9}, {"synced": "synced_m", "gap": "gap_ms"}
    each = geometry.select("same", F.explode(F.array(*[F.struct(F.lit(n).alias("of"), F.col(c).cast("double").alias("v")) for n, c in values.items()])).alias("_e"))
    ranked = ranks.quantiles(each.select("same", "_e.of", "_e.v"), ["same", "of"], "v", marks)
    ranked = ranked.groupBy("same").agg(*[F.max(F.when(F.col("of") == n, F.col(q))).alias(f"{n}_{q}") for n in values for q in marks])
    return base.join(ranked, "same", "left")
