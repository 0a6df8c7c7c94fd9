"""Tracking scores from their published definitions: higher-order accuracy (HOTA) and identity F1.

Both sides are rows (seq, frame, id, x, y, w, h). All counts are joins and sums; only the assignment
of a frame, or of the identities of a sequence, is solved in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.functions import geometry as G
from trailmesh.operators.assign import match_groups
from trailmesh.operators.spread import ROWS, spread

#: Localisation thresholds of the definition, in hundredths.
ALPHAS = tuple(range(5, 100, 5))
BOX = ("x", "y", "w", "h")
#: Frames of a sequence that lie together.
STRETCH = 1000


def overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    """seq, frame, gt, pr and similarity of all boxes of a frame that overlap."""
    a, b = (side.select("seq", "frame", F.col("id").alias(name), *[F.col(c).cast("double").alias(f"{name}_{c}") for c in BOX]) for side, name in ((truth, "gt"), (found, "pr")))
    box = lambda n: tuple(F.col(f"{n}_{c}") for c in BOX)
    return a.join(b, ["seq", "frame"]).withColumn("similarity", G.iou(box("gt"), box("pr"))).filter("similarity > 0").select("seq", "frame", "gt", "pr", "similarity")


def _laid(truth: DataFrame, found: DataFrame, counted: DataFrame | int | None) -> DataFrame:
    """seq, stretch and the boxes (frame, id, x, y, w, h) of both sides, ``gt`` or ``pr``: the one shuffle of boxes, which lays a stretch of a sequence together."""
    side = lambda rows, name: rows.select("seq", F.floor(F.col("frame") / STRETCH).alias("stretch"), F.struct("frame", "id", *[F.col(c).cast("double").alias(c) for c in BOX]).alias(name))
    both = side(truth, "gt").unionByName(side(found, "pr"), allowMissingColumns=True)
    return spread(both, ["seq", "stretch"], counted, ROWS // 4)  # a task sorts boxes of both sides with those around them


def _framed(laid: DataFrame) -> DataFrame:
    """Boxes with their frame and all found boxes of it, ``prs``; in place."""
    rows = laid.withColumn("frame", F.coalesce("gt.frame", "pr.frame"))
    return rows.withColumn("prs", F.collect_list("pr").over(W.partitionBy("seq", "stretch", "frame"))).filter("gt IS NOT NULL").drop("pr")


def _similarity() -> Column:
    return G.iou(*(tuple(F.col(side)[c] for c in BOX) for side in ("gt", "pr")))


def _alignments(laid: DataFrame, framed: DataFrame) -> DataFrame:
    """seq, stretch and ``known``: for each identity of the truth there its found ones with (alignment, size); the size is how many boxes both have.

    Each frame shares a unit among what a box overlaps, summed over the whole sequence. Only sums of stretches are shuffled.
    """
    rows = framed.select("seq", "stretch", "frame", "gt", F.explode("prs").alias("pr"))
    similarity = F.when(F.col("frame").isNotNull(), _similarity())
    rows = rows.select("seq", "stretch", "frame", F.col("gt.id").alias("gt"), F.col("pr.id").alias("pr"), similarity.alias("similarity")).filter("similarity > 0")
    total = lambda c: F.sum("similarity").over(W.partitionBy("seq", "stretch", "frame", c))
    share = F.col("similarity") / (total("gt") + total("pr") - F.col("similarity"))
    sums = rows.withColumn("share", share).groupBy("seq", "stretch", "gt", "pr").agg(F.sum("share").alias("share"))
    boxes = laid.groupBy("seq", "stretch", F.col("gt.id").alias("gt"), F.col("pr.id").alias("pr")).agg(F.count("gt").alias("n_gt"), F.count("pr").alias("n_pr"))
    each = sums.unionByName(boxes, allowMissingColumns=True).repartition("seq")
    of = lambda n, *by: F.sum(n).over(W.partitionBy("seq", *by))
    pairs = each.withColumns({"size": of("n_gt", "gt") + of("n_pr", "pr"), "common": of("share", "gt", "pr")}).filter("share IS NOT NULL AND gt IS NOT NULL AND pr IS NOT NULL")
    value = F.struct((F.col("common") / (F.col("size") - F.col("common"))).alias("alignment"), "size")
    to_map = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    maps = pairs.groupBy("seq", "stretch", "gt").agg(to_map("pr", value).alias("m")).groupBy("seq", "stretch").agg(F.max("seq").alias("s"), F.max("stretch").alias("t"), to_map("gt", "m").alias("known"))
    # Keys that are sums themselves keep the join's filter of unknown keys above the shuffle of boxes, which all passes share as it is.
    return maps.select(F.col("s").alias("seq"), F.col("t").alias("stretch"), "known")


def hota(truth: DataFrame, found: DataFrame, counted: DataFrame | int | None = None) -> DataFrame:
    """seq, alpha, tp, fn, fp, ass_a, det_a, hota. An identity has one box in a frame; ``counted`` is as in `spread`.

    Pairs are first aligned over the whole sequence. A frame's assignment maximises alignment times similarity; what is similar enough at
    a threshold is a true positive there. All passes read one shuffle of the boxes.
    """
    laid = _laid(truth, found, counted)
    framed = _framed(laid)
    rows = framed.join(_alignments(laid, framed), ["seq", "stretch"], "left")
    rows = rows.select("seq", "stretch", "frame", "gt", F.explode("prs").alias("pr"), F.try_element_at("known", F.col("gt.id")).alias("m"))
    rows = rows.select("seq", "stretch", "frame", F.col("gt.id").alias("gt"), F.col("pr.id").alias("pr"), _similarity().alias("similarity"), F.try_element_at("m", F.col("pr.id")).alias("a"))
    scored = rows.filter("similarity > 0 AND a IS NOT NULL").withColumns({"score": F.col("a.alignment") * F.col("similarity"), "size": F.col("a.size")})
    hits = match_groups(scored, ["seq", "stretch", "frame"], "gt", "pr", "score", 1e-12, carried=["similarity", "size"], laid=True)
    # A pair's frames at each threshold, from one pass over the matches.
    enough = lambda a: F.count_if(F.col("similarity") >= a / 100.0 - 1e-9)
    links = hits.groupBy("seq", "gt", "pr").agg(F.max("size").alias("size"), *[enough(a).alias(f"n{a}") for a in ALPHAS])
    kept = lambda n: F.sum(n * n / (F.col("size") - n))
    per = links.groupBy("seq").agg(*[of(F.col(f"n{a}")).alias(f"{name}{a}") for a in ALPHAS for of, name in ((F.sum, "tp"), (kept, "kept"))])
    # An unknown sequence of the truth is not the unknown one of the found.
    both = laid.groupBy("seq", F.when(F.col("seq").isNull(), F.col("gt").isNull())).agg(F.count("gt").alias("n_truth"), F.count("pr").alias("n_found"))
    at = [F.struct(F.lit(a).alias("alpha"), F.col(f"tp{a}").alias("tp"), F.col(f"kept{a}").alias("kept")) for a in ALPHAS]
    out = both.join(per, "seq", "left").select("seq", "n_truth", "n_found", F.inline(F.array(*at))).fillna(0, ["tp", "kept"])
    fn, fp = F.col("n_truth") - F.col("tp"), F.col("n_found") - F.col("tp")
    out = out.select("seq", (F.col("alpha") / 100.0).alias("alpha"), "tp", fn.alias("fn"), fp.alias("fp"), (F.col("kept") / F.greatest("tp", F.lit(1))).alias("ass_a"), (F.col("tp") / F.greatest(F.col("n_truth") + F.col("n_found") - F.col("tp"), F.lit(1))).alias("det_a"))
    return out.withColumn("hota", F.sqrt(F.col("ass_a") * F.col("det_a")))


def hota_means(scores: DataFrame) -> DataFrame:
    """seq and the means over all thresholds."""
    return scores.groupBy("seq").agg(*[F.avg(c).alias(c) for c in ("hota", "det_a", "ass_a")])


def identity_f1(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """seq, idtp, idfn, idfp, idf1: identities matched one to one over a whole sequence by frames in which they overlap enough."""
    common = overlaps(truth, found).filter(F.col("similarity") >= least).groupBy("seq", "gt", "pr").agg(F.count("*").cast("double").alias("n"))
    best = match_groups(common, ["seq"], "gt", "pr", "n", 0.5).groupBy("seq").agg(F.sum("n").cast("bigint").alias("idtp"))
    a, b = truth.groupBy("seq").agg(F.count("*").alias("g")), found.groupBy("seq").agg(F.count("*").alias("p"))
    out = a.join(b, "seq", "full").join(best, "seq", "left").fillna(0, ["g", "p", "idtp"])
    return out.select("seq", "idtp", (F.col("g") - F.col("idtp")).alias("idfn"), (F.col("p") - F.col("idtp")).alias("idfp"), (2 * F.col("idtp") / F.greatest(F.col("g") + F.col("p"), F.lit(1))).alias("idf1"))


def virtual_frames(rows: DataFrame, cam: str = "cam", frame: str = "frame") -> DataFrame:
    """Add ``virtual``: frames from 1 of all cameras in one sequence, one block after the other in order of their names.

    A block is the smallest power of ten, 1000 at least, above the longest camera. Only distinct cameras are ranked.
    """
    cams = rows.groupBy(cam).agg(F.max(frame).alias("_last"))
    # No frame of a person in two cameras at once shares a number.
    longest = F.max("_last").over(W.partitionBy()) + 1
    block = F.when(longest < 1000, 1000.0).otherwise(F.pow(F.lit(10.0), F.floor(F.log10(longest.cast("double"))) + 1)).cast("bigint")
    at = cams.select(cam, block.alias("_block"), (F.row_number().over(W.orderBy(cam)) - 1).alias("_index"))
    return rows.join(F.broadcast(at), cam).withColumn("virtual", F.col("_index") * F.col("_block") + F.col(frame) + 1).drop("_block", "_index")


def identified(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows(cam, local, ts, ...) with the ``gid`` of the first span (cam, local, start, end, gid) that holds them, null outside all."""
    s = spans.select("cam", "local", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("gid").alias("_g"))
    first = s.groupBy("cam", "local").agg(F.sort_array(F.collect_list(F.struct("_s", "_e", "_g"))).alias("_spans"))
    hit = F.filter("_spans", lambda x: F.col("ts").between(x["_s"], x["_e"]))
    return rows.join(first, ["cam", "local"], "left").withColumn("gid", F.get(hit, F.lit(0))["_g"]).drop("_spans")
