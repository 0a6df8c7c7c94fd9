"""Scores and reports of a run against its reference, from counts and not from pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.operators import ranks
from trailmesh.operators.assign import match_groups
from trailmesh.operators.spread import spread


class LeakageError(ValueError):
    """Sessions that are in more than one part of a split."""


#: Why a tracklet became a new identity; other prefixes are no kind.
NEW_KINDS = ("empty", "no_candidate", "threshold", "taken")


def pair_scores(rows: DataFrame) -> DataFrame:
    """One row of rows(cam, local, person, gid), one row a track: precision, recall and f1 over pairs of two cameras, and what broke.

    Pairs are counted from cells: all pairs of a group less those within one camera. Without pairs, precision and recall are 1.
    """
    r = rows.filter("person IS NOT NULL AND gid IS NOT NULL")

    def pairs(*keys: str) -> DataFrame:
        n = r.groupBy(*keys, "cam").agg(F.count("*").cast("double").alias("n")).groupBy(*keys).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
        return n.agg(F.coalesce(F.sum(F.col("s") * F.col("s") - F.col("q")) / 2, F.lit(0.0)).alias("p"))

    tp, same_gid, same_person = (pairs(*k).select(F.col("p").alias(n)) for k, n in ((("person", "gid"), "tp"), (("gid",), "found"), (("person",), "true")))
    spread = lambda a, b, n: r.groupBy(a).agg(F.countDistinct(b).alias("k")).agg(F.count("*").alias(f"n_{a}"), F.count_if(F.col("k") > 1).alias(n))
    one = r.agg(F.count("*").alias("n_tracklet")).join(tp).join(same_gid).join(same_person).join(spread("person", "gid", "broken")).join(spread("gid", "person", "merged"))
    ratio = lambda d: F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(1.0)
    one = one.withColumns({"precision": ratio("found"), "recall": ratio("true")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return one.select("n_tracklet", F.col("n_person").alias("n_identity"), "n_gid", "broken", "merged", "precision", "recall", f1.alias("f1"))


def id_decomposition(appearances: DataFrame) -> DataFrame:
    """One row of appearances(gid, person, n_frames): n_ids = junk + covered + surplus - merges, checked, and the junk's frames.

    Junk identities have no appearance of a known person.
    """
    known = appearances.filter("person IS NOT NULL")
    ids = appearances.groupBy("gid").agg(F.count("person").alias("k")).agg(F.count("*").alias("n_ids"), F.count_if(F.col("k") == 0).alias("junk"))
    cells = known.select("gid", "person").distinct()
    people = cells.groupBy("person").agg((F.count("*") - 1).alias("s")).agg(F.count("*").alias("covered"), F.coalesce(F.sum("s"), F.lit(0)).alias("surplus"))
    merges = cells.groupBy("gid").agg((F.count("*") - 1).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("merges"))
    frames = appearances.agg(F.coalesce(F.sum("n_frames"), F.lit(0)).alias("frames"), F.coalesce(F.sum(F.when(F.col("person").isNull(), F.col("n_frames"))), F.lit(0)).alias("frames_unknown"))
    out = ids.join(people).join(merges).join(frames)
    balanced = F.col("n_ids") == F.col("junk") + F.col("covered") + F.col("surplus") - F.col("merges")
    return out.filter(F.when(balanced, F.lit(True)).otherwise(F.raise_error(F.lit("the counts do not add up")).cast("boolean")))


def point_classes(observations: DataFrame) -> DataFrame:
    """frame, gid, class of observations(frame, gid, person), null persons unknown: junk, mixed, partial, split or solo."""
    p = observations.groupBy("frame", "gid").agg(F.countDistinct("person").alias("k"), F.max("person").alias("person"), F.count_if(F.col("person").isNull()).alias("unknown"))
    spread = observations.filter("person IS NOT NULL").groupBy("frame", "person").agg(F.countDistinct("gid").alias("ids"))
    kind = F.when(F.col("k") == 0, "junk").when(F.col("k") > 1, "mixed").when(F.col("unknown") > 0, "partial").when(F.col("ids") > 1, "split").otherwise("solo")
    return p.join(spread, ["frame", "person"], "left").select("frame", "gid", kind.alias("class"))


def point_matches(points: DataFrame, truth: DataFrame, most_m: float) -> DataFrame:
    """frame, gid, person, distance of ground points(frame, gid, x, y) matched one to one with truth(frame, person, x, y), nearest in all."""
    a = points.select("frame", "gid", F.col("x").alias("_x"), F.col("y").alias("_y"))
    pairs = a.join(truth.select("frame", "person", "x", "y"), "frame").withColumn("distance", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).filter(F.col("distance") <= most_m)
    # As many pairs as can be first, then the least sum of distances.
    near = match_groups(pairs.withColumn("near", 1.0 - F.col("distance") / (2.0 * most_m + 1.0)), ["frame"], "gid", "person", "near", 0.0, gate_first=True)
    return near.select("frame", "gid", "person").join(pairs.select("frame", "gid", "person", "distance"), ["frame", "gid", "person"])


def edge_ids(frames: DataFrame, keys: list[str], frame: str, n: int, tail: bool = False) -> DataFrame:
    """keys, gid: the identity most frequent on the first (or last) n matched frames of each appearance; the nearest to the edge of a tie.

    frames(keys, frame, gid); null gids are not matched.
    """
    order = F.desc(frame) if tail else F.asc(frame)
    first = frames.filter("gid IS NOT NULL").withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter(F.col("_r") <= n)
    votes = first.groupBy(*keys, "gid").agg(F.count("*").alias("_n"), F.min("_r").alias("_at"))
    return votes.groupBy(*keys).agg(F.max_by("gid", F.struct("_n", -F.col("_at"))).alias("gid"))


def frame_latency_samples(records: DataFrame, step_ms: float = 10.0, slack: float = 2.0) -> DataFrame:
    """tracklet, latency of frames between one publication of a tracklet and the next, sampled evenly back from the newer one.

    records(tracklet, t0, t4) in milliseconds. The stretch ends at the frame published before, or after ``slack`` median
    gaps between publications. The step is at most a tenth of that gap, one at least.
    """
    own = W.partitionBy("tracklet").orderBy("t4", "t0")
    pairs = records.withColumns({"_t0": F.lag("t0").over(own), "_t4": F.lag("t4").over(own)}).filter("_t4 IS NOT NULL").select("tracklet", "t0", "t4", "_t0", (F.col("t4") - F.col("_t4")).alias("gap"))
    gap = ranks.quantiles(pairs, [], "gap", {"gap_all": 0.5}).select("gap_all")  # one row
    p = pairs.join(F.broadcast(gap)).withColumn("step", F.least(F.lit(float(step_ms)), F.greatest(F.col("gap_all") / 10, F.lit(1.0))))
    far = F.col("t0") - F.greatest(F.col("_t0"), F.col("t0") - slack * F.col("gap_all"))
    n = F.ceil(far / F.col("step")).cast("int")
    back = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    return p.withColumn("_k", back).select("tracklet", (F.col("t4") - F.col("t0") + F.col("_k") * F.col("step")).alias("latency"))


def clock_fits(samples: DataFrame, keys: list[str], bin_s: float = 5.0, skip_s: float = 2.0, least_bins: int = 3) -> DataFrame:
    """keys, offset_s, drift, jitter_ms, n_samples, n_bins of samples(keys, t, p): wall time t at file time p.

    A line through the lowest delay of each bin of file time; with few bins their least delay and no drift. The first
    seconds are left out where there is anything later. The jitter is the median height of samples over the line.
    """
    # One shuffle by camera: what follows groups and joins in place.
    samples = spread(samples.select(*keys, "t", "p"), keys, samples)
    late = samples.groupBy(*keys).agg(F.max(F.col("p") >= skip_s).alias("_late"))
    s = samples.join(late.hint("merge"), keys).filter(~F.col("_late") | (F.col("p") >= skip_s)).withColumn("d", F.col("t") - F.col("p"))
    low = s.groupBy(*keys, F.floor(F.col("p") / bin_s).alias("_bin")).agg(F.count("*").alias("_n"), F.min(F.struct("d", "p")).alias("m")).select(*keys, "_n", F.col("m.p").alias("p"), F.col("m.d").alias("d"))
    fit = low.groupBy(*keys).agg(F.count("*").alias("n_bins"), F.sum("_n").alias("n_samples"), F.regr_slope("d", "p").alias("_s"), F.avg("d").alias("_d"), F.avg("p").alias("_p"), F.min("d").alias("_least"))
    line = F.col("n_bins") >= least_bins
    fit = fit.withColumn("drift", F.when(line, F.coalesce("_s", F.lit(0.0))).otherwise(0.0)).withColumn("offset_s", F.when(line, F.col("_d") - F.col("drift") * F.col("_p")).otherwise(F.col("_least")))
    over = s.join(fit.hint("merge"), keys).withColumn("jitter_ms", 1000 * (F.col("d") - F.col("offset_s") - F.col("drift") * F.col("p")))
    middle = over.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("jitter_ms"))).filter(F.col("_r") == F.floor(F.col("n_samples") / 2) + 1)
    return middle.select(*keys, "offset_s", "drift", "jitter_ms", "n_samples", "n_bins")


def fit_exit_directions(handovers: DataFrame, velocities: DataFrame, min_speed: float, least: int) -> DataFrame:
    """src, dst, dx, dy, n: mean unit direction of those who left src for dst clearly moving, for pairs with enough of them.

    handovers(src_tid, src, dst); velocities(tid, vx, vy) as of ``ground.exit_velocity``.
    """
    v = handovers.join(velocities.withColumnRenamed("tid", "src_tid"), "src_tid").withColumn("_s", F.hypot("vx", "vy")).filter((F.col("_s") >= min_speed) & (F.col("_s") > 0))
    m = v.groupBy("src", "dst").agg(F.count("*").alias("n"), F.avg(F.col("vx") / F.col("_s")).alias("_x"), F.avg(F.col("vy") / F.col("_s")).alias("_y")).withColumn("_l", F.hypot("_x", "_y"))
    return m.filter((F.col("n") >= least) & (F.col("_l") > 1e-9)).select("src", "dst", (F.col("_x") / F.col("_l")).alias("dx"), (F.col("_y") / F.col("_l")).alias("dy"), "n")


def sweep_rates(sweep: DataFrame, positives: int, negatives: int) -> DataFrame:
    """Add precision, retained (share of true kept) and removed (share of false gone) to a sweep's cut, tp and fp."""
    return sweep.withColumns({"precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), "retained": F.col("tp") / F.lit(max(positives, 1)), "removed": 1 - F.col("fp") / F.lit(max(negatives, 1))})


def reason_kind(reason: Column) -> Column:
    """The kind in front of a reason's colon, or '' for none of ``NEW_KINDS``."""
    head = F.substring_index(reason, ": ", 1)
    return F.when(reason.contains(": ") & head.isin(*NEW_KINDS), head).otherwise("")


def check_disjoint(parts: DataFrame) -> DataFrame:
    """parts(part, session) as it is; a session of two parts raises ``LeakageError``."""
    twice = sorted(r[0] for r in parts.groupBy("session").agg(F.countDistinct("part").alias("n")).filter("n > 1").select("session").limit(20).collect())
    if twice:
        raise LeakageError(f"sessions in more than one part: {twice}")
    return parts


def best_setting(scores: DataFrame, limit_ms: float = 1000.0) -> DataFrame:
    """One row of scores(place, name, hota, p95_ms): the best mean score among settings below the limit; the earlier of a tie. None is an error."""
    best = scores.filter(F.col("p95_ms") < limit_ms).groupBy("place", "name").agg(F.avg("hota").alias("hota"))
    m = best.agg(F.max(F.struct("hota", (-F.col("place")).alias("p"), "name")).alias("m"))
    return m.select(F.coalesce(F.col("m.name"), F.raise_error(F.lit("no setting is fast enough")).cast("string")).alias("name"), F.col("m.hota").alias("hota"))


def perfect_links(tracks: DataFrame) -> DataFrame:
    """tracks(cam, local, person, ...) with the ``gid`` that perfect association gives: a number for each person, and one for each track without."""
    known = tracks.select("person").filter("person IS NOT NULL").distinct()
    own = known.withColumn("gid", F.col("person").cast("bigint") * 2)
    alone = F.xxhash64("cam", "local")
    return tracks.join(own, "person", "left").withColumn("gid", F.coalesce("gid", alone.bitwiseOR(F.lit(1)))).select(*tracks.columns, "gid")
