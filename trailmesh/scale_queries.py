"""Registered queries over time joins, numbers and quantiles as operators; the plain SQL texts of the same names are their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.operators import ranks, temporal
from trailmesh.operators.spread import spread
from trailmesh.plans import portable

DAY_US = 86_400_000_000


def _of(spark: SparkSession, sf_dir: str, part: str, columns: str) -> DataFrame:
    return portable.run(spark, sf_dir, f"WITH {part} SELECT {columns}")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, portable.SESSIONS, "cam, lid, seq, start_us, end_us FROM s")


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, portable.LATENCY, "kind, t0, t1, t2, t3, t4 FROM r")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = temporal.handovers(_sessions(spark, sf_dir), "lid", "cam", "seq", "start_us", "end_us", same_moment=True)
    return h.select("lid", "src", "src_seq", "dst", "dst_seq", (F.col("start_us") - F.col("end_us")).alias("gap_us"))


def handover_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = temporal.handovers(_sessions(spark, sf_dir), "lid", "cam", "seq", "start_us", "end_us")
    near = lambda c: F.col(c).isin("click", "view")
    kind = F.when(F.col("src") == F.col("dst"), "same_camera").when(near("src") & near("dst"), "overlap").otherwise("non_overlap")
    sets = [[], [F.col("kind")], [F.col("src"), F.col("dst")]]
    return h.withColumn("kind", kind).groupingSets(sets, "src", "dst", "kind").agg(F.count("*").alias("n"))


def transit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = temporal.handovers(_sessions(spark, sf_dir), "lid", "cam", "seq", "start_us", "end_us").filter("src <> dst").withColumn("gap", F.col("start_us") - F.col("end_us"))
    ends = h.groupBy("src", "dst").agg(F.min("gap").alias("min_us"), F.max("gap").alias("max_us"), F.count_if(F.col("gap") < 0).alias("n_negative"))
    middle = ranks.quantiles(h, ["src", "dst"], "gap", {"median_us": 0.5}).withColumn("median_us", F.round("median_us", 3))
    return middle.join(ends, ["src", "dst"]).select("src", "dst", "n", "min_us", "max_us", "median_us", "n_negative")


def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _of(spark, sf_dir, portable.SESSIONS, "cam, lid, eid, t FROM e0")
    return temporal.interval_lookup(e, _sessions(spark, sf_dir), ["cam", "lid"], "t", "start_us", "end_us", "eid", "seq", DAY_US).withColumnsRenamed({"point_id": "eid", "value": "seq"})


def exclusion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir).withColumn("gid", F.expr("lid % 50"))
    return temporal.overlap_counts(s, ["cam", "gid"], "lid", "start_us", "end_us", ["seq"]).filter("n = 0").select("cam", "lid", "seq")


def clashing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir).withColumn("gid", F.expr("lid % 40"))
    return temporal.overlap_counts(s, ["cam", "gid"], "lid", "start_us", "end_us", ["seq"]).filter("n > 0").select("cam", "gid", "seq", "lid", "n")


def frame_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames of each track without a gap, repeated frames counted once; one shuffle."""
    f = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("track"), F.col("l_orderkey").alias("frame"))
    own = W.partitionBy("track").orderBy("frame")
    step = F.coalesce(F.col("frame") - F.lag("frame").over(own), F.lit(2))
    rows = spread(f, ["track"], f).withColumn("_step", step).filter("_step > 0").withColumn("_island", F.count_if(F.col("_step") > 1).over(own.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("track", "_island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n")).drop("_island")


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person with most lines of each part; of equal ones the first seen, unknown last, then the least person, so that no tie is left open."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seen = F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    v = lines.groupBy(F.col("l_partkey").alias("track"), F.col("l_suppkey").alias("person")).agg(F.count("*").alias("n"), seen.alias("first_seen"))
    own = W.partitionBy("track")
    first = F.row_number().over(own.orderBy(F.desc("n"), F.asc_nulls_last("first_seen"), F.asc_nulls_last("person")))
    won = v.withColumns({"total": F.sum("n").over(own), "rn": first}).filter("rn = 1")
    # A half in the seventh place is rounded after scaling in doubles, as the oracle does, and not in decimals.
    return won.select("track", "person", "n", (F.round(F.col("n") / F.col("total") * 1e6) / 1e6).alias("purity"))


def mot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only distinct sources are ranked."""
    s = _sessions(spark, sf_dir)
    cams = s.select("cam").distinct().withColumn("_i", F.row_number().over(W.orderBy("cam")) - 1)
    return s.join(cams, "cam").select((F.col("_i") * F.lit(100_000).cast("bigint") + F.col("seq") + 1).alias("frame"), F.col("lid").alias("track"), "cam")


def local_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.numbered(_sessions(spark, sf_dir), ["cam"], "start_us", ["lid", "seq"], "local_id").select("cam", "lid", "seq", "local_id")


def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _latency(spark, sf_dir).withColumn("v", F.expr("t4 - t0"))
    return _rounded(ranks.quantiles(r, ["kind"], "v", {"p50": 0.5, "p95": 0.95}), "p50", "p95").drop("n")


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _latency(spark, sf_dir).withColumn("v", F.expr("t4 - t0"))
    return _rounded(ranks.quantiles(r, ["kind"], "v", {"p95": 0.95}, "nearest"), "p95").drop("n")


def stats_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _latency(spark, sf_dir).withColumn("v", F.expr("t2 - t0"))
    rest = r.groupBy("kind").agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"), F.count_if(F.col("v") < -0.001).alias("n_negative"))
    return _rounded(ranks.quantiles(r, ["kind"], "v", {"med": 0.5, "p90": 0.9, "p99": 0.99}), "med", "p90", "p99").join(rest, "kind")


def latency_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, median and p90 of five segments."""
    parts = [F.struct(F.lit(f"a{i}{j}").alias("seg"), (F.col(f"t{j}") - F.col(f"t{i}")).alias("v")) for i, j in ((0, 1), (1, 2), (2, 3), (3, 4), (0, 4))]
    return _rounded(ranks.quantiles(_latency(spark, sf_dir).select(F.inline(F.array(*parts))), ["seg"], "v", {"med": 0.5, "p90": 0.9}), "med", "p90")


def latency_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two segments among the slowest tenth, less those of all."""
    r = _latency(spark, sf_dir).select(F.expr("t4 - t0").alias("v"), F.expr("t1 - t0").alias("d01"), F.expr("t4 - t3").alias("d34"))
    p90 = ranks.quantiles(r, [], "v", {"p": 0.9})
    tail = r.join(p90.select("p"), F.col("v") >= F.col("p"))  # one row
    out = tail.agg(F.count("*").alias("n"))
    for c in ("d01", "d34"):
        own, every = (ranks.quantiles(x, [], c, {c: 0.5}).select(F.col(c).alias(name)) for x, name in ((tail, "a"), (r, "b")))
        out = out.join(own).join(every).withColumn(c, F.round(F.col("a") - F.col("b"), 6)).drop("a", "b")
    return out


def target_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _latency(spark, sf_dir).withColumn("v", F.expr("t4 - t0"))
    q = ranks.quantiles(r, [], "v", {"p95": 0.95, "worst": 1.0})
    return q.select(F.round("p95", 6).alias("p95"), F.round("worst", 6).alias("worst"), (F.col("p95") < 1).alias("pass"))


def session_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _of(spark, sf_dir, portable.SCORED, "lang, score, y FROM d")
    rest = d.groupBy("lang").agg(F.round(F.avg("score"), 6).alias("mean"), F.sum("y").cast("bigint").alias("positives"))
    return _rounded(ranks.quantiles(d, ["lang"], "score", {"p95": 0.95}), "p95").drop("n").join(rest, "lang")


QUERIES = {
    f.__name__: f
    for f in (
        handovers, handover_tally, transit_stats, interval_lookup, exclusion_overlap, clashing_spans, frame_islands, majority_vote, mot_export, local_renumbering,
        percentile_linear, percentile_nearest, stats_bundle, latency_segments, latency_tail, target_verdict, session_pool,
    )
}
