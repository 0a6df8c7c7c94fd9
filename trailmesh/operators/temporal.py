"""Time joins and sessions on keyed event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessionize(df: DataFrame, keys: list[str], t: str, gap: int, order: list[str] | None = None, name: str = "seq") -> DataFrame:
    """Add the number of the session: a new one starts after a step of more than ``gap``."""
    run = W.partitionBy(*keys).orderBy(t, *(order or []))
    new = F.coalesce((F.col(t) - F.lag(t).over(run) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(run.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, tolerance: int, left_id: str, right_id: str) -> DataFrame:
    """The nearest right row of each left row within the tolerance; the earlier one of a tie.

    Both sides are cut into time buckets as wide as the tolerance, so the band join is
    an equi join on (keys, bucket) with the right side in three buckets.
    """
    bucket = F.floor(F.col(t) / tolerance)
    a = left.select(*keys, F.col(t).alias("_lt"), F.col(left_id).alias("left_id"), bucket.alias("_b"))
    b = right.select(*keys, F.col(t).alias("_rt"), F.col(right_id).alias("right_id"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    near = a.join(b, [*keys, "_b"]).withColumn("distance", F.abs(F.col("_lt") - F.col("_rt"))).filter(F.col("distance") <= tolerance)
    best = near.groupBy("left_id").agg(F.min(F.struct("distance", "_rt", "right_id")).alias("m"))
    return best.select("left_id", "m.right_id", "m.distance")


def interval_lookup(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, point_id: str, value: str, width: int) -> DataFrame:
    """The value of the first span (by start) that holds each point; both ends belong to a span.

    Time is cut into buckets of ``width``; a span lies in each bucket that it touches, so a
    point meets the spans of its own bucket only.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    s = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("value"), F.explode(F.sequence(bucket(start), bucket(end))).alias("_b"))
    p = points.select(*keys, F.col(t).alias("_t"), F.col(point_id).alias("point_id"), bucket(t).alias("_b"))
    hit = p.join(s, [*keys, "_b"]).filter(F.col("_t").between(F.col("_s"), F.col("_e")))
    return hit.groupBy("point_id").agg(F.min(F.struct("_s", "value")).alias("m")).select("point_id", "m.value")


def overlapping(spans: DataFrame, keys: list[str], start: str, end: str, columns: list[str], width: int) -> DataFrame:
    """Pairs of spans of a key that share a moment, both ways: keys, columns, and the other's as ``other_``.

    A pair is found in every bucket of ``width`` that both touch and kept where the later of the two begins.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    a = spans.select(*keys, *columns, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(bucket(start), bucket(end))).alias("_b"))
    b = a.select(*keys, "_b", F.col("_s").alias("_os"), F.col("_e").alias("_oe"), *[F.col(c).alias(f"other_{c}") for c in columns])
    met = a.join(b, [*keys, "_b"]).filter((F.col("_s") <= F.col("_oe")) & (F.col("_os") <= F.col("_e")))
    return met.filter(F.floor(F.greatest("_s", "_os") / width) == F.col("_b")).select(*keys, *columns, *[f"other_{c}" for c in columns])


def overlap_counts(spans: DataFrame, keys: list[str], owner: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """keys, owner, columns, n: with how many spans of its key's other owners each span shares a moment.

    keys, owner and columns name a span. Nothing is paired: what began by a span's end, less what ended before its
    start, met it; both are running counts over the ends of spans, once of all owners and once of its own.
    """
    names = [*keys, owner, *columns]
    # At one moment starts come before ends, so spans that touch meet.
    side = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("k")), F.struct(F.col(end).alias("t"), F.lit(1).alias("k"))))
    points = spans.select(*names, side.alias("_p")).select(*names, F.col("_p.t").alias("_t"), F.col("_p.k").alias("_k"))
    counts = lambda *by: F.when(F.col("_k") == 1, F.count_if(F.col("_k") == 0).over(run(*by))).otherwise(-F.count_if(F.col("_k") == 1).over(run(*by)))
    run = lambda *by: W.partitionBy(*by).orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    met = points.withColumn("_all", counts(*keys)).withColumn("_own", counts(*keys, owner))
    return met.groupBy(*names).agg((F.sum("_all") - F.sum("_own")).alias("n"))


def handovers(spans: DataFrame, key: str, cam: str, seq: str, start: str, end: str, same_moment: bool = False) -> DataFrame:
    """Each appearance with the one of its identity it follows: key, src, src_seq, end_us, dst, dst_seq, start_us.

    That is the earlier-begun one that ended last, then by camera and number; with ``same_moment`` one of a lesser
    camera that begins at the same moment counts as earlier. Spans without an identity or a time follow and
    precede nothing; an unknown camera comes last. One ordered pass over an identity.
    """
    spans = spans.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    last = F.min(F.struct((-F.col(end)).alias("e"), F.col(cam).isNull().alias("u"), F.col(cam).alias("c"), F.col(seq).alias("q")))
    own = W.partitionBy(key)
    found = last.over(own.orderBy(start).rangeBetween(W.unboundedPreceding, -1))
    if same_moment:
        among = own.orderBy(start, F.col(cam).asc_nulls_last(), seq).rowsBetween(W.unboundedPreceding, -1)
        found = F.when(F.col(cam).isNull(), found).otherwise(last.over(among))
    rows = spans.withColumn("_m", found).filter("_m IS NOT NULL")
    return rows.select(key, F.col("_m.c").alias("src"), F.col("_m.q").alias("src_seq"), (-F.col("_m.e")).alias("end_us"), F.col(cam).alias("dst"), F.col(seq).alias("dst_seq"), F.col(start).alias("start_us"))


def smooth_median(value: str, keys: list[str], order: list[str], window: int) -> Column:
    """Centred moving median, truncated at the ends of a segment."""
    half = window // 2
    return F.percentile(F.col(value), F.lit(0.5)).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half))
