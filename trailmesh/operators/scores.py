"""Score curves from a histogram of distinct scores, without a window or a cross join over all rows.

Rows are first counted per distinct score. Distinct scores are then cut into at most
``parts`` ranges, each range is summed up alone, and the totals of the ranges before it
(at most ``parts`` rows) are added. Null scores and null labels are left out; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.operators.lineage import computed_once


def histogram(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, pos, neg: rows with label 1 and 0 of each distinct score."""
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))


def running(hist: DataFrame, parts: int = 200) -> DataFrame:
    """hist with pos_below and neg_below, the rows with a smaller score, and pos_all and neg_all.

    The ranges' bounds are approximate percentiles; any bounds give the same sums.
    """
    hist = computed_once(hist)
    cuts = F.broadcast(hist.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 1000).alias("cuts")))
    placed = hist.crossJoin(cuts).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")
    totals = placed.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # at most `parts` rows
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "pn"], *[F.sum(c).over(whole).alias(f"{c}_all") for c in "pn"]
    )
    inside = W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    own = {k: F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in ("pos", "neg")}
    return (
        placed.withColumn("_pos", own["pos"])
        .withColumn("_neg", own["neg"])
        .join(F.broadcast(offsets), "part")
        .select("score", "pos", "neg", (F.col("_pos") + F.col("p_before")).alias("pos_below"), (F.col("_neg") + F.col("n_before")).alias("neg_below"), F.col("p_all").alias("pos_all"), F.col("n_all").alias("neg_all"))
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the curve, ties counted half; null without rows of both labels."""
    r = running(histogram(df, score, label))
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.max("pos_all").cast("double") * F.max("neg_all")
    return r.agg(F.when(pairs > 0, won / pairs).alias("auc"))


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the score whose rows at or above it have the best F1; the smallest of a tie."""
    r = running(histogram(df, score, label))
    tp = F.col("pos_all") - F.col("pos_below")
    kept = tp + F.col("neg_all") - F.col("neg_below")
    f1 = 2 * tp.cast("double") / (kept + F.col("pos_all"))
    return r.select(F.struct(f1.alias("f1"), (-F.col("score")).alias("m")).alias("k")).agg(F.max("k").alias("k")).filter("k IS NOT NULL").select((-F.col("k.m")).alias("score"), F.col("k.f1").alias("f1"))


def sweep(df: DataFrame, score: str, label: str, step: float) -> DataFrame:
    """tp and fp of rows at or above each cut; cuts are the multiples of ``step`` that have rows."""
    cut = (F.floor(F.col(score) / step) * step).cast("double")
    r = running(histogram(df.withColumn("_cut", cut), "_cut", label))
    return r.select(F.col("score").alias("cut"), (F.col("pos_all") - F.col("pos_below")).alias("tp"), (F.col("neg_all") - F.col("neg_below")).alias("fp"))
