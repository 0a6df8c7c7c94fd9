"""Registered queries of the identity engine: pair costs, rounds, and their oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh.operators import association, pair_cost, rounds, temporal

#: Users of a site; sites grow in number with the users.
SITE = 10
DAY_US = 86_400_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", F.col("event_type").alias("cam"), t.alias("t"), "value", F.floor(F.col("user_id") / SITE).alias("site"))


def _with_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Each user has the vector of its number, counted around the table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("_v"), F.col("embedding").cast("array<double>").alias("vec"))
    n = e.agg((F.max("_v") + 1).alias("_n"))  # one row
    return rows.join(F.broadcast(n)).withColumn("_v", F.expr("user_id % _n")).join(e, "_v", "left").drop("_v", "_n")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = temporal.sessionize(_events(spark, sf_dir), ["cam", "user_id"], "t", DAY_US, ["event_id"])
    by = F.struct("t", "event_id")
    point = lambda pick, side: [pick(F.round("value", 2), by).alias(f"x{side}"), pick(F.col("event_id") % 97, by).cast("double").alias(f"y{side}")]
    s = e.groupBy("site", "cam", "user_id", "seq").agg(
        F.expr("min(t) div 1000").alias("start"), F.expr("max(t) div 1000").alias("end"), F.min("event_id").alias("tid"), *point(F.min_by, 0), *point(F.max_by, 1)
    )
    return _with_vectors(spark, sf_dir, s)


def pair_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of all sessions with all earlier ones of their site that a walk of one minute to twelve hours can follow."""
    s = _sessions(spark, sf_dir)
    cams = s.agg(F.collect_set("cam").alias("all")).select(F.explode("all").alias("src"), "all")
    hop = cams.select("src", F.explode("all").alias("dst")).filter("src <> dst")
    hop = hop.withColumns({"min_ms": F.lit(60_000).cast("bigint"), "max_ms": F.lit(43_200_000).cast("bigint")})
    tracks = s.select(
        "site", F.col("tid").alias("gid"), "cam", F.col("end").alias("seen"), F.when(F.col("tid") % 9 > 0, F.col("x1")).alias("x"), F.col("y1").alias("y"),
        F.array(F.struct("cam", "start", "end")).alias("spans"), F.when(F.col("vec").isNull(), F.array().cast("array<array<double>>")).otherwise(F.array("vec")).alias("entries"),
    )
    starts = s.select("site", "tid", "cam", "start", "end", F.when(F.col("tid") % 7 > 0, F.col("x0")).alias("x"), F.col("y0").alias("y"), "vec")
    out = pair_cost.pair_costs(starts, tracks, hop, weight=0.01, max_ground_m=5.0, max_speed_m_s=0.001, bucket_ms=21_600_000)
    return out.select("tid", "gid", "elapsed", *[F.round(c, 6).alias(c) for c in ("distance", "similarity", "cost")])


def offline_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities over the sessions of all users, by site."""
    found = association.associate_offline(_sessions(spark, sf_dir), association.Config(window_ms=3_600_000, ttl_ms=7 * 86_400_000))
    return found.select("site", "tid", "gid", F.round("cost", 6).alias("cost"), "reason")


def round_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions of the round engine over every event as a frame of its camera, in hourly windows."""
    e = _with_vectors(spark, sf_dir, _events(spark, sf_dir).withColumn("ms", F.expr("t div 1000")))
    frames = rounds.frames_of(e, ["site", "cam", "ms"], F.struct("ms", "cam"), local=F.col("user_id"), x=F.col("value"), y=(F.col("event_id") % 97).cast("double"), vec=F.col("vec"))
    c = association.Config(window_ms=3_600_000, idle_ms=86_400_000, ttl_ms=7 * 86_400_000, min_frames=2, revise_after=4, max_cost=0.3, max_ground_m=200.0)
    return rounds.associate_frames(frames, c).select("site", "round_ms", "kind", "tid", "cam", "local", "start", "end", "n_frames", "gid", F.round("cost", 6).alias("cost"), "reason")


_SESSIONS_SQL = f"""
e AS (SELECT event_id, user_id, event_type AS cam, epoch_us(ts) AS t, value, user_id // {SITE} AS site FROM events),
f AS (SELECT *, coalesce((t - lag(t) OVER w > {DAY_US})::INT, 0) AS fresh FROM e WINDOW w AS (PARTITION BY cam, user_id ORDER BY t, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY cam, user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM f),
s AS (SELECT site, cam, user_id, seq, min(t) // 1000 AS a, max(t) // 1000 AS b, min(event_id) AS tid, arg_min(round(value, 2), (t, event_id)) AS x0, arg_min(event_id % 97, (t, event_id))::DOUBLE AS y0,
      arg_max(round(value, 2), (t, event_id)) AS x1, arg_max(event_id % 97, (t, event_id))::DOUBLE AS y1 FROM g GROUP BY ALL),
v AS (SELECT s.*, embedding::DOUBLE[] AS vec FROM s JOIN embeddings ON vec_id = user_id % (SELECT max(vec_id) + 1 FROM embeddings))"""

QUERIES = {f.__name__: f for f in (pair_costs, offline_association, round_decisions)}
ORACLE_SQL = {
    "pair_costs": f"""WITH {_SESSIONS_SQL},
p AS (SELECT t.tid, k.tid AS gid, t.a - k.b AS elapsed, CASE WHEN t.tid % 7 > 0 AND k.tid % 9 > 0 THEN sqrt((t.x0 - k.x1) ** 2 + (t.y0 - k.y1) ** 2) END AS d, list_dot_product(t.vec, k.vec) AS s
      FROM v t, v k WHERE t.site = k.site AND t.cam <> k.cam AND t.a - k.b BETWEEN 60000 AND 43200000)
SELECT tid, gid, elapsed, round(d, 6) AS distance, round(s, 6) AS similarity, round(1 - s + coalesce(0.01 * least(d, 5.0), 0), 6) AS cost FROM p WHERE d IS NULL OR d <= 5.0 + 0.001 * elapsed / 1000.0""",
}
