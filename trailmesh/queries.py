"""Registry of the trajectory and identity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailmesh import diagnosis_queries, evaluation_queries, identity_queries, report_queries, scale_queries, shape_queries
from trailmesh.functions import geometry as G
from trailmesh.functions import vectors as V
from trailmesh.operators import assign, pooling, scores, temporal
from trailmesh.plans import portable

GAP_S = 86_400
MIN_ROWS = 2


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklets of events: maximal runs per (source, local id) without a gap over GAP_S."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("cam_id"), F.col("user_id").alias("local_track_id"), "ts", "event_id", "value"
    )
    run = W.partitionBy("cam_id", "local_track_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(run)
    e = e.withColumn("new", F.coalesce((gap > GAP_S * 1_000_000).cast("int"), F.lit(0)))
    e = e.withColumn("seq", F.sum("new").over(run))
    return (
        e.groupBy("cam_id", "local_track_id", "seq")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_frames"))
        .filter(F.col("n_frames") >= MIN_ROWS)
    )


def cross_camera_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    return (
        s.groupBy(F.col("local_track_id").alias("global_id"))
        .agg(
            F.min("start_ts").alias("created"),
            F.max("end_ts").alias("last_seen"),
            F.count("*").alias("n_tracklets"),
            F.countDistinct("cam_id").alias("n_cameras"),
        )
        .filter("n_cameras >= 2")
    )


SESSIONS_SQL = f"""
e AS (SELECT event_type cam_id, user_id local_track_id, ts, event_id, value FROM events),
f AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > {GAP_S}::BIGINT * 1000000)::INT, 0) AS is_new FROM e
      WINDOW w AS (PARTITION BY cam_id, local_track_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(is_new) OVER (PARTITION BY cam_id, local_track_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM f),
s AS (SELECT cam_id, local_track_id, seq::BIGINT seq, min(ts) start_ts, max(ts) end_ts, count(*) n_frames
      FROM g GROUP BY ALL HAVING count(*) >= {MIN_ROWS})
"""

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("event_type").alias("cam"), t.alias("t"), "value")


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest view of the same user within six hours of each click."""
    e = _events(spark, sf_dir)
    return temporal.asof_nearest(e.filter("cam = 'click'"), e.filter("cam = 'view'"), ["user_id"], "t", 21_600_000_000, "event_id", "event_id")


def interval_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session (by start) that holds each event, looked up by time."""
    e = temporal.sessionize(_events(spark, sf_dir), ["cam", "user_id"], "t", 86_400_000_000, ["event_id"])
    spans = e.groupBy("cam", "user_id", "seq").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return temporal.interval_lookup(e, spans, ["cam", "user_id"], "t", "a", "b", "event_id", "seq", 86_400_000_000)


def smooth_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = temporal.sessionize(_events(spark, sf_dir), ["cam", "user_id"], "t", 86_400_000_000, ["event_id"])
    return e.select("event_id", F.round(temporal.smooth_median("value", ["cam", "user_id", "seq"], ["t", "event_id"], 5), 6).alias("v"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("conf", ((F.col("vec_id") * 37 % 101) + 1) / 101)


def embedding_topk_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.pool_top_k(_embeddings(spark, sf_dir), ["label"], "embedding", "conf", "vec_id", 5)
    return pooled.select("label", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def gallery_similarity_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity of every vector to the gallery: the eight first vectors of each label."""
    e = _embeddings(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy("vec_id")))
    gallery = e.filter("rn <= 8").groupBy("label").agg(F.collect_list("embedding").alias("entries"))
    best = F.array_max(F.transform("entries", lambda g: V.dot(F.col("embedding"), g)))
    return e.select("vec_id", "label", "embedding").join(gallery, "label").select("vec_id", F.round(best, 6).alias("similarity"))


def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal matches of odd with even detections of each frame by overlap."""
    b = portable.run(spark, sf_dir, f"WITH {portable.BOXES} SELECT * FROM b")
    a, c = (b.filter(F.col("det") % 2 == k).select("frame", *[F.col(x).alias(f"{x}{k}") for x in ("det", "x", "y", "w", "h")]) for k in (1, 0))
    box = lambda k: tuple(F.col(f"{x}{k}") for x in "xywh")
    pairs = a.join(c, "frame").withColumn("iou", F.round(G.iou(box(1), box(0)), 9)).filter("iou > 0")
    return assign.match_groups(pairs, ["frame"], "det1", "det0", "iou", 0.1)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable.run(spark, sf_dir, f"WITH {portable.SCORED} SELECT score, y FROM d")


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.auc(_scored(spark, sf_dir), "score", "y").select(F.round("auc", 9).alias("auc"))


def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.best_f1(_scored(spark, sf_dir), "score", "y").select("score", F.round("f1", 9).alias("f1"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.sweep(_scored(spark, sf_dir), "score", "y", 500)


def identity_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of sorted names; only distinct names are ranked."""
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name")).distinct()
    return names.select("name", F.row_number().over(W.orderBy("name")).cast("bigint").alias("id"))


def _portable(text: str):
    return lambda spark, sf_dir: portable.run(spark, sf_dir, text)


QUERIES = {"tracklet_sessionize": sessions, "cross_camera_tracks": cross_camera_tracks}
ORACLE_SQL = {
    "tracklet_sessionize": f"WITH {SESSIONS_SQL} SELECT * FROM s",
    "cross_camera_tracks": f"WITH {SESSIONS_SQL} SELECT local_track_id global_id, min(start_ts) created, max(end_ts) last_seen, "
    "count(*) n_tracklets, count(DISTINCT cam_id) n_cameras FROM s GROUP BY 1 HAVING count(DISTINCT cam_id) >= 2",
}

for _name, _text in portable.QUERIES.items():
    QUERIES[_name] = _portable(_text)
    ORACLE_SQL[_name] = portable.duck_sql(_text)

E2 = portable.duck_sql(portable.SESSIONS)
QUERIES |= {f.__name__: f for f in (asof_nearest, interval_first, smooth_median, embedding_topk_pool, gallery_similarity_max, iou_match)}
ORACLE_SQL |= {
    "asof_nearest": """WITH e AS (SELECT event_id, user_id, event_type AS cam, epoch_us(ts) AS t FROM events),
k AS (SELECT a.event_id AS left_id, b.event_id AS right_id, abs(a.t - b.t) AS distance,
      row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) AS rn
      FROM e a JOIN e b ON a.user_id = b.user_id AND a.cam = 'click' AND b.cam = 'view' AND abs(a.t - b.t) <= 21600000000)
SELECT left_id, right_id, distance FROM k WHERE rn = 1""",
    "interval_first": f"WITH {E2}, h AS (SELECT e0.eid AS event_id, s.seq AS value, row_number() OVER (PARTITION BY e0.eid ORDER BY s.start_us, s.seq) AS rn "
    "FROM e0 JOIN s ON e0.cam = s.cam AND e0.lid = s.lid AND e0.t BETWEEN s.start_us AND s.end_us) SELECT event_id AS point_id, value FROM h WHERE rn = 1",
    "smooth_median": f"WITH {E2} SELECT eid AS event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY cam, lid, seq ORDER BY t, eid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM e2",
    "embedding_topk_pool": """WITH c AS (SELECT label, vec_id, embedding, ((vec_id * 37 % 101) + 1) / 101 AS conf FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY conf DESC, vec_id) AS rn FROM c),
p AS (SELECT label, conf, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM k WHERE rn <= 5),
m AS (SELECT label, dim, sum(conf * v) / sum(conf) AS m FROM p GROUP BY label, dim)
SELECT label, dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m""",
    "gallery_similarity_max": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
SELECT a.vec_id, round(max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN k b ON a.label = b.label AND b.rn <= 8 GROUP BY a.vec_id""",
}
# Operators of their own; the plain texts stay their oracles. Cuts cover all scores.
QUERIES |= {f.__name__: f for f in (auc, best_f1, threshold_sweep, identity_numbering)}
# Queries whose plain text would gather a group in one task.
QUERIES |= scale_queries.QUERIES
ORACLE_SQL["threshold_sweep"] = ORACLE_SQL["threshold_sweep"].replace(" WHERE score < 20000", "")
for _more in (diagnosis_queries, evaluation_queries, identity_queries, report_queries, shape_queries):
    QUERIES |= _more.QUERIES
    ORACLE_SQL |= _more.ORACLE_SQL
