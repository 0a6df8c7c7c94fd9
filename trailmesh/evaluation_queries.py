"""Registered queries of the ground and evaluation operators, with oracles written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh.operators import evaluation as E
from trailmesh.operators import ground as G


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", t.alias("t"), (t / 1000).cast("bigint").alias("ms"), "value")


def asof_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return E.asof_following(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"], "t", 21_600_000_000, "event_id", "event_id")


def exit_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("y", F.col("event_id") % 97)
    v = G.exit_velocity(e, ["user_id"], "ms", "value", "y", 864_000_000)
    return v.select("user_id", F.round("vx", 9).alias("vx"), F.round("vy", 9).alias("vy"))


def ground_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    p = lines.selectExpr("l_orderkey frame", "cast(l_linenumber as bigint) gid", "cast(l_quantity as double) x", "round(l_discount * 100.0D) y", "cast(l_linenumber % 3 as bigint) support")
    return G.ground_nms(p, ["frame"], "gid", "x", "y", "support", 12.0)


def corrected_ground_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey frame", "l_linenumber det", "l_returnflag cam_a", "l_linestatus cam_b",
        "cast(l_quantity as double) ax", "round(l_discount * 100.0D) ay", "cast(l_quantity + 1 as double) bx", "round(l_tax * 100.0D) by",
    )
    models = spark.createDataFrame([("A", "F", 5.0, 2.0, 0.5, -0.25, 1.0), ("O", "R", 5.0, 2.0, 0.0, 0.0, 4.0), ("F", "R", 8.0, 1.0, 1.0, 1.0, 2.0)], "cam_1 string, cam_2 string, cell_m double, sigma_ref double, mu_x double, mu_y double, sigma double")
    cells = spark.createDataFrame([("A", "F", 2, 0, 1.0, 1.0, 0.5), ("F", "R", 1, 0, 0.0, -1.0, 4.0)], "cam_1 string, cam_2 string, ix bigint, iy bigint, cell_mu_x double, cell_mu_y double, cell_sigma double")
    return G.corrected_distances(p, models, cells).select("frame", F.col("det").cast("bigint").alias("det"), F.round("corrected", 6).alias("corrected"))


def interpolated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("track"), F.col("l_suppkey").alias("frame")).agg(F.max(F.col("l_quantity").cast("double")).alias("x"))
    filled = E.interpolate_boxes(rows, ["track"], "frame", ["x"], 50)
    return filled.select("track", "frame", F.round("x", 6).alias("x"), "filled")


def common_time_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey moment", "l_suppkey track", "cast(l_quantity as double) x", "round(l_discount * 100.0D) y")
    d = E.common_time_distance(p, ["moment"], "track", "x", "y", 2)
    return d.withColumn("distance", F.round("distance", 6))


def assembled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_returnflag cam", "l_orderkey frame", "l_linenumber det", "l_quantity x")
    spans = rows.groupBy("cam").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    out = E.assemble_frames(rows, spans, "cam", "frame")
    return out.select("cam", "frame", F.size("detections").cast("bigint").alias("n"), F.get("detections", F.lit(0))["det"].cast("bigint").alias("first_det"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_returnflag cam", "l_partkey track", "CASE WHEN l_linenumber > 1 THEN l_suppkey END person")
    out = E.run_summary(rows, "cam", "track", "person", 1000)
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in out.dtypes])


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 5 END person", "CASE WHEN o_orderkey % 7 > 2 THEN o_orderkey END chosen", "o_orderkey % 5 chosen_person",
        "o_orderkey % 2 = 0 has_true", "CASE WHEN o_custkey % 3 = 0 THEN 'time' END blocked_by", "CASE WHEN o_custkey % 4 > 0 THEN cast(o_orderkey % 10 as double) END true_cost", "5.0D true_limit",
    )
    return E.decision_log(rows).groupBy("decision", "why").agg(F.count("*").alias("n"))


def trail_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("_t", E.trail(32, ["user_id"], ["t", "event_id"], "event_id", "value"))
    return e.select("event_id", F.size("_t").cast("bigint").alias("n"), F.col("_t")[0]["event_id"].alias("oldest"))


def latency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _events(spark, sf_dir).selectExpr("event_type kind", "0.0D t0", "value / 10 t4")
    return E.latency_by(r, "kind").select("kind", "n", *[F.round(c, 6).alias(c) for c in ("median", "p90", "p99")])


def latency_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _events(spark, sf_dir).selectExpr("CASE WHEN event_id % 9 = 0 THEN 'probe' ELSE 'camera' END t0_source", "0.0D t0", "value - 5 t1", "value - 50 t2")
    return E.latency_warnings(r, ["t0", "t1", "t2"])


QUERIES = {f.__name__: f for f in (asof_following, exit_velocity, ground_nms, corrected_ground_distance, interpolated_boxes, common_time_distance, assembled_frames, run_summary, decision_log, trail_positions, latency_groups, latency_warnings)}
ORACLE_SQL = {
    "asof_following": """WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
v AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
n AS (SELECT c.event_id AS left_id, coalesce((SELECT min(v.t) FROM v WHERE v.user_id = c.user_id AND v.t >= c.t), (SELECT max(v.t) FROM v WHERE v.user_id = c.user_id)) AS hit, c.t, c.user_id FROM c)
SELECT left_id, min(v.event_id) AS right_id, any_value(hit - n.t) AS gap FROM n JOIN v ON v.user_id = n.user_id AND v.t = hit WHERE abs(hit - n.t) <= 21600000000 GROUP BY left_id""",
    "exit_velocity": """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value AS x, event_id % 97 AS y, max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, round(regr_slope(x, (ms - last) / 1000), 9) AS vx, round(regr_slope(y, (ms - last) / 1000), 9) AS vy FROM e WHERE ms >= last - 864000000
GROUP BY user_id HAVING count(*) >= 4 AND max(ms) - min(ms) >= 432000000""",
    "ground_nms": """WITH RECURSIVE p AS (SELECT l_orderkey AS frame, l_linenumber::BIGINT AS gid, l_quantity::DOUBLE AS x, round(l_discount * 100)::DOUBLE AS y, (l_linenumber % 3)::BIGINT AS support,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3 DESC, l_linenumber, l_quantity, round(l_discount * 100)) AS i FROM lineitem),
k AS (SELECT frame, i, [{'gid': gid, 'x': x, 'y': y, 'support': support}] AS kept FROM p WHERE i = 1
 UNION ALL SELECT p.frame, p.i, CASE WHEN (SELECT bool_and(sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) > 12) FROM (SELECT unnest(k.kept) AS q))
 THEN list_append(k.kept, {'gid': p.gid, 'x': p.x, 'y': p.y, 'support': p.support}) ELSE k.kept END FROM k JOIN p ON p.frame = k.frame AND p.i = k.i + 1),
l AS (SELECT frame, unnest(max_by(kept, i)) AS q FROM k GROUP BY frame)
SELECT frame, q.gid AS gid, q.x AS x, q.y AS y, q.support AS support FROM l""",
    "corrected_ground_distance": """WITH p AS (SELECT l_orderkey AS frame, l_linenumber::BIGINT AS det, l_returnflag AS a, l_linestatus AS b, l_quantity::DOUBLE AS ax, round(l_discount * 100)::DOUBLE AS ay, l_quantity::DOUBLE + 1 AS bx, round(l_tax * 100)::DOUBLE AS by_ FROM lineitem),
q AS (SELECT *, CASE WHEN a > b THEN -1 ELSE 1 END AS sign, least(a, b) || greatest(a, b) AS pair, (ax + bx) / 2 AS mx, (ay + by_) / 2 AS my FROM p),
m AS (SELECT *, CASE WHEN pair = 'AF' AND floor(mx / 5) = 2 AND floor(my / 5) = 0 THEN [1, 1, 0.5, 2] WHEN pair = 'AF' THEN [0.5, -0.25, 1, 2] WHEN pair = 'OR' THEN [0, 0, 4, 2]
 WHEN pair = 'FR' AND floor(mx / 8) = 1 AND floor(my / 8) = 0 THEN [0, -1, 4, 1] WHEN pair = 'FR' THEN [1, 1, 2, 1] END::DOUBLE[] AS w FROM q)
SELECT frame, det, round(sqrt(pow(sign * (bx - ax) - w[1], 2) + pow(sign * (by_ - ay) - w[2], 2)) * w[4] / w[3], 6) AS corrected FROM m""",
    "interpolated_boxes": """WITH b AS (SELECT l_partkey AS track, l_suppkey AS frame, max(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, lead(frame) OVER w AS f, lead(x) OVER w AS nx FROM b WINDOW w AS (PARTITION BY track ORDER BY frame)),
g AS (SELECT *, unnest(range(frame + 1, f)) AS mid FROM n WHERE f - frame <= 50)
SELECT track, frame, round(x, 6) AS x, false AS filled FROM b UNION ALL SELECT track, mid, round(x + (nx - x) * (mid - frame) / (f - frame), 6), true FROM g""",
    "common_time_distance": """WITH p AS (SELECT l_orderkey AS m, l_suppkey AS t, l_quantity::DOUBLE AS x, round(l_discount * 100)::DOUBLE AS y FROM lineitem)
SELECT a.t AS track_a, b.t AS track_b, round(median(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS distance, count(*) AS n FROM p a JOIN p b ON a.m = b.m AND a.t < b.t GROUP BY 1, 2 HAVING count(*) >= 2""",
    "assembled_frames": """WITH s AS (SELECT l_returnflag AS cam, unnest(range(min(l_orderkey), max(l_orderkey) + 1)) AS frame FROM lineitem GROUP BY 1)
SELECT s.cam, s.frame, count(l_linenumber) AS n, min(l_linenumber)::BIGINT AS first_det FROM s LEFT JOIN lineitem ON l_returnflag = s.cam AND l_orderkey = s.frame GROUP BY 1, 2""",
    "run_summary": """WITH r AS (SELECT l_returnflag AS cam, l_partkey AS track, CASE WHEN l_linenumber > 1 THEN l_suppkey END AS person FROM lineitem),
v AS (SELECT cam, track, person, count(*) AS n FROM r WHERE person IS NOT NULL GROUP BY ALL), t AS (SELECT cam, track, count(*) AS persons, max(n) / sum(n) AS purity FROM v GROUP BY ALL)
SELECT (SELECT count(*) FROM r) AS n_detections, (SELECT count(person) FROM r) AS n_matched, (SELECT round(count(person) / count(*), 9) FROM r) AS match_rate, (SELECT round(count(person) / 1000, 9) FROM r) AS recall,
(SELECT count(*) FROM (SELECT DISTINCT cam, track FROM r)) AS n_tracks, count(*) FILTER (persons > 1) AS n_multi_identity, round(median(purity), 9) AS purity_median, round(quantile_cont(purity, 0.1), 9) AS purity_p10 FROM t""",
    "decision_log": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders WHERE o_custkey % 11 > 0),
d AS (SELECT *, CASE WHEN k % 7 > 2 AND k % 5 = c % 5 THEN 'merge_ok' WHEN k % 7 > 2 THEN 'merge_wrong' WHEN k % 2 = 0 THEN 'split' ELSE 'new_ok' END AS decision FROM o)
SELECT decision, CASE WHEN decision <> 'split' THEN NULL WHEN c % 3 = 0 THEN 'infeasible:time' WHEN c % 4 = 0 THEN 'unknown' WHEN k % 10 >= 5 THEN 'over_threshold' ELSE 'lost_to_other' END AS why, count(*) AS n FROM d GROUP BY 1, 2""",
    "trail_positions": "SELECT event_id, least(32, row_number() OVER w) AS n, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 31 PRECEDING) AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "latency_groups": "SELECT event_type AS kind, count(*) AS n, round(median(value / 10), 6) AS median, round(quantile_cont(value / 10, 0.9), 6) AS p90, round(quantile_cont(value / 10, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "latency_warnings": """WITH w AS (SELECT 'probe_t0' AS warning, event_id % 9 = 0 AS bad FROM events UNION ALL SELECT 'negative_t0_t1', value < 5 FROM events UNION ALL SELECT 'negative_t1_t2', true FROM events
UNION ALL SELECT 'negative_t0_t2', value < 50 FROM events) SELECT warning, count(*) AS n FROM w WHERE bad GROUP BY 1""",
}
