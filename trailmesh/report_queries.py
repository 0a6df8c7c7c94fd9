"""Registered queries of contract rules and reports, with oracles written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh import identity_queries as I
from trailmesh.operators import contract, ground, reports, temporal
from trailmesh.plans import portable


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable.run(spark, sf_dir, f"WITH {portable.BOXES} SELECT frame, det, x, y, w, h FROM b").withColumns({"cam": F.lit("cam"), "frame_w": F.lit(640.0), "frame_h": F.lit(200.0)})


def foot_point_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame([("cam", 0.4, 15.0)], "cam string, a double, b double")
    return contract.learned_foot(_boxes(spark, sf_dir), models).select("frame", "det", F.round("foot_y", 6).alias("foot_y"))


def clean_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean boxes of every order; a line of an order is one box."""
    b = _boxes(spark, sf_dir).groupBy("frame", "det").agg(*[F.max(c).alias(c) for c in ("x", "y", "w", "h", "frame_w", "frame_h")])
    return contract.clean_flags(b, ["frame"], "det", 2.0, 0.3).select("frame", "det", "clean")


def transit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every two appearances of a user that follow each other."""
    text = f"WITH {portable.SESSIONS}, c AS (SELECT lid, cam, start_us, lag(cam) OVER (PARTITION BY lid ORDER BY end_us, cam, seq) AS src, lag(end_us) OVER (PARTITION BY lid ORDER BY end_us, cam, seq) AS left_us FROM s) SELECT lid, cam AS dst, src, start_us, (start_us - left_us) / 1000000 AS elapsed FROM c WHERE src IS NOT NULL"
    c = portable.run(spark, sf_dir, text)
    cams = c.agg(F.collect_set("dst").alias("all")).select(F.explode("all").alias("src"), "all")
    near = F.col("src").isin("click", "view") & F.col("dst").isin("click", "view")
    hops = cams.select("src", F.explode("all").alias("dst")).filter("src <> dst").withColumns({"least": F.lit(0.0), "most": F.when(near, 864_000.0).otherwise(432_000.0)})
    overlaps = spark.createDataFrame([("click", "view")], "a string, b string")
    v = contract.transit_verdicts(c, hops, overlaps, overdue=True)
    kind = F.when((F.col("verdict") == "overdue") & (F.col("elapsed") > 2_592_000), "too_late").otherwise(F.col("verdict"))
    return v.select("lid", F.col("dst").alias("cam"), "src", "start_us", kind.alias("verdict"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tracks of customers' regions, with a run that confuses some."""
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus AS cam", "o_orderkey AS local", "CASE WHEN o_custkey % 10 > 1 THEN o_custkey END AS person", "o_custkey * 2 + CASE WHEN length(o_orderpriority) > 6 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 0 END AS gid", "o_orderkey % 30 AS n_frames"
    )


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.pair_scores(_runs(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) if k == "double" else c for c, k in out.dtypes])


def id_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.id_decomposition(_runs(spark, sf_dir))


def point_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS frame", "l_linenumber % 4 AS gid", "CASE WHEN l_suppkey % 4 > 0 THEN l_partkey % 3 END AS person")
    return reports.point_classes(o).groupBy("class").agg(F.count("*").alias("n"))


def edge_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity at both ends of every part's orders."""
    f = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("track"), F.col("l_orderkey").alias("frame")).agg(F.max(F.expr("CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 4 END")).alias("gid"))
    first, last = (reports.edge_ids(f, ["track"], "frame", 5, tail).withColumnRenamed("gid", n) for tail, n in ((False, "first_gid"), (True, "last_gid")))
    return first.join(last, "track")


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame latencies of users between publications, as counts and sums."""
    r = _read(spark, sf_dir, "events").selectExpr("user_id AS tracklet", "CAST(unix_micros(cast(ts AS timestamp)) div 60000000 AS double) AS t0", "CAST(unix_micros(cast(ts AS timestamp)) div 60000000 + value AS double) AS t4")
    s = reports.frame_latency_samples(r, step_ms=1000.0)
    return s.groupBy("tracklet").agg(F.count("*").alias("n"), F.round(F.sum("latency"), 3).alias("total"), F.round(F.max("latency"), 6).alias("worst"))


def clock_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS cam", "CAST(l_orderkey % 997 AS double) AS p", "CAST(l_orderkey % 997 AS double) * 1.001 + l_quantity / 10 + 100 AS t")
    out = reports.clock_fits(s, ["cam"])
    return out.select("cam", *[F.round(c, 6).alias(c) for c in ("offset_s", "drift", "jitter_ms")], "n_samples", "n_bins")


def exit_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions in which users leave a source for the next one."""
    e = temporal.sessionize(I._events(spark, sf_dir), ["cam", "user_id"], "t", 5 * I.DAY_US, ["event_id"]).withColumns({"ms": F.expr("t div 1000"), "y": (F.col("event_id") % 97).cast("double")})
    v = ground.exit_velocity(e, ["cam", "user_id", "seq"], "ms", "value", "y", 432_000_000)
    s = e.groupBy("cam", "user_id", "seq").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    h = temporal.handovers(s, "user_id", "cam", "seq", "start", "end").filter("src <> dst")
    tid = lambda cam, seq: F.concat_ws(":", F.col("user_id").cast("string"), cam, seq)
    d = reports.fit_exit_directions(h.select(tid("src", "src_seq").alias("src_tid"), "src", "dst"), v.select(tid("cam", "seq").alias("tid"), "vx", "vy"), 1e-5, 3)
    return d.select("src", "dst", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), "n")


QUERIES = {f.__name__: f for f in (foot_point_learned, clean_boxes, transit_gate, pair_scores, id_balance, point_kinds, edge_identities, latency_samples, clock_envelopes, exit_directions)}
_RUNS = """r AS (SELECT o_orderstatus AS cam, o_orderkey AS local, CASE WHEN o_custkey % 10 > 1 THEN o_custkey END AS person, o_custkey * 2 + (length(o_orderpriority) > 6)::INT + CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 0 END AS gid, o_orderkey % 30 AS w FROM orders)"""
ORACLE_SQL = {
    "clean_boxes": """
WITH b AS (SELECT l_orderkey AS frame, l_linenumber::BIGINT AS det, max(l_quantity * 10) AS x, max(l_discount * 1000) AS y, max(40 + l_tax * 100) AS w, max(90 + l_linenumber * 5) AS h FROM lineitem GROUP BY ALL),
c AS (SELECT a.frame, a.det, max(greatest(0, least(a.x + a.w, o.x + o.w) - greatest(a.x, o.x)) * greatest(0, least(a.y + a.h, o.y + o.h) - greatest(a.y, o.y)) / (a.w * a.h)) AS s FROM b a JOIN b o ON a.frame = o.frame AND a.det <> o.det GROUP BY ALL)
SELECT frame, det, coalesce(s, 0) <= 0.3 AND least(x, y, 640 - x - w, 200 - y - h) >= 2 AS clean FROM b LEFT JOIN c USING (frame, det)""",
    "pair_scores": f"""
WITH {_RUNS}, k AS (SELECT * FROM r WHERE person IS NOT NULL),
a AS (SELECT count(*) AS held, count(*) FILTER (WHERE a.gid = b.gid) AS tp FROM k a JOIN k b ON a.person = b.person AND a.local < b.local AND a.cam <> b.cam),
f AS (SELECT count(*) AS found FROM k a JOIN k b ON a.gid = b.gid AND a.local < b.local AND a.cam <> b.cam),
p AS (SELECT count(*) AS n_identity, count(*) FILTER (WHERE n > 1) AS broken FROM (SELECT count(DISTINCT gid) AS n FROM k GROUP BY person)),
g AS (SELECT count(*) AS n_gid, count(*) FILTER (WHERE n > 1) AS merged FROM (SELECT count(DISTINCT person) AS n FROM k GROUP BY gid))
SELECT (SELECT count(*) FROM k) AS n_tracklet, n_identity, n_gid, broken, merged, round(tp / found, 9) AS precision, round(tp / held, 9) AS recall, round(2 * tp / (found + held), 9) AS f1 FROM a, f, p, g""",
    "id_balance": f"""
WITH {_RUNS}, c AS (SELECT DISTINCT gid, person FROM r WHERE person IS NOT NULL)
SELECT (SELECT count(DISTINCT gid) FROM r) AS n_ids, (SELECT count(DISTINCT gid) FROM r WHERE gid NOT IN (SELECT gid FROM c)) AS junk, (SELECT count(DISTINCT person) FROM c) AS covered,
       (SELECT count(*) - count(DISTINCT person) FROM c) AS surplus, (SELECT count(*) - count(DISTINCT gid) FROM c) AS merges, sum(w)::BIGINT AS frames, sum(w) FILTER (WHERE person IS NULL)::BIGINT AS frames_unknown FROM r""",
    "point_kinds": """
WITH o AS (SELECT l_orderkey AS frame, l_linenumber % 4 AS gid, CASE WHEN l_suppkey % 4 > 0 THEN l_partkey % 3 END AS person FROM lineitem),
s AS (SELECT frame, person, count(DISTINCT gid) AS ids FROM o WHERE person IS NOT NULL GROUP BY ALL),
p AS (SELECT o.frame, o.gid, count(DISTINCT o.person) AS k, count(*) - count(o.person) AS unknown, max(ids) AS ids FROM o LEFT JOIN s USING (frame, person) GROUP BY ALL)
SELECT CASE WHEN k = 0 THEN 'junk' WHEN k > 1 THEN 'mixed' WHEN unknown > 0 THEN 'partial' WHEN ids > 1 THEN 'split' ELSE 'solo' END AS class, count(*) AS n FROM p GROUP BY 1""",
    "edge_identities": """
WITH f AS (SELECT l_partkey AS track, l_orderkey AS frame, max(CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 4 END) AS gid FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame) AS a, row_number() OVER (PARTITION BY track ORDER BY frame DESC) AS b FROM f WHERE gid IS NOT NULL),
v AS (SELECT track, gid, count(*) FILTER (WHERE a <= 5) AS na, min(a) AS pa, count(*) FILTER (WHERE b <= 5) AS nb, min(b) AS pb FROM r GROUP BY ALL)
SELECT track, arg_max(gid, (na, -pa)) AS first_gid, arg_max(gid, (nb, -pb)) AS last_gid FROM v GROUP BY track""",
    "latency_samples": """
WITH r AS (SELECT user_id AS tracklet, (epoch_us(ts) // 60000000)::DOUBLE AS t0, epoch_us(ts) // 60000000 + value AS t4 FROM events),
p AS (SELECT *, lag(t0) OVER w AS a0, lag(t4) OVER w AS a4 FROM r WINDOW w AS (PARTITION BY tracklet ORDER BY t4, t0)),
g AS (SELECT quantile_cont(t4 - a4, 0.5) AS gap FROM p WHERE a4 IS NOT NULL),
q AS (SELECT tracklet, t4 - t0 AS d, least(1000.0::DOUBLE, greatest(gap / 10, 1.0::DOUBLE)) AS step, t0 - greatest(a0, t0 - 2.0::DOUBLE * gap) AS far FROM p, g WHERE a4 IS NOT NULL),
s AS (SELECT tracklet, d + unnest(range(0, greatest(ceil(far / step), 0)::BIGINT)) * step AS l FROM q)
SELECT tracklet, count(*) AS n, round(sum(l), 3) AS total, round(max(l), 6) AS worst FROM s GROUP BY tracklet""",
    "clock_envelopes": """
WITH s AS (SELECT l_suppkey AS cam, (l_orderkey % 997)::DOUBLE AS p, (l_orderkey % 997)::DOUBLE * 1.001::DOUBLE + l_quantity / 10 + 100 - (l_orderkey % 997)::DOUBLE AS d FROM lineitem WHERE l_orderkey % 997 >= 2),
b AS (SELECT cam, floor(p / 5) AS bin, arg_min(p, (d, p)) AS p, min(d) AS d FROM s GROUP BY ALL),
f AS (SELECT cam, regr_slope(d, p) AS drift, avg(d) - regr_slope(d, p) * avg(p) AS o, count(*) AS n_bins FROM b GROUP BY cam),
j AS (SELECT s.cam, 1000 * (d - o - drift * p) AS j, row_number() OVER (PARTITION BY s.cam ORDER BY 1000 * (d - o - drift * p)) AS k, count(*) OVER (PARTITION BY s.cam) AS n FROM s JOIN f USING (cam))
SELECT cam, round(o, 6) AS offset_s, round(drift, 6) AS drift, round(j, 6) AS jitter_ms, n AS n_samples, n_bins FROM j JOIN f USING (cam) WHERE k = n // 2 + 1""",
}
