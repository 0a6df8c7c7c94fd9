"""Registered queries of shapes, tracking scores, separability and lags, with oracles written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh import identity_queries as I
from trailmesh.operators import separability, shapes, signals
from trailmesh.operators import tracking_scores as T
from trailmesh.operators.spread import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground that each of as many cameras as parts can see."""
    k = lambda m: F.col("p_partkey") % m
    h = [0.01 + k(50) / 5000.0, 0.001 * k(7), F.lit(-2.0), 0.0005 * k(5), F.lit(0.012), F.lit(-1.0), F.lit(0.0), 0.0004 * k(9), F.lit(0.5)]
    cams = _read(spark, sf_dir, "part").select("p_partkey", F.array(*[c.cast("double") for c in h]).alias("matrix"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    out = shapes.footprints(cams, metres_per_pixel=0.04, reach_m=6.0)
    return out.select("p_partkey", F.round("cut", 6).alias("cut"), F.size("polygon").cast("bigint").alias("n_points"), F.round(shapes.area(F.col("polygon")), 6).alias("area"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts in the videos of suppliers, in order of their orders."""
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("video"), F.col("l_partkey").alias("track"), F.col("l_orderkey").alias("frame")).agg(
        F.max("l_quantity").alias("x1"), F.max(F.col("l_discount") * 1000).alias("y1"), F.max(F.col("l_linenumber") * 20).cast("double").alias("foot")
    )


def cleaned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.cleaned_tracks(_tracks(spark, sf_dir), "track", "frame", "foot", 2, 40.0, ["video"]).select("video", "track", "frame")


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes of every part's track over all its orders, in stretches without a gap over 2000."""
    lines = _read(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_partkey").alias("track"), F.col("l_orderkey").alias("frame"), "l_quantity", "l_discount", "l_linenumber")
    t = spread(rows, ["track"], lines).groupBy("track", "frame").agg(
        F.max("l_quantity").alias("x1"), F.max(F.col("l_discount") * 1000).alias("y1"), F.max(F.col("l_linenumber") * 20).cast("double").alias("foot")
    )
    boxes = t.select("track", "frame", "x1", "y1", (F.col("x1") + 60).alias("x2"), (F.col("y1") + 150 + F.col("foot")).alias("y2"))
    return shapes.keyframes(boxes, ["track"], "frame", 2000, 1 << 40, 0.6)


def box_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS frame", "CAST(l_linenumber AS BIGINT) * 100000 + l_partkey AS det", "l_quantity * 10 AS x", "l_discount * 1000 AS y", "40 + l_tax * 100 AS w", "90 + l_linenumber * 5 AS h", "l_tax AS score"
    )
    return shapes.box_clusters(b, ["frame"], "det", "score", 0.3, 3).select("frame", "det", F.col("place").cast("bigint").alias("place"))


def _truth_and_found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as people: a tracker that shifts boxes, misses line 4 and renames people halfway through a sequence."""
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    rows = rows.selectExpr("l_orderkey div 200 AS seq", "l_orderkey AS frame", "CAST(l_linenumber AS BIGINT) AS id", "q * 6 AS x", "d * 900 AS y", "60.0D AS w", "120.0D AS h", "t")
    late = F.col("frame") % 200 >= 100
    found = rows.filter("id <> 4").withColumn("x", F.col("x") + F.col("t") * 200).withColumn("id", F.col("id") + F.when(late, 10).otherwise(0))
    return rows.drop("t"), found.drop("t")


def hota_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hota(*_truth_and_found(spark, sf_dir), _read(spark, sf_dir, "lineitem")).select("seq", "alpha", "tp", "fn", "fp", *[F.round(c, 9).alias(c) for c in ("ass_a", "det_a", "hota")])


def identity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.identity_f1(*_truth_and_found(spark, sf_dir)).withColumn("idf1", F.round("idf1", 9))


def virtual_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("cam"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("bigint").alias("det"))
    return spread(T.virtual_frames(rows), ["virtual"], rows).groupBy("cam", "virtual").agg(F.count("*").alias("n"))


def rank_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of all sessions of a site; each has the vector of its number."""
    s = I._sessions(spark, sf_dir).drop("vec")
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").cast("array<double>").alias("vec"))
    s = s.join(F.broadcast(e.agg((F.max("_v") + 1).alias("_n")))).withColumn("_v", F.expr("tid % _n")).join(e, "_v")
    found = separability.nearest(s.withColumnRenamed("site", "session").withColumnRenamed("user_id", "person"))
    found = found.withColumns({c: F.round(c, 6) for c in ("right", "wrong")})  # equal vectors tie
    return separability.rank_one(found, 0.7).select("mode", "n", *[F.round(c, 9).alias(c) for c in ("rank1", "chance", "hard", "right_below", "wrong_below")])


def recording_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of the hourly activity of each source against clicks, by site, over up to two days."""
    e = _read(spark, sf_dir, "events").select(F.floor(F.col("user_id") / I.SITE).alias("site"), F.col("event_type").alias("cam"), F.expr("unix_micros(cast(ts AS timestamp)) div 3600000000").alias("hour"))
    span = e.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))  # one row
    counts = e.groupBy("site", "cam", "hour").agg(F.count("*").cast("double").alias("n")).groupBy("site", "cam").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("m"))
    samples = F.transform(F.sequence("a", "b"), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0)))
    lags = signals.recording_lags(counts.join(F.broadcast(span)).select(F.col("site").alias("session"), "cam", samples.alias("samples")), "click", 1.0, 1.0, 3.0, 48.0, 2.0)
    return lags.select("session", "cam", "lag_s", F.round("peak", 6).alias("peak"), "duration_s")


QUERIES = {f.__name__: f for f in (footprints, cleaned_tracks, keyframes, box_clusters, hota_scores, identity_scores, virtual_frames, rank_one, recording_lags)}

_CLIP = """
{out}n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM {src} WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{out}d AS (SELECT *, {a} * x + {b} * y + 6.0 AS s, {a} * nx + {b} * ny + 6.0 AS t FROM {out}n),
{out}a AS (SELECT id, i * 2 AS i, x, y FROM {out}d WHERE s >= 0 UNION ALL SELECT id, i * 2 + 1, x + s / (s - t) * (nx - x), y + s / (s - t) * (ny - y) FROM {out}d WHERE (s >= 0) <> (t >= 0)),
{out} AS (SELECT * FROM {out}a QUALIFY count(*) OVER (PARTITION BY id) >= 3),"""
_CLIPS = "".join(_CLIP.format(out=f"p{k + 1}", src=f"p{k}", a=a, b=b) for k, (a, b) in enumerate(((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0))))
ORACLE_SQL = {
    "footprints": f"""
WITH c AS (SELECT p_partkey AS id, 0.01::DOUBLE + (p_partkey % 50) / 5000.0::DOUBLE AS a, 0.001::DOUBLE * (p_partkey % 7) AS b, 0.0005::DOUBLE * (p_partkey % 5) AS d, 0.0004::DOUBLE * (p_partkey % 9) AS g FROM part),
r AS (SELECT *, unnest(range(0, 201)) AS i FROM c),
v AS (SELECT *, 480 - i * 2.4::DOUBLE AS v FROM r),
q AS (SELECT *, (a * 320 + b * v - 2) / (g * v + 0.5) AS x1, (d * 320 + 0.012 * v - 1) / (g * v + 0.5) AS y1, (a * 320 + b * (v - 1) - 2) / (g * (v - 1) + 0.5) AS x0, (d * 320 + 0.012 * (v - 1) - 1) / (g * (v - 1) + 0.5) AS y0 FROM v),
k AS (SELECT id, coalesce(min(i) FILTER (WHERE sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) > 0.04), 201) - 1 AS last FROM q GROUP BY id),
u AS (SELECT c.*, CASE WHEN last >= 0 THEN 480 - last * 2.4::DOUBLE END AS cut FROM c JOIN k USING (id)),
p0 AS (SELECT id, i, (a * px + b * py - 2) / (g * py + 0.5) AS x, (d * px + 0.012 * py - 1) / (g * py + 0.5) AS y
       FROM (SELECT *, unnest([0, 1, 2, 3]) AS i, unnest([0.0, 640.0, 640.0, 0.0])::DOUBLE AS px, unnest([cut, cut, 480.0, 480.0])::DOUBLE AS py FROM u WHERE cut IS NOT NULL)),{_CLIPS}
z AS (SELECT id, x * coalesce(lead(y) OVER w, first(y) OVER w) - coalesce(lead(x) OVER w, first(x) OVER w) * y AS s FROM p4 WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT id, count(*) AS n, abs(sum(s)) / 2 AS area FROM z GROUP BY id)
SELECT u.id AS p_partkey, round(cut, 6) AS cut, coalesce(n, 0) AS n_points, round(coalesce(area, 0), 6) AS area FROM u LEFT JOIN m USING (id)""",
    "cleaned_tracks": """
WITH t AS (SELECT l_suppkey AS video, l_partkey AS track, l_orderkey AS frame, max(l_linenumber * 20) AS foot FROM lineitem GROUP BY ALL),
k AS (SELECT * FROM t WHERE foot >= 40 QUALIFY count(*) OVER (PARTITION BY video, track) >= 2),
r AS (SELECT video, track, row_number() OVER (PARTITION BY video ORDER BY min(frame), track) - 1 AS number FROM k GROUP BY video, track)
SELECT video, number AS track, frame FROM k JOIN r USING (video, track)""",
    "box_clusters": """
WITH RECURSIVE o AS (SELECT l_orderkey AS frame, l_linenumber::BIGINT * 100000 + l_partkey AS det, l_quantity * 10 AS x, l_discount * 1000 AS y, 40 + l_tax * 100 AS w, 90.0::DOUBLE + l_linenumber * 5 AS h,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC, l_linenumber::BIGINT * 100000 + l_partkey, l_quantity, l_discount) AS rn FROM lineitem),
s AS (SELECT DISTINCT frame, 0::BIGINT AS rn, []::STRUCT(det BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS kept FROM o
UNION ALL SELECT o.frame, o.rn, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: greatest(0, least(o.x + o.w, k.x + k.w) - greatest(o.x, k.x)) * greatest(0, least(o.y + o.h, k.y + k.h) - greatest(o.y, k.y))
      / (o.w * o.h + k.w * k.h - greatest(0, least(o.x + o.w, k.x + k.w) - greatest(o.x, k.x)) * greatest(0, least(o.y + o.h, k.y + k.h) - greatest(o.y, k.y))) >= 0.3)) = 0
      THEN list_append(kept, {'det': o.det, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}) ELSE kept END FROM s JOIN o ON o.frame = s.frame AND o.rn = s.rn + 1),
l AS (SELECT frame, arg_max(kept, rn) AS kept FROM s GROUP BY frame)
SELECT frame, unnest(kept).det AS det, generate_subscripts(kept, 1)::BIGINT - 1 AS place FROM l""",
    "virtual_frames": """
WITH r AS (SELECT l_returnflag || l_linestatus AS cam, l_orderkey AS frame FROM lineitem),
o AS (SELECT min(b) AS b FROM (SELECT unnest([1000, 10000, 100000, 1000000, 10000000, 100000000, 1000000000, 10000000000]) AS b) WHERE b > (SELECT max(frame) + 1 FROM r)),
c AS (SELECT cam, row_number() OVER (ORDER BY cam) - 1 AS i FROM (SELECT DISTINCT cam FROM r))
SELECT cam, (i * b + frame + 1)::BIGINT AS virtual, count(*) AS n FROM r JOIN c USING (cam) CROSS JOIN o GROUP BY ALL""",
    "rank_one": f"""
WITH {I._SESSIONS_SQL},
t AS (SELECT s.*, embedding::DOUBLE[] AS z FROM s JOIN embeddings ON vec_id = tid % (SELECT max(vec_id) + 1 FROM embeddings)),
p AS (SELECT q.tid, CASE WHEN q.cam <> g.cam THEN 'cross' ELSE 'same_camera' END AS mode, q.user_id = g.user_id AS ok, round(1 - list_dot_product(q.z, g.z), 6) AS d
      FROM t q, t g WHERE q.site = g.site AND q.tid <> g.tid AND (q.cam <> g.cam OR g.b < q.a OR g.a > q.b)),
m AS (SELECT tid, mode, count(*) FILTER (WHERE ok) AS nr, count(*) FILTER (WHERE NOT ok) AS nw, min(d) FILTER (WHERE ok) AS r, min(d) FILTER (WHERE NOT ok) AS w FROM p GROUP BY ALL HAVING count(*) FILTER (WHERE ok) > 0)
SELECT mode, count(*) AS n, round(avg((coalesce(r <= w, true))::INT), 9) AS rank1, round(avg(nr / (nr + nw)), 9) AS chance, round(avg((w < r)::INT), 9) AS hard, round(avg((r < 0.7)::INT), 9) AS right_below, round(avg((w < 0.7)::INT), 9) AS wrong_below FROM m GROUP BY mode""",
    "recording_lags": f"""
WITH e AS (SELECT user_id // {I.SITE} AS site, event_type AS cam, epoch_us(ts) // 3600000000 AS h FROM events),
b AS (SELECT min(h) AS a, max(h) AS b FROM e), k AS (SELECT DISTINCT site, cam FROM e), t AS (SELECT unnest(range(a, b + 1)) AS h, a, b FROM b),
c AS (SELECT site, cam, h, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT site, cam, h - a AS i, b - a + 1 AS len, coalesce(n, 0)::DOUBLE AS n FROM k CROSS JOIN t LEFT JOIN c USING (site, cam, h)),
w AS (SELECT site, cam, i, len, log10(sum(n * n) OVER (PARTITION BY site, cam ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) / 3 + 1e-10) AS v FROM g),
o AS (SELECT site, cam, i, len, greatest(coalesce(v - lag(v) OVER (PARTITION BY site, cam ORDER BY i), 0), 0) AS v FROM w WHERE i <= len - 3),
m AS (SELECT *, v - avg(v) OVER (PARTITION BY site, cam) AS z FROM o),
u AS (SELECT *, CASE WHEN sum(z * z) OVER (PARTITION BY site, cam) > 0 THEN z / sqrt(sum(z * z) OVER (PARTITION BY site, cam)) ELSE z END AS y FROM m),
x AS (SELECT r.site, q.cam, q.i - r.i AS lag, sum(r.y * q.y) AS s FROM u r JOIN u q ON r.site = q.site AND r.cam = 'click' AND q.i - r.i BETWEEN -48 AND 48 GROUP BY ALL)
SELECT site AS session, cam, arg_max(lag, s)::DOUBLE AS lag_s, round(max(s), 6) AS peak, (SELECT b - a + 1 FROM b)::DOUBLE AS duration_s FROM x GROUP BY site, cam""",
}
