"""Analytic queries as plain SQL.

The texts are planned by Catalyst here; the same text, with ``US(column)`` (epoch
microseconds) spelt for the other engine, is its oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events embeddings labels documents".split()


def spark_sql(text: str) -> str:
    return re.sub(r"US\(([\w.]+)\)", r"unix_micros(cast(\1 AS timestamp))", text)


def duck_sql(text: str) -> str:
    return re.sub(r"US\(([\w.]+)\)", r"epoch_us(\1)", text)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(spark_sql(text))


#: Tracklets: events of one source (event_type) and local id (user_id) without a gap over a day.
SESSIONS = """
e0 AS (SELECT event_type AS cam, user_id AS lid, event_id AS eid, US(ts) AS t, value FROM events),
e1 AS (SELECT *, lag(t) OVER (PARTITION BY cam, lid ORDER BY t, eid) AS before FROM e0),
e2 AS (SELECT *, sum(CASE WHEN t - before > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY cam, lid ORDER BY t, eid ROWS UNBOUNDED PRECEDING) AS seq FROM e1),
s AS (SELECT cam, lid, cast(seq AS bigint) AS seq, min(t) AS start_us, max(t) AS end_us, count(*) AS n_frames, min_by(value, eid) AS first_value, avg(value) AS mean_value
      FROM e2 GROUP BY cam, lid, seq)
"""
#: Boxes of frames (orders): x, y, w, h in pixels of a 640 x 200 frame.
BOXES = """
b AS (SELECT l_orderkey AS frame, cast(l_linenumber AS bigint) AS det, l_quantity * 10 AS x, l_discount * 1000 AS y, 40 + l_tax * 100 AS w, 90 + l_linenumber * 5 AS h, l_tax * 10 AS conf FROM lineitem)
"""
#: Appearances for hand-overs: identity = user, source = event type.
PAIRS = "overlaps AS (SELECT 'click' AS p, 'view' AS q UNION ALL SELECT 'view', 'click')"
LATENCY = """
r0 AS (SELECT event_id AS eid, event_type AS kind, user_id AS run, US(ts) / 1000000.0 AS t0, value FROM events),
r AS (SELECT eid, kind, run, t0, t0 + value / 100 AS t1, t0 + value / 50 AS t2, t0 + value / 20 AS t3, t0 + value / 10 AS t4 FROM r0)
"""
SCORED = "d AS (SELECT labels.doc_id, cast(n_chars AS double) AS score, toxic AS y, lang FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"
CELLS = "c AS (SELECT o_custkey AS person, o_orderkey % 97 AS gid, o_orderpriority AS reason, o_totalprice AS mass, o_orderkey AS k FROM orders)"

QUERIES: dict[str, str] = {
    # projections and predicates
    "frame_validate": f"WITH {BOXES} SELECT frame, det, concat_ws(',', CASE WHEN w <= 0 OR h <= 0 THEN 'box_side' END, CASE WHEN x < -0.02 * 640 OR x + w > 1.02 * 640 THEN 'overflow_x' END, CASE WHEN y < -0.02 * 200 OR y + h > 1.02 * 200 THEN 'overflow_y' END, CASE WHEN conf < 0 OR conf > 1 THEN 'confidence' END) AS issues FROM b",
    "duplicate_ids": f"WITH {BOXES} SELECT frame, count(*) AS n, count(DISTINCT cast(x AS bigint)) AS n_ids FROM b GROUP BY frame HAVING count(DISTINCT cast(x AS bigint)) < count(*)",
    "foot_point": f"WITH {BOXES} SELECT frame, det, x + w / 2 AS gx, y + h AS gy FROM b",
    "foot_point_learned": f"WITH {BOXES} SELECT frame, det, round(CASE WHEN y + h >= 200 - 20 THEN greatest(y + h, (y + 15.0) / (1 - 0.4)) ELSE y + h END, 6) AS foot_y FROM b",
    "ground_project": f"WITH {BOXES}, p AS (SELECT frame, det, x + w / 2 AS u, y + h AS v FROM b), q AS (SELECT frame, det, 0.02 * u - 0.001 * v - 3 AS a, 0.0005 * u + 0.03 * v - 9 AS c, 0.0001 * u + 0.0002 * v + 1 AS d FROM p) SELECT frame, det, round(CASE WHEN abs(d) >= 1e-9 THEN a / d END, 6) AS gx, round(CASE WHEN abs(d) >= 1e-9 THEN c / d END, 6) AS gy FROM q",
    "roi_filter": f"WITH {BOXES} SELECT frame, count(*) AS n_total, cast(sum(CASE WHEN x + w / 2 >= 100 AND x + w / 2 < 400 AND y + h >= 120 AND y + h < 190 THEN 1 ELSE 0 END) AS bigint) AS n_kept FROM b GROUP BY frame",
    "annotated_area": f"WITH {BOXES} SELECT frame, det FROM b WHERE x / 20 - 3 >= -3 AND x / 20 - 3 < 9 AND y / 4 - 9 >= -9 AND y / 4 - 9 < 27",
    "clip_boxes": f"WITH {BOXES}, k AS (SELECT frame, det, greatest(x, 0.0) AS x1, greatest(y, 0.0) AS y1, least(x + w, 500.0) AS x2, least(y + h, 180.0) AS y2 FROM b) SELECT frame, det, CASE WHEN x2 - x1 > 1 AND y2 - y1 > 1 THEN round((x2 - x1) * (y2 - y1), 6) END AS area FROM k",
    "rescale_boxes": f"WITH {BOXES} SELECT frame, det, round(x * 1920 / 640, 6) AS x, round(y * 1080 / 200, 6) AS y, round(w * 1920 / 640, 6) AS w, round(h * 1080 / 200, 6) AS h FROM b",
    "confidence_filter": f"WITH {BOXES} SELECT frame, det, conf FROM b WHERE conf < 0 OR conf >= 0.5",
    "iou_pairs": f"WITH {BOXES}, p AS (SELECT a.frame, a.det AS det_a, b2.det AS det_b, greatest(0.0, least(a.x + a.w, b2.x + b2.w) - greatest(a.x, b2.x)) * greatest(0.0, least(a.y + a.h, b2.y + b2.h) - greatest(a.y, b2.y)) AS inter, a.w * a.h + b2.w * b2.h AS areas FROM b a JOIN b b2 ON a.frame = b2.frame AND a.det < b2.det) SELECT frame, det_a, det_b, round(inter / (areas - inter), 6) AS iou FROM p WHERE inter > 0",
    "clean_flag": f"WITH {BOXES}, p AS (SELECT a.frame, a.det, max(CASE WHEN b2.det IS NULL THEN 0.0 ELSE greatest(0.0, least(a.x + a.w, b2.x + b2.w) - greatest(a.x, b2.x)) * greatest(0.0, least(a.y + a.h, b2.y + b2.h) - greatest(a.y, b2.y)) / (a.w * a.h) END) AS covered, min(least(a.x, a.y, 640 - a.x - a.w, 200 - a.y - a.h)) AS edge FROM b a LEFT JOIN b b2 ON a.frame = b2.frame AND a.det <> b2.det GROUP BY a.frame, a.det) SELECT frame, det, covered <= 0.3 AND edge >= 2 AS clean FROM p",
    "transit_gate": f"WITH {SESSIONS}, c AS (SELECT lid, cam, start_us, lag(cam) OVER (PARTITION BY lid ORDER BY end_us, cam, seq) AS src, lag(end_us) OVER (PARTITION BY lid ORDER BY end_us, cam, seq) AS left_us FROM s), g AS (SELECT lid, cam, src, start_us, (start_us - left_us) / 1000000 AS elapsed FROM c WHERE src IS NOT NULL) SELECT lid, cam, src, start_us, CASE WHEN cam = src THEN 'same' WHEN cam IN ('click', 'view') AND src IN ('click', 'view') THEN CASE WHEN abs(elapsed) <= 864000 THEN 'overlap' ELSE 'too_late' END WHEN elapsed < 0 THEN 'too_early' WHEN elapsed <= 432000 THEN 'ok' WHEN elapsed <= 2592000 THEN 'overdue' ELSE 'too_late' END AS verdict FROM g",
    # store, ordering, set operations
    "tracklet_rollup": f"WITH {SESSIONS} SELECT cam, lid, seq, start_us, end_us, n_frames, first_value, round(mean_value, 6) AS mean_value FROM s WHERE n_frames >= 2",
    "appearance_upsert": "WITH a AS (SELECT user_id AS tracklet, event_type AS reason, event_id, value, US(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT tracklet, max(CASE WHEN rn = 1 THEN reason END) AS reason, max(CASE WHEN rn = 1 THEN value END) AS cost, min(t) AS start_us, max(t) AS end_us, max(CASE WHEN rn = n THEN event_id END) AS last_id, max(n) AS n_frames FROM a GROUP BY tracklet",
    "global_rollup": f"WITH {SESSIONS} SELECT lid AS gid, min(start_us) AS created, max(end_us) AS last_seen, max_by(cam, end_us) AS last_cam, count(*) AS n_tracklets, count(DISTINCT cam) AS n_cameras FROM s GROUP BY lid",
    "store_summary": f"WITH {SESSIONS} SELECT count(*) AS n_appearances, count(DISTINCT lid) AS n_tracks, count(DISTINCT cam) AS n_cameras, cast(sum(n_frames) AS bigint) AS n_frames FROM s",
    "trajectory": f"WITH {SESSIONS} SELECT lid, cam, start_us, end_us, cast(row_number() OVER (PARTITION BY lid ORDER BY start_us, end_us, cam, seq) AS bigint) AS step FROM s",
    "appearances_between": f"WITH {SESSIONS}, m AS (SELECT min(start_us) + 864000000000 AS lo, min(start_us) + 1728000000000 AS hi FROM s) SELECT cam, lid, seq, start_us, end_us FROM s CROSS JOIN m WHERE end_us >= lo AND start_us <= hi",
    "active_tracks": f"WITH {SESSIONS}, g AS (SELECT lid, max(end_us) AS last_seen FROM s GROUP BY lid), m AS (SELECT max(end_us) - 864000000000 AS since FROM s) SELECT lid, last_seen FROM g CROSS JOIN m WHERE last_seen >= since",
    "ttl_closed": f"WITH {SESSIONS}, g AS (SELECT lid, max(end_us) AS last_seen FROM s GROUP BY lid), m AS (SELECT max(end_us) AS now_us FROM s) SELECT lid, now_us - last_seen > 120000000 AS closed FROM g CROSS JOIN m",
    "union_last_wins": f"WITH {SESSIONS}, u AS (SELECT lid, cam, end_us, 1 AS src FROM s UNION ALL SELECT lid, cam, end_us + 1, 2 FROM s WHERE n_frames > 1), k AS (SELECT *, row_number() OVER (PARTITION BY lid, cam ORDER BY src DESC, end_us DESC) AS rn FROM u) SELECT lid, cam, end_us, src FROM k WHERE rn = 1",
    "camera_set_difference": "SELECT DISTINCT event_type AS cam, user_id AS lid FROM events WHERE value > 50 EXCEPT SELECT event_type, user_id FROM events WHERE value > 400",
    "split_leakage": "SELECT doc_id FROM labels WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM labels WHERE doc_id % 2 = 0",
    "slowest_records": f"WITH {LATENCY} SELECT eid, round(t4 - t0, 6) AS e2e FROM r ORDER BY t4 - t0 DESC, eid LIMIT 20",
    "mot_export": f"WITH {SESSIONS} SELECT cast(dense_rank() OVER (ORDER BY cam) - 1 AS bigint) * 100000 + seq + 1 AS frame, lid AS track, cam FROM s",
    "identity_numbering": "SELECT DISTINCT event_type AS name, cast(dense_rank() OVER (ORDER BY event_type) AS bigint) AS id FROM events",
    # joins
    "interval_lookup": f"WITH {SESSIONS}, h AS (SELECT e0.eid, s.seq, row_number() OVER (PARTITION BY e0.eid ORDER BY s.start_us, s.seq) AS rn FROM e0 JOIN s ON e0.cam = s.cam AND e0.lid = s.lid AND e0.t BETWEEN s.start_us AND s.end_us) SELECT eid, seq FROM h WHERE rn = 1",
    "exclusion_overlap": f"WITH {SESSIONS} SELECT cam, lid, seq FROM s a WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.cam = a.cam AND o.lid % 50 = a.lid % 50 AND o.lid <> a.lid AND o.start_us <= a.end_us AND a.start_us <= o.end_us)",
    "handovers": f"WITH {SESSIONS}, c AS (SELECT d.lid, d.cam AS dst, d.seq AS dst_seq, d.start_us, a.cam AS src, a.seq AS src_seq, a.end_us, row_number() OVER (PARTITION BY d.lid, d.cam, d.seq ORDER BY least(a.end_us, d.start_us) DESC, a.end_us DESC, a.cam, a.seq) AS rn FROM s d JOIN s a ON a.lid = d.lid AND (a.start_us < d.start_us OR a.start_us = d.start_us AND a.cam < d.cam)) SELECT lid, src, src_seq, dst, dst_seq, start_us - end_us AS gap_us FROM c WHERE rn = 1",
    "handover_tally": f"WITH {SESSIONS}, c AS (SELECT d.lid, d.cam AS dst, d.start_us, a.cam AS src, a.end_us, row_number() OVER (PARTITION BY d.lid, d.cam, d.seq ORDER BY least(a.end_us, d.start_us) DESC, a.end_us DESC, a.cam, a.seq) AS rn FROM s d JOIN s a ON a.lid = d.lid AND a.start_us < d.start_us), t AS (SELECT src, dst, CASE WHEN src = dst THEN 'same_camera' WHEN src IN ('click', 'view') AND dst IN ('click', 'view') THEN 'overlap' ELSE 'non_overlap' END AS kind FROM c WHERE rn = 1) SELECT src, dst, kind, count(*) AS n FROM t GROUP BY GROUPING SETS ((), (kind), (src, dst))",
    "transit_stats": f"WITH {SESSIONS}, c AS (SELECT d.cam AS dst, d.start_us - a.end_us AS gap, a.cam AS src, row_number() OVER (PARTITION BY d.lid, d.cam, d.seq ORDER BY least(a.end_us, d.start_us) DESC, a.end_us DESC, a.cam, a.seq) AS rn FROM s d JOIN s a ON a.lid = d.lid AND a.start_us < d.start_us) SELECT src, dst, count(*) AS n, min(gap) AS min_us, max(gap) AS max_us, round(median(gap), 3) AS median_us, cast(sum(CASE WHEN gap < 0 THEN 1 ELSE 0 END) AS bigint) AS n_negative FROM c WHERE rn = 1 AND src <> dst GROUP BY src, dst",
    "clashing_spans": f"WITH {SESSIONS} SELECT a.cam, a.lid % 40 AS gid, a.seq, a.lid, count(*) AS n FROM s a JOIN s b ON a.cam = b.cam AND a.lid % 40 = b.lid % 40 AND a.lid <> b.lid AND a.start_us <= b.end_us AND b.start_us <= a.end_us GROUP BY a.cam, a.lid % 40, a.seq, a.lid",
    "reference_join": "SELECT a.l_orderkey AS frame, a.l_linenumber AS det, round(a.l_extendedprice - b.l_extendedprice, 6) AS dx FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1",
    # aggregations
    "majority_vote": "WITH v AS (SELECT l_partkey AS track, l_suppkey AS person, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY l_partkey, l_suppkey), k AS (SELECT *, sum(n) OVER (PARTITION BY track) AS total, row_number() OVER (PARTITION BY track ORDER BY n DESC, first_seen) AS rn FROM v) SELECT track, person, n, round(n / total, 6) AS purity FROM k WHERE rn = 1",
    "duration_majority": f"WITH {SESSIONS}, v AS (SELECT lid % 60 AS gid, lid AS person, sum(greatest(1, end_us - start_us)) AS dur FROM s GROUP BY lid % 60, lid), k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY dur DESC, person) AS rn FROM v) SELECT gid, person, cast(dur AS bigint) AS dur FROM k WHERE rn = 1",
    "pairwise_f1": f"WITH {CELLS}, g AS (SELECT person, gid, count(*) AS n FROM c GROUP BY person, gid), t AS (SELECT sum(n * (n - 1) / 2) AS tp FROM g), p AS (SELECT sum(n * (n - 1) / 2) AS pos FROM (SELECT gid, sum(n) AS n FROM g GROUP BY gid) q), r AS (SELECT sum(n * (n - 1) / 2) AS truth FROM (SELECT person, sum(n) AS n FROM g GROUP BY person) q) SELECT round(coalesce(tp / nullif(pos, 0), 1.0), 9) AS pair_precision, round(coalesce(tp / nullif(truth, 0), 1.0), 9) AS pair_recall FROM t CROSS JOIN p CROSS JOIN r",
    "id_decomposition": f"WITH {CELLS}, m AS (SELECT gid, person, count(*) AS n FROM c GROUP BY gid, person) SELECT count(DISTINCT gid) AS n_ids, count(DISTINCT person) AS covered, count(*) - count(DISTINCT person) AS surplus, count(*) - count(DISTINCT gid) AS merges FROM m",
    "fragmentation": f"WITH {CELLS}, f AS (SELECT person, count(DISTINCT gid) AS k FROM c GROUP BY person), h AS (SELECT k, count(*) AS n FROM f GROUP BY k) SELECT k, n, round(100 * cast(sum(n) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS double) / sum(n) OVER (), 6) AS cumulative FROM h",
    "surplus_mass": f"WITH {CELLS}, f AS (SELECT person, gid, count(*) AS n FROM c GROUP BY person, gid), k AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, gid) AS rn FROM f) SELECT person, cast(sum(CASE WHEN rn = 1 THEN n ELSE 0 END) AS bigint) AS main, cast(sum(CASE WHEN rn > 1 THEN n ELSE 0 END) AS bigint) AS surplus FROM k GROUP BY person",
    "merge_mass": f"WITH {CELLS}, f AS (SELECT gid, person, count(*) AS n FROM c GROUP BY gid, person) SELECT gid, count(*) AS persons, cast(sum(n) - max(n) AS bigint) AS minority FROM f GROUP BY gid HAVING count(*) > 1",
    "birth_reason": f"WITH {CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY CASE WHEN reason = '5-LOW' THEN 1 ELSE 0 END, k) AS rn FROM c) SELECT reason, count(*) AS n FROM k WHERE rn = 1 GROUP BY reason",
    "percentile_linear": f"WITH {LATENCY} SELECT kind, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY t4 - t0), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY t4 - t0), 6) AS p95 FROM r GROUP BY kind",
    "percentile_nearest": f"WITH {LATENCY}, k AS (SELECT kind, t4 - t0 AS v, row_number() OVER (PARTITION BY kind ORDER BY t4 - t0, eid) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM r) SELECT kind, round(max(CASE WHEN rn = ceil(0.95 * n) THEN v END), 6) AS p95 FROM k GROUP BY kind",
    "stats_bundle": f"WITH {LATENCY} SELECT kind, count(*) AS n, round(median(t2 - t0), 6) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY t2 - t0), 6) AS p90, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY t2 - t0), 6) AS p99, round(avg(t2 - t0), 5) AS mean, round(min(t2 - t0), 6) AS lo, round(max(t2 - t0), 6) AS hi, cast(sum(CASE WHEN t2 - t0 < -0.001 THEN 1 ELSE 0 END) AS bigint) AS n_negative FROM r GROUP BY kind",
    "latency_segments": f"WITH {LATENCY}, g AS (SELECT 'a01' AS seg, t1 - t0 AS v FROM r UNION ALL SELECT 'a12', t2 - t1 FROM r UNION ALL SELECT 'a23', t3 - t2 FROM r UNION ALL SELECT 'a34', t4 - t3 FROM r UNION ALL SELECT 'a04', t4 - t0 FROM r) SELECT seg, count(*) AS n, round(median(v), 6) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY v), 6) AS p90 FROM g GROUP BY seg",
    "latency_tail": f"WITH {LATENCY}, q AS (SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY t4 - t0) AS p FROM r), a AS (SELECT median(t1 - t0) AS m1, median(t4 - t3) AS m4 FROM r), b AS (SELECT median(t1 - t0) AS m1, median(t4 - t3) AS m4, count(*) AS n FROM r CROSS JOIN q WHERE t4 - t0 >= p) SELECT round(b.m1 - a.m1, 6) AS d01, round(b.m4 - a.m4, 6) AS d34, n FROM a CROSS JOIN b",
    "target_verdict": f"WITH {LATENCY}, q AS (SELECT percentile_cont(0.95) WITHIN GROUP (ORDER BY t4 - t0) AS p95, max(t4 - t0) AS worst FROM r) SELECT round(p95, 6) AS p95, round(worst, 6) AS worst, p95 < 1 AS pass FROM q",
    "record_kinds": "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'first' ELSE 'repeat' END AS kind FROM events",
    "time_to_identity": f"WITH {LATENCY}, k AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY eid) AS rn FROM r) SELECT run, kind, round(t4 - t0, 6) AS seconds FROM k WHERE rn = 1",
    "frame_interval": f"WITH {SESSIONS} SELECT cam, round(median(t - before), 3) AS median_us, count(*) AS n FROM e1 WHERE t > before GROUP BY cam",
    "auc": f"WITH {SCORED}, k AS (SELECT y, cast(rank() OVER (ORDER BY score) AS double) + cast(count(*) OVER (PARTITION BY score) - 1 AS double) / 2 AS rk FROM d), g AS (SELECT sum(CASE WHEN y = 1 THEN rk END) AS s, cast(sum(y) AS double) AS p, cast(sum(1 - y) AS double) AS n FROM k) SELECT round((s - p * (p + 1) / 2) / (p * n), 9) AS auc FROM g",
    "threshold_sweep": f"WITH {SCORED}, t AS (SELECT DISTINCT floor(score / 500) * 500 AS cut FROM d WHERE score < 20000) SELECT cast(cut AS double) AS cut, cast(sum(CASE WHEN y = 1 AND score >= cut THEN 1 ELSE 0 END) AS bigint) AS tp, cast(sum(CASE WHEN y = 0 AND score >= cut THEN 1 ELSE 0 END) AS bigint) AS fp FROM d CROSS JOIN t GROUP BY cut",
    "best_f1": f"WITH {SCORED}, h AS (SELECT score, sum(y) AS p, count(*) AS n FROM d GROUP BY score), k AS (SELECT score, sum(p) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS m, sum(p) OVER () AS total FROM h), f AS (SELECT score, 2 * cast(tp AS double) / (m + total) AS f1, row_number() OVER (ORDER BY 2 * cast(tp AS double) / (m + total) DESC, score) AS rn FROM k) SELECT score, round(f1, 9) AS f1 FROM f WHERE rn = 1",
    "bias_jitter": "WITH m AS (SELECT l_partkey AS track, avg(ln(l_extendedprice)) AS mu FROM lineitem GROUP BY l_partkey) SELECT track, count(*) AS n, round(max(mu), 6) AS bias, round(sqrt(avg((ln(l_extendedprice) - mu) * (ln(l_extendedprice) - mu))), 6) AS jitter FROM lineitem JOIN m ON l_partkey = track GROUP BY track",
    "wilson": f"WITH {SCORED}, g AS (SELECT lang, sum(y) AS k, count(*) AS n FROM d GROUP BY lang) SELECT lang, round((k / n + 1.9208 / n - 1.96 * sqrt((k / n) * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) AS lo, round((k / n + 1.9208 / n + 1.96 * sqrt((k / n) * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) AS hi FROM (SELECT lang, cast(k AS double) AS k, cast(n AS double) AS n FROM g) z",
    "mean_sd": f"WITH {SCORED} SELECT lang, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, count(*) AS n FROM d GROUP BY lang",
    "pooled_groups": f"WITH {SCORED} SELECT lang, y, count(*) AS n, round(avg(score), 6) AS mean FROM d GROUP BY GROUPING SETS ((), (lang), (lang, y))",
    "cost_split_rank": "WITH k AS (SELECT l_orderkey AS q, l_linenumber AS col, l_extendedprice AS cost, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS rk FROM lineitem) SELECT cast(rk AS bigint) AS rk, count(*) AS n FROM k WHERE col = 1 GROUP BY rk",
    "ground_fuse_median": f"WITH {BOXES} SELECT frame, det % 3 AS gid, round(median(x + w / 2), 6) AS gx, round(median(y + h), 6) AS gy, count(*) AS support FROM b GROUP BY frame, det % 3",
    "point_classes": f"WITH {CELLS}, p AS (SELECT gid, count(DISTINCT person) AS np FROM c GROUP BY gid), q AS (SELECT person, count(DISTINCT gid) AS ng FROM c GROUP BY person) SELECT CASE WHEN np > 1 THEN 'mixed' WHEN ng > 1 THEN 'split' ELSE 'solo' END AS class, count(*) AS n FROM c JOIN p ON c.gid = p.gid JOIN q ON c.person = q.person GROUP BY 1",
    "fit_foot_line": f"WITH {BOXES}, m AS (SELECT cast(floor(y / 10) AS bigint) AS bin, median(y) AS yy, median(h) AS hh FROM b GROUP BY cast(floor(y / 10) AS bigint)) SELECT round(regr_slope(hh, yy), 6) AS a, round(regr_intercept(hh, yy), 5) AS b FROM m",
    "clock_fit": f"WITH {LATENCY}, m AS (SELECT cast(floor(t0 / 86400) AS bigint) AS bin, min(t1 - t0) AS d FROM r GROUP BY cast(floor(t0 / 86400) AS bigint)) SELECT round(regr_slope(d, bin), 9) AS drift, count(*) AS n FROM m",
    "ground_error_cells": f"WITH {BOXES}, k AS (SELECT cast(floor(x / 50) AS bigint) AS ix, cast(floor(y / 20) AS bigint) AS iy, x - floor(x / 50) * 50 AS dx FROM b), m AS (SELECT ix, iy, median(dx) AS mu, count(*) AS n FROM k GROUP BY ix, iy) SELECT k.ix, k.iy, max(n) AS n, round(max(mu), 6) AS mu, round(sqrt(avg((dx - mu) * (dx - mu))), 6) AS sigma FROM k JOIN m ON k.ix = m.ix AND k.iy = m.iy GROUP BY k.ix, k.iy",
    "entry_zones": f"WITH {SESSIONS} SELECT cast(floor(value / 50) AS bigint) AS cell, count(*) AS n, round(sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END) / count(*), 9) AS p FROM e1 GROUP BY cast(floor(value / 50) AS bigint)",
    "session_pool": f"WITH {SCORED} SELECT lang, round(avg(score), 6) AS mean, cast(sum(y) AS bigint) AS positives, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY score), 6) AS p95 FROM d GROUP BY lang",
    "last_assignment": "SELECT user_id AS tracklet, max_by(event_type, event_id) AS gid, min_by(event_type, event_id) AS first_gid, count(*) AS n FROM events GROUP BY user_id",
    "map_bounds": f"WITH {BOXES}, m AS (SELECT min(x) AS x0, max(x + w) AS x1, min(y) AS y0, max(y + h) AS y1 FROM b) SELECT round(x0 - greatest(1, 0.1 * (x1 - x0)), 6) AS left_m, round(x1 + greatest(1, 0.1 * (x1 - x0)), 6) AS right_m, round(y0 - greatest(1, 0.1 * (y1 - y0)), 6) AS top_m, round(y1 + greatest(1, 0.1 * (y1 - y0)), 6) AS bottom_m FROM m",
    "gt_spans": "SELECT l_suppkey AS track, min(l_orderkey) AS start_frame, max(l_orderkey) AS end_frame, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    # windows
    "frame_islands": "WITH f AS (SELECT DISTINCT l_suppkey AS track, l_orderkey AS frame FROM lineitem), k AS (SELECT track, frame, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS island FROM f) SELECT track, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM k GROUP BY track, island",
    "local_renumbering": f"WITH {SESSIONS} SELECT cam, lid, seq, cast(row_number() OVER (PARTITION BY cam ORDER BY start_us, lid, seq) AS bigint) AS local_id FROM s",
    "smooth_mean": f"WITH {SESSIONS} SELECT eid, round(avg(value) OVER (PARTITION BY cam, lid, seq ORDER BY t, eid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM e2",
    "smooth_linear": f"WITH {SESSIONS}, k AS (SELECT eid, t, value, regr_slope(value, cast(t AS double) / 1000000) OVER w AS sl, avg(cast(t AS double) / 1000000) OVER w AS mt, avg(value) OVER w AS mv, count(*) OVER w AS n FROM e2 WINDOW w AS (PARTITION BY cam, lid, seq ORDER BY t, eid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT eid, round(CASE WHEN n < 3 THEN value ELSE mv + sl * (cast(t AS double) / 1000000 - mt) END, 2) AS v FROM k",
    "live_latest": "SELECT user_id, max_by(event_type, event_id) AS cam, max(US(ts)) AS last_us, count(DISTINCT event_type) AS n_cameras FROM events GROUP BY user_id",
    "frame_latency": f"WITH {LATENCY}, k AS (SELECT run, kind, t0, t4, lag(t0) OVER (PARTITION BY run, kind ORDER BY t0, eid) AS p0 FROM r) SELECT run, kind, count(*) AS n, round(avg(t4 - greatest(p0, t0 - 3600)), 4) AS mean FROM k WHERE p0 IS NOT NULL GROUP BY run, kind",
    "edge_ids": f"WITH {SESSIONS}, k AS (SELECT cam, lid, seq, cast(floor(value / 100) AS bigint) AS g, row_number() OVER (PARTITION BY cam, lid, seq ORDER BY t, eid) AS rn FROM e2), v AS (SELECT cam, lid, seq, g, count(*) AS n, min(rn) AS near FROM k WHERE rn <= 5 GROUP BY cam, lid, seq, g), z AS (SELECT *, row_number() OVER (PARTITION BY cam, lid, seq ORDER BY n DESC, near) AS o FROM v) SELECT cam, lid, cast(seq AS bigint) AS seq, g FROM z WHERE o = 1",
    # scalars
    "reason_kind": "SELECT event_id, CASE WHEN props LIKE '%:%' THEN 'structured' ELSE 'plain' END AS kind, cast(length(props) AS bigint) AS n FROM events",
    "grid_position": "SELECT o_orderkey, round(-3 + cast(o_orderkey % 480 AS double) / 40, 6) AS x_m, round(-9 + cast(floor(o_orderkey / 480) AS double) / 40, 6) AS y_m FROM orders",
    "plausible_epoch": "SELECT event_id, US(ts) / 1000 BETWEEN 1577836800000 AND 4102444800000 AS plausible FROM events",
}
