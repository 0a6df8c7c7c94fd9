"""Quantiles, numbers, overlaps and hand-overs against brute force."""

import random
from itertools import product

import duckdb
import numpy as np
from pyspark.sql import functions as F

from trailmesh import queries
from trailmesh.operators import ranks, temporal


def test_quantiles_equal_brute_force(spark):
    rng = random.Random(7)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 40 + [1.0] * 3, "many": [rng.gauss(0, 1) for _ in range(3000)], None: [rng.randint(0, 9) * 1.0 for _ in range(50)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    qs = {"lo": 0.0, "a": 0.1, "m": 0.5, "b": 0.9, "c": 0.99, "hi": 1.0}
    for accuracy in (10, 1000):  # coarse brackets give the same values
        got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", qs, accuracy=accuracy).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k].n == len(vs)
            assert np.allclose([got[k][q] for q in qs], np.quantile(vs, list(qs.values())), atol=1e-12)
    near = {r.k: r.b for r in ranks.quantiles(df, ["k"], "v", {"b": 0.9}, "nearest").collect()}
    assert all(near[k] == sorted(vs)[int(np.ceil(0.9 * len(vs))) - 1] for k, vs in groups.items())
    whole = ranks.quantiles(df, [], "v", {"m": 0.5}).first()
    assert abs(whole.m - np.quantile([v for vs in groups.values() for v in vs], 0.5)) < 1e-12
    assert ranks.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 30), i) for i in range(600)]
    got = ranks.numbered(spark.createDataFrame(rows, "k string, v int, i int").repartition(5), ["k"], "v", ["i"], parts=8).collect()
    for k in ("a", "b", None):
        own = sorted((r for r in got if r.k == k), key=lambda r: (r.v, r.i))
        assert [r.number for r in own] == list(range(1, len(own) + 1))


def spans(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.choice("xyz"), i, s := rng.randint(0, 90), s + rng.randint(0, 40)) for i in range(n)]


def test_overlapping_spans_equal_brute_force(spark):
    rows = spans(1)
    df = spark.createDataFrame(rows, "k string, cam string, i int, s long, e long")
    for width in (7, 1000):
        got = sorted((r.k, r.i, r.other_i) for r in temporal.overlapping(df, ["k"], "s", "e", ["i"], width).collect())
        assert got == sorted((a[0], a[2], b[2]) for a, b in product(rows, rows) if a[0] == b[0] and a[3] <= b[4] and b[3] <= a[4])


def test_first_span_of_a_point(spark):
    rows = spans(2)
    points = [(k, t, f"{k}{t}") for k in "abc" for t in range(0, 140, 3)]
    df = spark.createDataFrame(rows, "k string, cam string, i int, s long, e long")
    got = {r.point_id: r.value for r in temporal.interval_lookup(spark.createDataFrame(points, "k string, t long, id string"), df, ["k"], "t", "s", "e", "id", "i", 11).collect()}
    for k, t, name in points:
        hits = [(r[3], r[2]) for r in rows if r[0] == k and r[3] <= t <= r[4]]
        assert got.get(name) == (min(hits)[1] if hits else None)


def test_handovers_equal_brute_force(spark):
    for seed, same in product((3, 4), (False, True)):
        rows = list({(r[0], r[1], r[3]): r for r in spans(seed, 40)}.values())
        df = spark.createDataFrame(rows, "k string, cam string, i int, s long, e long")
        got = {(r.k, r.dst, r.dst_seq): (r.src, r.src_seq, r.end_us) for r in temporal.handovers(df, "k", "cam", "i", "s", "e", same).collect()}
        for k, cam, i, s, _ in rows:
            before = [(-min(e, s), -e, c, q) for k2, c, q, s2, e in rows if k2 == k and (s2 < s or same and s2 == s and c < cam)]
            want = min(before, default=None)
            assert got.get((k, cam, i)) == (want and (want[2], want[3], -want[1]))


def test_overlap_counts_pair_nothing(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        a = rng.randrange(100)
        rows.append((rng.choice("ab"), rng.randrange(4), i, a, a + rng.choice([0, 0, 3, 40])))
    df = spark.createDataFrame(rows, "k string, o int, seq int, s int, e int").repartition(5)
    got = {r.seq: r.n for r in temporal.overlap_counts(df, ["k"], "o", "s", "e", ["seq"]).collect()}
    assert got == {i: sum(k == k2 and o != o2 and s <= e2 and s2 <= e for k2, o2, _, s2, e2 in rows) for k, o, i, s, e in rows}
    plan = temporal.overlap_counts(df, ["k"], "o", "s", "e", ["seq"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_brackets_that_miss_their_quantile(spark, monkeypatch):
    """Approximate quantiles only save work: values between, below or above them are found as well."""
    real = F.percentile_approx
    rows = spark.range(2000, numPartitions=6).selectExpr("id % 2 AS k", "id * 7919 % 2000 AS v")
    for shift in (-900, 300, 5000):
        monkeypatch.setattr(ranks.F, "percentile_approx", lambda c, b, n, shift=shift: F.transform(real(c, b, n), lambda x: x + shift))
        got = {r.k: r for r in ranks.quantiles(rows, ["k"], "v", {"m": 0.5, "p": 0.9}).collect()}
        assert {k: (r.n, r.m, round(r.p, 6)) for k, r in got.items()} == {k: (1000, 999.0 + k, round(float(np.quantile(range(k, 2000, 2), 0.9)), 6)) for k in (0, 1)}


def test_transit_stats_of_unknown_users_and_times(spark, tmp_path):
    rng = random.Random(5)
    day = 86_400
    rows = [(i, rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", None]), rng.choice([None, *[rng.randrange(40) * day for _ in range(4)]]), 1.0) for i in range(400)]
    text = ", ".join("(" + ", ".join("NULL" if c is None else repr(c) for c in r) + ")" for r in rows)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT a AS event_id, b AS user_id, c AS event_type, to_timestamp(d)::TIMESTAMP AS ts, e AS value FROM (VALUES {text}) v(a, b, c, d, e)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("transit_stats", "handovers"):
        want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, str(tmp_path))
        assert got.columns == list(want.columns)
        plain = lambda rs: sorted(str([None if v is None or v != v else float(v) if not isinstance(v, str) else v for v in r]) for r in rs)
        assert plain(map(tuple, got.collect())) == plain(want.itertuples(index=False))


def test_majority_vote_of_unknown_lines_and_halves_equals_the_oracle(spark, tmp_path):
    unknown = [(None, 1, 5, 1), (None, 1, 5, 2), (8, 1, 6, 1), (9, 1, 6, 1), (7, 1, None, None), (3, 1, None, 4), (2, None, 4, 1)]
    halves = [(i, part, 7 if i < n else 100 + i, 1) for part, n, of in ((2, 333, 640), (3, 323, 640), (4, 41, 640), (5, 3, 640)) for i in range(of)]
    spark.createDataFrame(unknown + halves, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = set(con.sql(queries.ORACLE_SQL["majority_vote"]).fetchall())
    df = queries.QUERIES["majority_vote"](spark, str(tmp_path))
    assert df.columns == ["track", "person", "n", "purity"]
    assert len(want) == 6 and set(map(tuple, df.collect())) == want


def test_majority_vote_leaves_no_tie_open(spark, tmp_path):
    rows = [(5, part, person, 1) for part in range(40) for person in (9, 3, None, 6)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int")
    for k, parts in enumerate((1, 5)):
        df.repartition(parts).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        assert {(r.person, r.n, r.purity) for r in queries.QUERIES["majority_vote"](spark, f"{tmp_path}/{k}").collect()} == {(3, 1, 0.25)}
