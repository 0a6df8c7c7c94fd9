"""Shuffles that grow with the rows, and the queries that use them."""

from pyspark.sql import functions as F

from trailmesh import scale_queries
from trailmesh.operators.spread import spread


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    assert spread(df, ["k"], rows=10).rdd.getNumPartitions() == 100
    assert spread(df, ["k"]).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_frame_islands_shuffle_once(spark, tmp_path):
    rows = [(1, 5), (1, 5), (1, 6), (1, 8), (2, 1), (2, 3), (2, 2), (2, 3)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_orderkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = scale_queries.QUERIES["frame_islands"](spark, str(tmp_path))
    assert exchanges(df) == 1
    assert sorted(map(tuple, df.collect())) == [(1, 5, 6, 2), (1, 8, 8, 1), (2, 1, 3, 3)]


def test_virtual_frames_are_not_dealt_by_camera(spark, tmp_path):
    from trailmesh import shape_queries

    rows = [(f, s, o, 1) for f in "AR" for s in "FO" for o in range(30)]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_orderkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = shape_queries.virtual_frames(spark, str(tmp_path))
    assert sorted((r.cam, r.virtual, r.n) for r in df.collect()) == sorted((c, i * 1000 + o + 1, 1) for i, c in enumerate(["AF", "AO", "RF", "RO"]) for o in range(30))
    assert "SortMergeJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    assert df.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_clock_fits_join_in_place(spark):
    from trailmesh.operators import reports

    s = spark.createDataFrame([(c, float(p), p * 1.5 + 7 + (p % 3)) for c in range(3) for p in range(40)], "cam int, p double, t double")
    df = reports.clock_fits(s, ["cam"])
    assert {(r.cam, r.n_samples, r.n_bins) for r in df.collect()} == {(c, 38, 8) for c in range(3)}
    assert df.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_many_matrices_are_assigned_like_one(spark):
    import numpy as np

    from trailmesh.operators.assign import hungarian, hungarians

    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 4), (3, 3), (4, 2), (3, 5)):
        cost = -np.round(rng.random((50, n, m)) * 4) / 4 * (rng.random((50, n, m)) < 0.6)  # with ties
        found = hungarians(cost)
        for k in range(50):
            assert sorted(zip(*map(list, np.nonzero(found[k])), strict=True)) == hungarian(cost[k])


def test_measured_vectors_give_the_same_issues(spark):
    from trailmesh.operators import validation

    vectors = [[1.0, 0.0], [0.6, 0.8], [2.0, 0.0], [1.0, 0.0, 0.0], [], None]
    rows = [(1, "cam", 640, 200, i + 1, 2, [(7, 1.0, 1.0, 5.0, 5.0, 0.5, v)]) for i, v in enumerate(vectors)]
    kind = "local_track_id int, x double, y double, w double, h double, confidence double, embedding array<float>"
    df = spark.createDataFrame(rows, f"schema_version int, cam_id string, frame_width int, frame_height int, ts_ms int, embed_dim int, detections array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    dim, norm = validation.vector_dim, validation.vector_norm
    short = df.withColumn("detections", F.transform("detections", lambda d: d.withField("dim", dim(d["embedding"])).withField("norm", norm(d["embedding"])).dropFields("embedding")))
    issues = lambda x: [r.issues for r in validation.frame_issues(x).orderBy("ts_ms").collect()]
    assert issues(short) == issues(df) == [[], [], ["norm:7"], ["dimension:7"], ["dimension:7", "norm:7"], []]
