"""What operators leave behind, on disk and in the driver."""

import random

from trailmesh.llm import lm_score, quality


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i) for i in range(files.size()))
    return {f.getPath(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_language_models_leave_no_shuffles_of_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "MAX_WORDS", 16)
    monkeypatch.setattr(lm_score, "MAX_PAIRS", 16)
    monkeypatch.setattr(lm_score, "DEALT", 20_000)
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(4000)}" for _ in range(300))) for i in range(300)], "doc_id long, text string").repartition(3)
    before = shuffle_files(spark)
    rows = lm_score.score_documents(docs, docs.filter("doc_id % 3 = 0").select("doc_id")).collect()
    left = sum(n for f, n in shuffle_files(spark).items() if f not in before)
    assert len({x.doc_id for x in rows}) == len(rows) == 300 and left < 200_000


def test_quality_learns_outside_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good words {i} here" if i % 2 else "bad BAD bad") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(type(docs), "toArrow", None)  # features once came to the driver by it
    got = {x.doc_id: x.grade for x in quality.score_quality(docs, labels).collect()}
    assert all(got[i] == (2 if i % 2 else 0) for i in range(60))
