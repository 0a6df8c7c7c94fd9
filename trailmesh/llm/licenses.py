"""License scan by diagonal voting, Spark SQL functions only.

All rolling word 2-gram hashes of all texts are joined with the template positions
(a fixed, small table, so it is broadcast). Hits are counted by document, template and
diagonal (document position minus template position), every diagonal is merged with
its neighbours, and the words of the resulting spans are verified in the text, place
by place, which is read again for documents with such spans only. Base phrases are single full diagonals.

Defined cases: null or wordless text has no words and no places; repeated rows get
the same result each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.llm.lineage import checkpointed
from trailmesh.llm.native_text import with_gram_hashes, words_of

#: Phrases and their labels, then notices and the labels they add.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "mozilla public license v 2 0": "mpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "bsd 3 clause license": "bsd-3-clause",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
}
SLACK, SHARE = 2, 0.8


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, label, text.split(" "), text in PHRASES) for i, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()])]
    return spark.createDataFrame(rows, "tid int, label string, words array<string>, base boolean")


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """One row per input row: doc_id, n_words and places, verified (start, tid, label, base, score)."""
    spark = docs.sparkSession
    known = templates(spark)
    grams = with_gram_hashes(known, "words", [2]).select("tid", "base", F.size("words").alias("size"), F.posexplode("_g2").alias("at", "hash"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    scan = with_gram_hashes(texts.select("doc_id", "_key", words_of(F.col("_text")).alias("_w")), "_w", [2])
    # A null hash at position 0 carries the document itself through the look-up.
    flat = scan.select("doc_id", "_key", F.size("_w").alias("n_words"), F.concat(F.array(F.lit(None).cast("bigint")), "_g2").alias("_all"))
    flat = flat.select("doc_id", "_key", "n_words", F.posexplode_outer("_all").alias("_pos", "hash"))
    hits = flat.join(F.broadcast(grams), "hash", "left").filter(F.col("tid").isNotNull() | (F.col("_pos") == 0))
    diagonal = F.col("_pos") - 1 - F.col("at")
    votes = hits.groupBy("doc_id", "_key", "tid", "base", "size", diagonal.alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.size(F.collect_set("at")).alias("votes"), F.count("*").alias("rows")
    )
    votes = checkpointed(votes)
    own = votes.filter(F.col("tid").isNull()).select("doc_id", "_key", F.col("n_words").cast("long").alias("n_words"), F.col("rows").alias("copies"))

    exact = votes.filter(F.col("tid").isNotNull())
    full = exact.filter("base AND votes = size - 1").select("doc_id", "_key", "tid", F.col("diagonal").alias("start"), F.array("diagonal").alias("diagonals"))
    # A diagonal stands with its neighbours; the one with most votes of them (the first of a tie) names the place.
    beside = W.partitionBy("doc_id", "_key", "tid").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = exact.filter("NOT base").withColumn("around", F.collect_list(F.struct("votes", "diagonal")).over(beside)).withColumn("together", F.sum("votes").over(beside))
    better = F.exists("around", lambda x: (x["votes"] > F.col("votes")) | (x["votes"] == F.col("votes")) & (x["diagonal"] < F.col("diagonal")))
    merged = merged.filter((F.col("together") >= (F.col("size") - 1) * share / 2) & ~better)
    merged = merged.select("doc_id", "_key", "tid", F.col("diagonal").alias("start"), F.col("around")["diagonal"].alias("diagonals"))
    spans = full.unionByName(merged).groupBy("doc_id", "_key").agg(F.collect_list(F.struct("tid", "start", "diagonals")).alias("spans"))

    t, s = texts.alias("t"), spans.alias("s")
    same = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t._key") == F.col("s._key"))
    again = t.join(s, same).select("s.doc_id", "s._key", words_of(F.col("t._text")).alias("_w"), "s.spans").select("doc_id", "_key", "_w", F.explode("spans").alias("x"))
    again = again.join(F.broadcast(known), F.col("x.tid") == F.col("tid"))
    # Words of the template, in its order, that stand in the text on one of the merged diagonals.
    there = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.exists("x.diagonals", lambda d: F.coalesce(F.get("_w", d + i) == F.get("words", i), F.lit(False))))
    score = F.size(there) / F.size("words")
    again = again.select("doc_id", "_key", F.greatest("x.start", F.lit(0)).alias("start"), "tid", "label", "base", score.alias("score"))
    proven = again.filter(F.col("score") >= F.when(F.col("base"), 1.0).otherwise(share))
    places = proven.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set(F.struct("start", "tid", "label", "base", "score"))).alias("places"))
    o, p = own.alias("o"), places.alias("p")
    same = F.col("o.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("o._key") == F.col("p._key"))
    none = F.array().cast(places.schema["places"].dataType)
    out = o.join(p, same, "left").select("o.doc_id", "o.n_words", "o.copies", F.coalesce("p.places", none).alias("places"))
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_c", "copies")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))))
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
