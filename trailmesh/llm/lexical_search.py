"""Ranked lexical search: postings by term, integer scores, the best documents of each item.

``build_postings`` scans whole texts once and writes one row per document and wanted
term, with the totals of all documents beside it. ``ranked`` joins the items' terms with
their postings, scores each match in whole numbers, sums by item and document and takes
the best rows of a window.

For the join, postings are dealt out in buckets of documents, not of terms: a document's
sums then need no shuffle of the matches, of which there are ten times as many as
postings, since a frequent term meets every item that has it. No term is a partition of
its own, so a frequent one is no hot key.

Defined cases: null texts and texts without a term belong to no count and are never
found, items without a term find nothing; every row is a document of its own, also where
rows repeat or share a doc_id, and such rows of equal score follow each other in any
order; a null doc_id comes before all others of its score; equal item_ids are one item
with the terms of all its rows; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.llm.shuffles import stage_written

#: A-Z to a-z, other bytes that belong to no term to a blank; bytes of code points from U+0080 on are letters.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20
#: Items' terms are given to the tasks up to so many, and their weights broadcast up to so many rows; beyond, both are joined by a shuffle.
KNOWN_TERMS, BROADCAST_WEIGHTS = 200_000, 1_000_000
#: Rows of postings for a bucket of documents.
BUCKET_ROWS = 500_000


def count_terms(text: str | None) -> Counter[bytes]:
    """Terms of a whole text with their occurrences, a piece at a time."""
    data, found, at = (text or "").encode(), Counter(), 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and _TERM_BYTES[data[end]] != 32:  # a piece ends between terms
            end += 1
        found.update(data[at:end].translate(_TERM_BYTES).split())
        at = end
    return found


@dataclass
class Postings:
    """rows(term, row, doc_id, tf, n) and a number of buckets for them; of all documents: how many have terms, and their terms."""

    rows: DataFrame
    buckets: int
    n_docs: int
    n_terms: int


def build_postings(docs: DataFrame, terms: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> Postings:
    """Postings of all terms, or of those in terms(term); totals always cover all terms of all documents."""
    wanted = None
    if terms is not None:
        few = [r.term for r in terms.select("term").distinct().limit(KNOWN_TERMS + 1).collect()]
        wanted = {t.encode() for t in few} if len(few) <= KNOWN_TERMS else None
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, tfs, sizes, with_terms, total = [], [], [], [], 0, 0
            for i, value in enumerate(batch.column(2)):
                found = count_terms(value.as_py())
                n = found.total()
                with_terms, total = with_terms + (n > 0), total + n
                own = found.keys() if wanted is None else found.keys() & wanted
                at += [i] * len(own)
                keys += own
                tfs += [found[t] for t in own]
                sizes += [n] * len(own)
            if len(batch):  # a row without a term carries the batch's totals
                at, keys, tfs, sizes = [*at, 0], [*keys, None], [*tfs, with_terms], [*sizes, total]
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()).cast(pa.string()), batch.column(0).take(take), batch.column(1).take(take), pa.array(tfs, pa.int64()), pa.array(sizes, pa.int64())],
                ["term", "row", "doc_id", "tf", "n"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = stage_written(numbered.mapInArrow(scan, f"term string, row bigint, doc_id {kind}, tf bigint, n bigint"))
    totals = found.filter("term IS NULL").agg(F.sum("tf").alias("docs"), F.sum("n").alias("terms")).first()
    # All cores stay busy, and a bucket's sums stay small.
    buckets = max(1 + found.count() // BUCKET_ROWS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = found.filter("term IS NOT NULL")
    if terms is not None and wanted is None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return Postings(rows, buckets, totals["docs"] or 0, totals["terms"] or 0)


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term and its occurrences among the item's terms."""
    kind = items.schema[item_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_terms(value.as_py()) for value in batch.column(1)]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array([t for f in found for t in f], pa.binary()).cast(pa.string()), pa.array([c for f in found for c in f.values()], pa.int64())], ["item_id", "term", "times"]
            )

    rows = items.select(F.col(item_id), F.col(text)).mapInArrow(scan, f"item_id {kind}, term string, times bigint")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def ranked(postings: Postings, asked: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item of asked(item_id, term, times)."""
    spark, n_docs, n_terms = asked.sparkSession, max(postings.n_docs, 1), max(postings.n_terms, 1)
    df = postings.rows.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + 1.0)))
    weights = stage_written(asked.join(df, "term").select("item_id", "term", (weight * F.col("times")).cast("bigint").alias("weight")))
    if weights.count() <= BROADCAST_WEIGHTS:
        weights = F.broadcast(weights)
    # 75 * n * N in 64 bits where it fits there, else in decimals.
    fits = (1 << 63) // (75 * n_docs) - 1
    share = F.expr(f"CASE WHEN n <= {fits} THEN (75L * n * {n_docs}L) div {n_terms}L ELSE CAST((CAST(75 AS DECIMAL(5,0)) * n * CAST({n_docs} AS DECIMAL(15,0))) div {n_terms} AS BIGINT) END")
    rows = postings.rows.repartition(postings.buckets, "row").withColumn("m", F.lit(25) + share)
    rows = rows.withColumn("part", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")).select("row", "doc_id", "term", "part")
    matches = rows.join(weights, "term").select("row", "doc_id", "item_id", (F.col("weight") * F.col("part")).alias("score"))
    sums = matches.groupBy("item_id", "row").agg(F.sum("score").alias("score"), F.max("doc_id").alias("doc_id")).filter("score > 0")
    # Each task keeps its own k best of an item before they meet.
    best = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"), "row"))
    return sums.withColumn("rank", best).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The k best documents of each item, among all documents."""
    asked = stage_written(query_terms(items, item_id, text))
    return ranked(build_postings(docs, asked.select("term"), doc_id, text), asked, k)


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) x GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) x GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
