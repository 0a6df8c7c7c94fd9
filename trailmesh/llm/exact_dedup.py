"""Exact deduplication by content-defined chunk recipes.

Texts (A-Z lower-cased, null as empty) are cut where a rolling hash of the last
``WINDOW`` bytes has ``bits`` zero bits, at ``max_chunk`` bytes at the latest. The
bytes of a chunk move once per distinct chunk and task: grouping by fingerprint and
bytes proves which fingerprints stand for a single content. A fingerprint with
several contents gets an ordinal for each. Documents are then compared by their
ordered lists of verified identifiers, never by their texts.

Defined cases: null and empty texts are equal to each other; of equal texts the
largest doc_id stays, of repeated rows with that doc_id just one, and if all doc_ids
are null one row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.llm import np_text as T
from trailmesh.llm.lineage import checkpointed
from trailmesh.llm.skew import heavy_keys, salted

WINDOW, BITS, MIN_CHUNK, MAX_CHUNK = 48, 11, 256, 16384


def chunk_cuts(buf: np.ndarray, bits: int = BITS, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of one lower-cased text; depends on its bytes alone."""
    marks = []
    for a in range(0, len(buf), T.SEGMENT):
        lo, hi = max(0, a - WINDOW + 1), min(len(buf), a + T.SEGMENT)
        seg = buf[lo:hi]
        if len(seg) < WINDOW:
            continue
        up, down = T.powers(len(seg) + 1)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg.astype(np.uint64) * up[:-1], out=sums[1:])
        roll = T.mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(seg) + 1 - WINDOW])
        marks.append(np.flatnonzero(roll >> np.uint64(64 - bits) == 0) + lo + WINDOW)
    cuts, last = [], 0
    for m in np.concatenate(marks).tolist() if marks else []:
        while m - last > max_chunk:
            last += max_chunk
            cuts.append(last)
        if m - last >= min_chunk:
            cuts.append(m)
            last = m
    while len(buf) - last > max_chunk:
        last += max_chunk
        cuts.append(last)
    return cuts + [len(buf)] if len(buf) > last or not cuts else cuts


def _fingerprint(chunk: bytes, fp_bits: int) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True) >> (64 - fp_bits)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    buf, off = T.buffer_of(batch.column(1))
    for i in range(len(batch)):
        own = T.LOWER[buf[off[i] : off[i + 1]]]
        yield i, own, chunk_cuts(own)


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fp_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and the ordered chunk fingerprints of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, fps, sizes = [], [], [0]
            for _, own, cuts in _chunks(batch):
                data = own.tobytes()
                shas.append(hashlib.sha256(data).hexdigest())
                fps += [_fingerprint(data[a:b], fp_bits) for a, b in zip([0, *cuts], cuts)]
                sizes.append(len(fps))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(shas, pa.string()), T.lists(np.array(fps, np.int64), np.array(sizes), pa.int64())],
                ["doc_id", "key", "text_sha256", "fps"],
            )

    own = docs.select(F.col(doc_id), F.col(text), F.xxhash64(F.col(text)))
    return own.mapInArrow(run, f"doc_id {kind}, key bigint, text_sha256 string, fps array<bigint>")


def chunk_contents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fp_bits: int = 64) -> DataFrame:
    """Fingerprint and bytes of every chunk, with its row's doc_id and place; once per batch without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for _, own, cuts in _chunks(batch):
                data = own.tobytes()
                seen.update(data[a:b] for a, b in zip([0, *cuts], cuts))
            rows = list(seen)
            for a in range(0, max(1, len(rows)), 2000):
                part = rows[a : a + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(c, fp_bits) for c in part], pa.int64()), pa.array(part, pa.binary())], ["fp", "bytes"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, "fp bigint, bytes binary")


def _placed(docs: DataFrame, doc_id: str, text: str, fp_bits: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own, cuts in _chunks(batch):
                data = own.tobytes()
                part = [data[a:b] for a, b in zip([0, *cuts], cuts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * len(part))), pa.array([hashlib.sha256(data).hexdigest()] * len(part)), pa.array(range(len(part)), pa.int32()), pa.array([_fingerprint(c, fp_bits) for c in part], pa.int64()), pa.array(part, pa.binary())],
                    ["doc_id", "text_sha256", "pos", "fp", "bytes"],
                )

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, text_sha256 string, pos int, fp bigint, bytes binary")


def dedup_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fp_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks,
    and key, the 64-bit hash of the text as it stands.

    ``fp_bits`` shortens the fingerprints, for tests of colliding ones.
    """
    contents = chunk_contents(docs, doc_id, text, fp_bits).groupBy("fp", "bytes").agg(F.count("*").alias("n"))
    clashing = checkpointed(contents.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"))
    own = recipes(docs, doc_id, text, fp_bits)
    if clashing.isEmpty():
        own = own.withColumn("ords", F.array().cast("array<int>"))
    else:
        # Only chunks under a clashing fingerprint move again, to learn their ordinal.
        places = _placed(docs, doc_id, text, fp_bits).join(clashing, "fp")
        ranks = places.select("fp", "bytes").distinct().withColumn("ord", F.row_number().over(W.partitionBy("fp").orderBy("bytes")))
        found = places.distinct().join(ranks, ["fp", "bytes"]).groupBy("doc_id", "text_sha256", "pos").agg(F.max("ord").alias("ord"))
        found = found.groupBy(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("pos", "ord"))).alias("ords"))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_sha256") == F.col("_s"))
        own = own.join(found, same, "left").withColumn("ords", F.coalesce(F.col("ords")["ord"], F.array().cast("array<int>")))
    own = own.select("doc_id", "key", "text_sha256", "fps", "ords", F.row_number().over(W.partitionBy("doc_id", "text_sha256").orderBy("key")).alias("copy"))
    own = checkpointed(own)
    groups = checkpointed(own.groupBy("fps", "ords").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    recipe = F.xxhash64("fps", "ords")
    # A large group's rows meet its one row in many tasks.
    large = recipe.isin(heavy_keys(groups.select(recipe.alias("recipe"), "group_size"), "recipe", "group_size"))
    return salted(own, groups, ["fps", "ords"], large, ["doc_id", "copy"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
        F.size("fps").alias("n_chunks"),
        "key",
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    rows = dedup_exact(docs, doc_id, text).groupBy(F.col("doc_id").alias("__tm_id"), F.col("key").alias("__tm_key"))
    rows = rows.agg(F.max("kept").alias("__tm_kept"), F.count("*").alias("__tm_rows"))
    gone, repeated = rows.filter("NOT __tm_kept"), rows.filter("__tm_kept AND __tm_rows > 1")
    same = F.col(doc_id).eqNullSafe(F.col("__tm_id")) & (F.xxhash64(F.col(text)) == F.col("__tm_key"))
    once = docs.join(gone.unionByName(repeated), same, "left_anti")
    again = docs.join(repeated, same, "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(again)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chunks", "key")


OP8_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
