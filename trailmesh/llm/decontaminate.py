"""Benchmark decontamination on word windows, with Spark SQL functions only.

The windows of the benchmark (``window`` words; a shorter item is one window of its
own length) form a hash set that is broadcast when its counted size is within
``broadcast_windows``, and shuffled otherwise. Documents are scanned once: every
window hash of every text is looked up, hits are grouped per document, and only
documents with hits are read again to verify the words themselves.

Defined cases: null or wordless text has no words and no hits; wordless items never
occur; repeated rows are all returned; equal items all count; extra columns are
ignored by ``find_contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.lineage import checkpointed
from trailmesh.llm.native_text import with_gram_hashes, words_of

BROADCAST_WINDOWS = 2_000_000


def benchmark_windows(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct window: hash, len, words, item_ids (array of string)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("_item"), words_of(F.col(text)).alias("_w")).filter(
        F.size("_w") > 0
    )
    items = items.withColumn("_len", F.least(F.size("_w"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_len") + 1))
    rows = items.select("_item", "_w", "_len", starts.alias("_at")).select(
        "_item", F.slice("_w", F.col("_at"), F.col("_len")).alias("words")
    )
    return rows.groupBy("words").agg(F.array_sort(F.collect_set("_item")).alias("item_ids"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_key"))


def _hit_spans(spans: Column) -> Column:
    """Words covered by a sorted array of (pos, len)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["pos"] + s["len"] - F.greatest(s["pos"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], s["pos"] + s["len"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per input row: doc_id, _key, n_words, n_hit, item_ids, spans.

    ``spans`` are the verified (pos, len) word windows in order; ``item_ids`` the
    distinct items of which a window occurs, sorted as strings.
    """
    windows = benchmark_windows(benchmark, window)
    stats = windows.agg(F.count("*").alias("n"), F.collect_set(F.size("words")).alias("lens")).first()
    lengths = sorted(stats["lens"]) or [window]  # at most `window` values
    table = with_gram_hashes(windows, "words", list(range(1, window + 1)))
    table = table.withColumn("_len", F.size("words")).select(
        F.col("_len").alias("w_len"),
        F.element_at(F.array(*[F.get(f"_g{n}", F.lit(0)) for n in range(1, window + 1)]), F.col("_len")).alias("w_hash"),
        "words",
        "item_ids",
    )
    probe = table.groupBy("w_hash").agg(F.min("w_len").alias("_one"))
    if stats["n"] <= broadcast_windows:
        probe, table = F.broadcast(probe), F.broadcast(table)

    words = _keyed(docs, doc_id, text).select("doc_id", "_key", words_of(F.col("_text")).alias("_w"))
    grams = with_gram_hashes(words, "_w", lengths)
    # At position 0 a document carries itself through the look-up, under a hash of its own; what that finds is passed over.
    arrays = [F.array(F.xxhash64("doc_id", "_key"))]
    size, starts = F.lit(1), []
    for n in lengths:
        starts.append((n, size))
        size = size + F.size(f"_g{n}")
        arrays.append(F.col(f"_g{n}"))
    scan = grams.select("doc_id", "_key", F.size("_w").alias("n_words"), F.concat(*arrays).alias("_all"), *[s.alias(f"_s{n}") for n, s in starts])
    flat = scan.select("doc_id", "_key", "n_words", *[f"_s{n}" for n, _ in starts], F.posexplode_outer("_all").alias("_at", "w_hash"))
    found = flat.join(probe, "w_hash", "left").filter(F.col("_one").isNotNull() | (F.col("_at") == 0))
    pos, length = F.lit(None).cast("int"), F.lit(None).cast("int")
    for n, _ in starts:
        inside = F.col("_at") >= F.col(f"_s{n}")
        pos, length = F.when(inside, F.col("_at") - F.col(f"_s{n}")).otherwise(pos), F.when(inside, F.lit(n)).otherwise(length)
    hit = F.when(F.col("_at") > 0, F.struct(pos.alias("pos"), length.alias("len")))
    per_doc = found.groupBy("doc_id", "_key").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("_at") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
    )
    per_doc = checkpointed(per_doc)

    # Verify the words of every hit; texts are read again for documents with hits only.
    suspects = per_doc.filter(F.size("hits") > 0)
    texts = _keyed(docs, doc_id, text).alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t._key") == F.col("s._key"))
    again = (
        texts.join(suspects.select("doc_id", "_key", "hits").alias("s"), same)
        .select("s.doc_id", "s._key", words_of(F.col("t._text")).alias("_w"), "s.hits")
        .select("doc_id", "_key", F.explode(F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), h["len"].alias("len"), F.slice(F.col("_w"), h["pos"] + 1, h["len"]).alias("words")))).alias("h"))
        .select("doc_id", "_key", "h.*")
    )
    true = again.join(table.select("words", "item_ids"), "words")
    proven = true.groupBy("doc_id", "_key").agg(
        F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    p, v = per_doc.alias("p"), proven.alias("v")
    same = F.col("p.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("p._key") == F.col("v._key"))
    no_span = F.array().cast("array<struct<pos:int,len:int>>")
    out = p.join(v, same, "left").select(
        "p.doc_id",
        "p._key",
        "p.n_words",
        "p.copies",
        F.coalesce("v.spans", no_span).alias("spans"),
        F.coalesce("v.item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
    out = out.withColumn("n_hit", _hit_spans(F.col("spans")).cast("long")).withColumn("n_words", F.col("n_words").cast("long"))
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_c", "copies")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, remove: str = "documents", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without contamination (``remove='documents'``), or with hit words cut out (``'spans'``).

    Cutting spans returns the remaining normalised words joined by one blank for
    documents with hits and leaves all others as they are.
    """
    found = find_contamination(docs, benchmark, window, doc_id, text).filter("n_hit > 0")
    found = found.select(F.col("doc_id").alias("__tm_id"), F.col("_key").alias("__tm_key"), F.col("spans").alias("__tm_spans")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("__tm_id")) & (F.xxhash64(F.col(text)) == F.col("__tm_key"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left").withColumn("__tm_words", words_of(F.col(text)))
    covered = lambda i: F.exists("__tm_spans", lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"]))
    cut = F.concat_ws(" ", F.filter("__tm_words", lambda w, i: ~covered(i)))
    return joined.withColumn(text, F.when(F.col("__tm_spans").isNull(), F.col(text)).otherwise(cut)).select(*docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
starts AS (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w CROSS JOIN sizes),
hits AS (SELECT doc_id, i, p.n, item FROM (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM places) p JOIN windows USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) c GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
