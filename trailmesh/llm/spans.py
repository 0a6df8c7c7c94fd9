"""Spans of regular expressions in whole texts, with Spark SQL functions only.

Spark's regular expressions return matches without offsets. Splitting at the same
pattern returns the gaps between them; running sums of both lengths, as a window over
the exploded candidates of a document, give code point offsets in linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds its value, and a cheap pattern of the texts that may hold it."""

    name: str
    pattern: str
    group: int = 0
    hint: str | None = None


def _found(text: Column, kind: Kind, rank: int, context: int = 0) -> Column:
    rx = F.lit(kind.pattern)
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))
    full = F.regexp_extract_all(text, rx, F.lit(0))
    value = full if kind.group == 0 else F.regexp_extract_all(text, rx, F.lit(kind.group))
    rows = F.transform(
        F.arrays_zip(full.alias("m"), value.alias("v"), F.slice(gaps, F.lit(1), F.size(full)).alias("g")),
        lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x["g"].alias("gap"), x["m"].alias("match"), x["v"].alias("value")),
    )
    sides = ""
    if context:  # what stands before and after a match, up to the next match of the kind
        pieces = F.split(text, kind.pattern, -1)
        before, after = F.transform(pieces, lambda g: F.right(g, F.lit(context))), F.transform(pieces, lambda g: F.left(g, F.lit(context)))
        sides = ",before:string,after:string"
        rows = F.zip_with(rows, F.arrays_zip(F.slice(before, F.lit(1), F.size(full)).alias("b"), F.slice(after, F.lit(2), F.size(full)).alias("a")), lambda x, y: F.struct(*[x[n].alias(n) for n in ("rank", "i", "gap", "match", "value")], y["b"].alias("before"), y["a"].alias("after")))
    none = F.array().cast(f"array<struct<rank:int,i:int,gap:int,match:string,value:string{sides}>>")
    return F.when(text.rlike(kind.hint or kind.pattern), rows).otherwise(none)


def candidate_rows(docs: DataFrame, kinds: list[Kind], doc_id: str, text: str, *keep: Column, context: int = 0) -> DataFrame:
    """doc_id, _key (hash of the text), the kept columns and ``found``: all matches of all kinds, with ``context`` characters of either side."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("_key"),
        *keep,
        F.concat(*[_found(t, k, r, context) for r, k in enumerate(kinds)]).alias("found"),
    )


def located(rows: DataFrame, kinds: list[Kind]) -> DataFrame:
    """One row per match: doc_id, _key, rank, kind, start, end (exclusive), match, value.

    Rows with the same doc_id and text count once.
    """
    one = rows.filter(F.size("found") > 0).select("doc_id", "_key", "found").dropDuplicates(["doc_id", "_key"])
    flat = one.select("doc_id", "_key", F.explode_outer("found").alias("f")).select("doc_id", "_key", "f.*")
    so_far = W.partitionBy("doc_id", "_key", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    flat = flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    names = F.array(*[F.lit(k.name) for k in kinds])
    return flat.withColumn("kind", F.element_at(names, F.col("rank") + 1)).drop("gap", "i")


def span_string(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined; spans are structs of start, rank, end, kind."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}._key") == F.col(f"{right}._key"))
