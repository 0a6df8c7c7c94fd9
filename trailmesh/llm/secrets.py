"""Secret scan with corpus-wide ownership frequency, Spark SQL functions only.

Candidates of fixed formats are located in whole texts. Their value hashes are
counted by distinct repository and owner over the whole corpus, pre-aggregated per
(hash, owner, repository) so that a value copied into a third of all rows is one row
per owner. A value of at least ``example_owners`` owners is a widely copied example,
any other one with enough distinct characters a live-looking credential.

Defined cases: null text is empty and has no spans; repeated rows get the same
result each; null owners and repositories count as one of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.lineage import checkpointed
from trailmesh.llm.skew import heavy_keys, salted
from trailmesh.llm.spans import Kind, candidate_rows, located, same_row, span_string

KINDS = [
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1),
    Kind("access", r"AKIA[A-Z0-9]{16,}+"),
    Kind("hex", r"[0-9a-f]{24,}+"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Kind("forge", r"(?:ghp|gho|ghs|glpat|xoxb|xoxp)[_-][A-Za-z0-9-]{16,}+"),
]
N_BASE = 3


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", example_owners: int = 3, min_distinct: int = 6) -> DataFrame:
    """One row per input row: doc_id, spans (array), n_live, n_example."""
    repo = F.concat_ws("/", F.coalesce(F.col(owner).cast("string"), F.lit("")), F.coalesce(F.col(repository).cast("string"), F.lit("")))
    rows = candidate_rows(docs, KINDS, doc_id, text, F.col(owner).cast("string").alias("_owner"), repo.alias("_repo"))
    rows = checkpointed(rows)
    spans = located(rows, KINDS).filter((F.col("kind") != "assign") | (F.length("value") >= 6))
    spans = spans.withColumn("hash", F.sha2("value", 256)).withColumn("varied", F.size(F.array_distinct(F.split("value", ""))) >= min_distinct)
    whose = rows.filter(F.size("found") > 0).select("doc_id", "_key", "_owner", "_repo").distinct()
    held = spans.select("doc_id", "_key", "hash").distinct().alias("s").join(whose.alias("w"), same_row("s", "w"))
    counts = held.groupBy("hash", F.coalesce("_owner", F.lit("")).alias("_owner"), "_repo").agg(F.lit(1).alias("n"))
    counts = counts.groupBy("hash", "_owner").agg(F.sum("n").alias("repos"))
    counts = counts.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"))
    used = spans.groupBy("hash").agg(F.count("*").alias("n_spans"))
    counts = checkpointed(counts.join(used, "hash"))
    # Every copy of a widely used secret meets its counts; they are dealt to many tasks.
    common = F.col("hash").isin(heavy_keys(counts, "hash", "n_spans"))
    judged = salted(spans, counts.drop("n_spans"), ["hash"], common, ["doc_id", "_key", "start"]).withColumn("example", F.col("n_owners") >= example_owners)
    per_doc = judged.groupBy("doc_id", "_key").agg(
        F.collect_list(F.struct("start", "rank", "end", "kind", "n_owners", "n_repositories", "example", (~F.col("example") & F.col("varied")).alias("live"))).alias("spans")
    )
    empty = F.array().cast(per_doc.schema["spans"].dataType)
    out = rows.alias("r").join(per_doc.alias("p"), same_row("r", "p"), "left")
    return out.select("r.doc_id", F.coalesce(F.array_sort("p.spans"), empty).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rank"] < N_BASE)
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        "doc_id",
        *[count(_is(k.name)).alias(f"n_{k.name}") for k in KINDS[:N_BASE]],
        F.sha2(span_string(base), 256).alias("base_sha256"),
        span_string(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["example"]).alias("n_example"),
    )
