"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage is one of the operators in ``trailmesh.llm`` and its decisions take effect:
low-quality documents go, of equal texts and of near-duplicate classes one stays,
contaminated documents go, and what remains is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trailmesh.llm.bpe import default_spec, token_digests
from trailmesh.llm.decontaminate import decontaminate
from trailmesh.llm.exact_dedup import drop_exact_copies
from trailmesh.llm.jaccard_join import keep_one_per_class
from trailmesh.llm.lineage import shared_folder
from trailmesh.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a good enough grade; all columns stay. Null and empty texts are graded like any other."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z, the row with the largest doc_id; null counts as empty, of repeated rows one stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies; wordless texts are a class of their own."""
    return keep_one_per_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item; null texts and items have none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text; null texts have no tokens."""
    return token_digests(docs, default_spec())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("encode", encode)]

#: The stages learn and hash; SQL cannot express them. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; intermediate tables go to the shared folder."""
    where = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
