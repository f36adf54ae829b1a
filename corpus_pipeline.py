"""A training-data pipeline in five stages: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame; run() writes
each as Parquet into the shared folder and reads it again. All but the last return the columns of documents.

Rows without a doc_id stay as documents of their own; null texts are empty. Where no labels or benchmark items are
given, the stages that need them keep every document. Extra columns of docs are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import classifier
from relspark.llm.common import release, stored
from relspark.llm.decontaminate import contaminated
from relspark.llm.minhash import survivors
from relspark.llm.packing import packed
from relspark.llm.queries import tokenizer_path
from relspark.llm.secrets import without_secrets
from relspark.sources.readers import spread

#: Scores under this are rejected.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of LEAST_QUALITY or more, learnt from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~classifier.held_out()).select("doc_id", F.col("quality").alias("label"))
    model = classifier.trained(docs, labels)
    return classifier.passed(docs, model, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the least doc_id."""
    return survivors(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(docs, benchmark, window=10, carry=docs.columns).filter(F.size("at") == 0)
    return found.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packed(docs, tokenizer_path(), size=1024, end=2)


STAGES = [("quality classifier", quality), ("near duplicates", near_dedup), ("benchmark decontamination", decontamination), ("secret scan", secrets), ("best-fit packing", packing)]

#: SQL can't express the classifier, so none is given; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return docs
