"""Documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``docs``. In order: toxic documents go; of each group of near duplicates one document
stays; secrets in texts are masked (no document goes for them); sources are mixed to
target weights, copies of a document being rows of their own; token pieces are packed.

Nulls, empty texts, repeated rows and empty tables are handled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from endcap.functions.durable import shared_folder
from endcap.functions.ship import ship
from endcap.llm import jaccard_join, mixing, packing, secret_scan, toxicity

#: SQL can express neither the classifier nor the random choices.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, labels)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity, the one of least doc_id."""
    return jaccard_join.first_of_groups(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the name of the kind."""
    return secret_scan.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources copy it."""
    return mixing.mix_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a sequence."""
    return packing.packed(docs)


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run


STAGES = [(name, _shipped(stage)) for name, stage in (
    ("toxicity", toxicity_stage), ("near duplicates", near_duplicate_stage),
    ("secrets", secret_stage), ("mixing", mixing_stage), ("packing", packing_stage))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to a fresh folder beside the
    checkpoints and read again by the next one; the last one's frame is returned."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
