"""The corpus pipeline: quality, line dedup, near-dedup, mixing and packing, each a stage on all its predecessor kept.

Every stage but the last returns the columns of ``documents``. Quality drops what the classifier rejects;
line dedup shortens texts; near-dedup keeps one document of each group; mixing keeps or repeats documents
to meet the source weights; packing returns the pieces of fixed-length sequences. Stages handle nulls,
repeated rows and empty tables as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.llm.line_dedup import line_dedup
from varlens.llm.mixing import mixed_documents
from varlens.llm.neardup import one_of_each
from varlens.llm.packing import pack
from varlens.llm.quality import accepted, train
from varlens.session import Scratch

#: No SQL can express the classifier, whose decisions all later stages build on.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, accepts."""
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows."""
    out = line_dedup(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return one_of_each(docs, width=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k > 1:
            scratch.drop(STAGES[k - 1][0])
    return docs
