"""A corpus pipeline of operators from tessera.llm; every stage reads what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

Defined cases, in every stage: a null text isn't toxic, is a copy of empty ones, is like no other, holds no item and packs as
an end token; null ids lose against others and stay null; rows that repeat are copies; very long texts are read whole; other
columns are carried along whatever their names, but packing returns pieces alone; an empty table passes as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, packing, similar, toxicity
from tessera.llm.common import fresh, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; the scorer learns from the labelled documents of the stage's input."""
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, toxicity.score(F.col("text"), model)).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike in five-word shingles to 0.8 or more, directly or through others, the least doc_id stays."""
    return similar.drop_similar(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("packing", packed)]
#: Learned scores and token ids can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    base: a folder of the caller's for these tables; a run that is begun again with it goes on after the last stage that
    was written whole. Without it the run has a folder of its own. What a stage has read is deleted when its rows are written.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    base = base or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    files = hadoop.Path(base).getFileSystem(conf)
    whole = [k for k in range(len(STAGES)) if files.exists(hadoop.Path(f"{base}/{k}/_SUCCESS"))]
    first = max(whole, default=-1) + 1
    docs = spark.read.parquet(f"{base}/{first - 1}") if first else table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[first:], first):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            files.delete(hadoop.Path(f"{base}/{k - 1}"), True)
    return docs
