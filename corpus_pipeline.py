"""A training corpus from raw documents: five stages, each one an operator of ``civicpulse.llm``.

Documents that the quality classifier rejects go, one document of each group of near duplicates
stays, documents with benchmark passages go, personal data is masked, and what is left is packed
into token sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.llm import decontamination, jaccard, packing, pii, quality
from civicpulse.llm.common import start, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` that the model trained on ``labels`` accepts; the labels of all rows teach."""
    start(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, directly or by others, the first."""
    start(spark)
    return jaccard.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` without a passage of ``benchmark``."""
    start(spark)
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of ``docs``, personal data in their texts replaced by its kind, ``n_chars`` with it."""
    start(spark)
    clean = pii.masked(docs)
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequence and offset of each."""
    start(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each stage's rows are written to the shared folder and read by the next, which then removes
    what it has read; the last stage's rows stay.
    """
    docs = table(spark, sf_dir, "documents")
    base, before = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
