"""From raw documents to packed sequences: quality rules, near-dedup, decontamination, secret scans, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again, and returns the columns of documents; the
last one returns the pieces of the packed sequences.

Defined results: an empty table stays empty in each stage. A null or empty text has too few words for the quality rules; taken alone,
near-dedup puts null, empty and wordless texts in one group, decontamination and the secret scans keep them as they are, and packing
gives each the end id alone. Of rows that share id and text near-dedup keeps one; the other stages treat them one by one. A null id
ranks last. Very long texts are read whole. Extra columns, whatever their names, go through the first four stages unchanged."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, packing, quality, secrets, simhash
from tessera.llm.common import bounded, documents, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and boilerplate lines from those that stay; n_chars follows the text."""
    bounded(spark)
    return quality.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    bounded(spark)
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, bounded(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows it. All documents stay."""
    return secrets.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into."""
    bounded(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: Tokenizing and differencing have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what lies between two of them is in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
