"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark-contaminated documents go, and what is left is encoded.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``. All but the
last return the columns of their input. Between stages the rows are written
as Parquet and read again. Stages take empty tables, null and repeated ids,
null and empty texts, and further columns, as their operators do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismara.llm import decontaminate, minhash_dedup, piece_bpe, toxicity
from prismara.llm.queries import piece_model
from prismara.llm.shared import discard, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of rows in ``docs``, as ``op4`` does, and drops what reaches its threshold."""
    machine = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in shingles of five, similarity 0.8 or more; the smallest id of each group stays."""
    return minhash_dedup.deduplicated(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded texts."""
    return piece_bpe.encode_decode(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The first stage fits a model, which SQL does not express; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return docs
