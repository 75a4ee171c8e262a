"""The corpus pipeline: language ID, SimHash near-dedup, secret scans, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a
DataFrame; all but the last return the columns of documents. Documents that language ID rejects go, one
document of each group of near copies stays, secrets are replaced in the texts, rows are repeated, cut or
left out as the mix takes them, and what remains is cut and packed into sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, packing, secrets, simhash
from tessera.llm.common import shared_dir
from tessera.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [("language_id", identify), ("simhash", deduplicate), ("secrets", redact), ("mixing", mix), ("packing", pack)]

#: Models, fingerprints and tokens can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage returns is written to the shared folder and read again by the next one; a stage's files go when the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, before = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        folder = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
