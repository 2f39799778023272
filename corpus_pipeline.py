"""From documents to token rows: quality, exact and near duplicates, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rastermill.llm import stages
from rastermill.session import shared_folder

STAGES = [
    ("quality", stages.good_quality),
    ("exact_dedup", stages.one_of_equal_texts),
    ("near_dedup", stages.one_of_near_texts),
    ("mixing", stages.mixed),
    ("encoding", stages.encoded),
]

# neither the network, nor the random rounding, nor the encoding can be put into SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark, 'pipeline')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
