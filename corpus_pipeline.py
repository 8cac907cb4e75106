"""The corpus pipeline: rules, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Its result is
written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from querytide.llm import packing, quality_rules, secret_scan, simhash  # noqa: E402
from querytide.llm.common import read_table  # noqa: E402
from querytide.llm.exact_dedup import DigestIndex  # noqa: E402
from querytide.session import write_and_read  # noqa: E402


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject; the rules learn from the labels."""
    return quality_rules.keep_good(docs, quality_rules.learn_rules(docs, read_table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of the documents that are equal but for white space."""
    return DigestIndex.scratch(spark).keep_new(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints link."""
    return simhash.keep_one(docs, width=3, max_bits=2)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in the texts."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences; a row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", keep_distinct),
    ("SimHash near-dedup", keep_unlike),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: The learned rules, the fingerprints' components and the packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
