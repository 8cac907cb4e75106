"""Exact deduplication against a persistent digest index, in DataFrame operations alone.

The index is a table bucketed and sorted by digest. A load's digests are grouped, so that each
travels once from a map task however often it occurs; a sort-merge anti-join finds the ones that
the index lacks, and those are appended. The index is never shuffled for it: its buckets are the
partitions of the join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.llm.common import fresh, one_row_each
from querytide.session import scratch_path, write_and_read

#: Runs of white space that are not one plain space already.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text, each run of white space made one space; null counts as empty."""
    normal = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")
    return F.unhex(F.sha2(normal.cast("binary"), 256))


class DigestIndex:
    """The digests of all texts loaded so far, each with the doc_id of the row that stays."""

    def __init__(self, spark: SparkSession, table: str, folder: str, buckets: int | None = None):
        self.spark, self.table, self.folder = spark, table, folder
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )

    @classmethod
    def scratch(cls, spark: SparkSession) -> DigestIndex:
        """An empty index of one run, in the shared folder."""
        name = f"digest_index_{uuid.uuid4().hex}"
        return cls(spark, name, scratch_path(spark, name))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> None:
        """Append the digests that the index lacks; `groups` has one row for each digest.

        A load that is repeated finds all its digests and appends nothing.
        """
        new = groups.select("digest", "keep_id").join(self.read().hint("merge"), "digest", "left_anti")
        new = new.repartition(self.buckets, "digest")
        new.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(
            self.table, path=self.folder
        )

    def assign(self, docs: DataFrame) -> DataFrame:
        """What becomes of every row: keep_id, group_size, kept and the text's digest.

        Rows are equal when their texts are, after each run of white space is made one space; a
        null text is empty. Of equal rows the one with the smallest doc_id stays, a null doc_id
        last; of rows with the same doc_id too, just one, whichever comes first in the scan. A
        digest of an earlier load keeps that load's keep_id, and no row of this load is kept
        unless it is that row again. `group_size` counts the rows of this load. Columns beside
        doc_id and text are not read; an empty table gives an empty table.
        """
        rows = write_and_read(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                text_digest(F.col("text")).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
        grouped = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
        groups = write_and_read(
            grouped.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("first_row"), "group_size"),
            "digest-groups",
        )
        self.add(groups)
        indexed = self.read().hint("merge").select("digest", F.col("keep_id").alias("indexed_id"))
        # A written table on either side of the last join, so that Spark can split a digest that
        # many rows share over several tasks.
        stays = write_and_read(
            groups.join(indexed, "digest").select(
                "digest", F.col("indexed_id").alias("keep_id"), "group_size",
                F.when(F.col("indexed_id").eqNullSafe(F.col("keep_id")), F.col("first_row")).alias("kept_row"),
            ),
            "digest-stays",
        )
        return rows.join(stays, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def keep_new(self, docs: DataFrame) -> DataFrame:
        """The rows of `docs` that stay, with all their columns; rules as in `assign`.

        Each map task passes on one row a digest at most, so copies are not shuffled.
        """
        digest = fresh(docs, "digest")
        doc_id = F.col("doc_id").cast("long")
        narrow = docs.select(doc_id.alias("doc_id"), text_digest(F.col("text")).alias("digest"))
        # Written before the join with the index: the optimizer would move that below the aggregate,
        # where it meets every copy.
        self.add(write_and_read(narrow.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "digest-groups"))
        first = one_row_each(
            docs.withColumn(digest, text_digest(F.col("text"))), [F.col(digest)], [doc_id.asc_nulls_last()]
        )
        index = self.read().hint("merge").select(F.col("digest").alias("_indexed"), F.col("keep_id").alias("_indexed_id"))
        here = (F.col(digest) == index["_indexed"]) & doc_id.eqNullSafe(index["_indexed_id"])
        return first.join(index, here, "left_semi").select(*[docs[c] for c in docs.columns])
