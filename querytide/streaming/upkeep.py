"""Upkeep of the state tables from a stream of log rows.

Each micro-batch writes its own share of the state to a folder named by its batch number,
so a batch that is repeated after a failure replaces its own files and nothing is counted
twice. Readers merge the shares. Every so many batches the shares are merged into a base and
older ones deleted, which keeps the number of folders bounded. A batch looks up its own domains
only, in what the window still needs. There is no watermark: late rows are counted like all
others, and days that were closed before are listed for closing again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querytide.operators.novelty import (
    first_sightings,
    novel_after_state,
    upsert_known_domains,
)
from querytide.operators.report_days import assign_report_days
from querytide.params import DAY, ReportParams
from querytide.schemas import KNOWN_DOMAINS_SCHEMA
from querytide.session import write_and_read
from querytide.sources.files import (
    delete_folder,
    finished_folders,
    matching_names,
    path_exists,
)
from querytide.sources.state_tables import StateTables

COUNTS_SCHEMA = "network_id STRING, report_date DATE, client STRING, domain STRING, n BIGINT"
VOLUME_SCHEMA = "network_id STRING, report_date DATE, client STRING, query_count BIGINT"
ALERT_SCHEMA = "network_id STRING, report_date DATE, domain STRING"


def merge_known(shares: DataFrame) -> DataFrame:
    return shares.groupBy("network_id", "domain").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def merge_volume(shares: DataFrame) -> DataFrame:
    return shares.groupBy(*DAY, "client").agg(F.sum("query_count").alias("query_count"))


class ShareTable:
    """A table kept as one folder per micro-batch plus an occasional merged base."""

    def __init__(self, root: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        self._shares = f"{root}/shares"
        self._bases = f"{root}/bases"
        self._schema = schema
        self._merge = merge

    def write(self, share: DataFrame, batch_id: int) -> None:
        share.write.mode("overwrite").parquet(f"{self._shares}/{_folder(batch_id)}")

    def read(
        self,
        spark: SparkSession,
        before: int | None = None,
        pick: Callable[[DataFrame], DataFrame] = lambda shares: shares,
    ) -> DataFrame:
        """State after all batches, or after the batches before a given one.

        `pick` takes out the rows that are needed before they are merged.
        """
        end = "batch=~" if before is None else _folder(before)
        bases = [name for name in finished_folders(spark, self._bases) if name < end]
        start = bases[-1] if bases else ""
        paths = [f"{self._bases}/{name}" for name in bases[-1:]] + [
            f"{self._shares}/{name}"
            for name in finished_folders(spark, self._shares)
            if start < name < end
        ]
        if not paths:
            return spark.createDataFrame([], self._schema)
        return self._merge(pick(spark.read.schema(self._schema).parquet(*paths)))

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """Merge everything up to a batch; run after that batch has written its share.

        The base before and the shares since then stay, for a batch that is repeated; what went
        into that base is deleted, so the folders do not grow with the number of batches.
        """
        self.read(spark, batch_id + 1).write.mode("overwrite").parquet(
            f"{self._bases}/{_folder(batch_id)}"
        )
        before = [n for n in finished_folders(spark, self._bases) if n < _folder(batch_id)][-1:]
        for folder in (self._shares, self._bases):
            for name in finished_folders(spark, folder):
                if before and (name < before[0] or (name == before[0] and folder == self._shares)):
                    delete_folder(spark, f"{folder}/{name}")


class StateUpkeep:
    """A `foreachBatch` function that keeps known domains, daily volumes and alerts."""

    def __init__(
        self, root: str, params: ReportParams = ReportParams(), compact_every: int = 96
    ) -> None:
        root = root.rstrip("/")
        self._params = params
        self._compact_every = compact_every
        self._batches = f"{root}/batches"
        self._sightings = f"{root}/sightings"
        self._counts = f"{root}/counts"
        self._closed = f"{root}/closed"
        self._alerts = f"{root}/alerts"
        self.known = ShareTable(f"{root}/known_domains", KNOWN_DOMAINS_SCHEMA, merge_known)
        self.volumes = ShareTable(f"{root}/daily_volume", VOLUME_SCHEMA, merge_volume)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Count the batch once, then derive everything from that small table."""
        spark = batch.sparkSession
        (
            assign_report_days(batch, self._params)
            .groupBy(*DAY, "client", "domain")
            .agg(F.count("*").alias("n"))
            .write.mode("overwrite")
            .parquet(f"{self._batches}/{_folder(batch_id)}")
        )
        counted = spark.read.schema(COUNTS_SCHEMA).parquet(f"{self._batches}/{_folder(batch_id)}")
        delete_folder(spark, f"{self._batches}/{_folder(batch_id - 1)}")
        counted.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("report_date", "batch").parquet(self._counts)
        sightings = self._sighted(counted, batch_id)
        novel_after_state(
            sightings,
            self.known.read(spark, batch_id, lambda shares: self._needed(shares, sightings)),
            self._params.known_domains_window_days,
        ).write.mode("overwrite").parquet(f"{self._alerts}/{_folder(batch_id)}")
        nothing = spark.createDataFrame([], KNOWN_DOMAINS_SCHEMA)
        self.known.write(upsert_known_domains(nothing, sightings), batch_id)
        self.volumes.write(
            counted.groupBy(*DAY, "client").agg(F.sum("n").alias("query_count")), batch_id
        )
        if (batch_id + 1) % self._compact_every == 0:
            self.known.compact(spark, batch_id)
            self.volumes.compact(spark, batch_id)

    def _sighted(self, counted: DataFrame, batch_id: int) -> DataFrame:
        """A batch's domains and days, written once for the steps that read them."""
        path = f"{self._sightings}/{_folder(batch_id)}"
        first_sightings(counted).write.mode("overwrite").parquet(path)
        delete_folder(counted.sparkSession, f"{self._sightings}/{_folder(batch_id - 1)}")
        return counted.sparkSession.read.schema(ALERT_SCHEMA).parquet(path)

    def _needed(self, shares: DataFrame, sightings: DataFrame) -> DataFrame:
        """The state of a batch's domains, of each as far back as its own first day's window reaches."""
        first = sightings.groupBy("network_id", "domain").agg(F.min("report_date").alias("_first"))
        start = F.date_sub("_first", self._params.known_domains_window_days)
        met = shares.join(first, ["network_id", "domain"])
        return met.filter(F.col("last_seen") >= start).drop("_first")

    def forget_days(self, spark: SparkSession, before: date) -> None:
        """Delete the counts of report days before a date, which can then not be closed again."""
        for name in matching_names(spark, f"{self._counts}/report_date=*"):
            if name < f"report_date={before.isoformat()}":
                delete_folder(spark, f"{self._counts}/{name}")
                delete_folder(spark, f"{self._closed}/{name}")

    def close_days(self, state: StateTables, spark: SparkSession, days: list[date]) -> None:
        """Hand finished report days over to the tables that daily runs read.

        Only the days' own folders are read. Which batches they held is noted, so that
        `reopened_days` can tell what came later.
        """
        held = (
            spark.read.schema(f"{COUNTS_SCHEMA}, batch BIGINT")
            .parquet(self._counts)
            .filter(F.col("report_date").isin(days))
        )
        rows = write_and_read(held, "closing")
        state.record_domains(first_sightings(rows))
        state.record_volume(rows.groupBy(*DAY, "client").agg(F.sum("n").alias("query_count")))
        rows.groupBy("report_date").agg(F.max("batch").alias("batch")).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(
            self._closed
        )

    def reopened_days(self, spark: SparkSession) -> list[date]:
        """Closed days that have rows from batches after their closing."""
        if not path_exists(spark, f"{self._closed}/report_date=*"):
            return []
        closed = spark.read.schema("batch BIGINT, report_date DATE").parquet(self._closed)
        batches = spark.read.schema("report_date DATE, batch BIGINT").parquet(self._counts)
        newest = batches.groupBy("report_date").agg(F.max("batch").alias("newest"))
        late = newest.join(closed, "report_date").filter("newest > batch")
        return sorted(row.report_date for row in late.select("report_date").collect())

    def start(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            log.writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def known_domains(self, spark: SparkSession) -> DataFrame:
        return self.known.read(spark)

    def daily_volume(self, spark: SparkSession) -> DataFrame:
        return self.volumes.read(spark)

    def alerts(self, spark: SparkSession) -> DataFrame:
        """New domains as found batch by batch; one folder a batch, for their reader to delete."""
        return spark.read.schema(ALERT_SCHEMA).parquet(f"{self._alerts}/batch=*")


def _folder(batch_id: int) -> str:
    """Batch folders in an order that sorts as text."""
    return f"batch={batch_id:012d}"
