"""Domains of rows that arrive behind the watermark of an alert stream.

`LateDomains` runs beside the stream on the same log. It keeps the days of domains that any
division of the log into batches may have put behind the watermark, and `fold` judges them against
the state tables and adds them there. A day is new or not by the days before it alone, so folding
the same batches again gives the same alerts.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querytide.operators.novelty import first_sightings, novel_over_history
from querytide.operators.report_days import assign_report_days
from querytide.params import DAY, ReportParams
from querytide.schemas import SIGHTING_SCHEMA
from querytide.sources.files import delete_folder, path_exists
from querytide.sources.state_tables import StateTables


class LateDomains:
    """A `foreachBatch` function that sets late domains aside.

    Late is a report day `lateness_days` or more before the newest of the rows up to and including
    the batch's own: the watermark that judged a row cannot have been further. The newest day is
    handed from batch to batch, so a batch costs the same however many there were, and a batch that
    is repeated replaces its own rows.
    """

    def __init__(
        self, root: str, lateness_days: int = 2, params: ReportParams = ReportParams()
    ) -> None:
        root = root.rstrip("/")
        self._lateness = lateness_days
        self._params = params
        self._days = f"{root}/days"
        self._late = f"{root}/late"
        self._newest = f"{root}/newest"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = f"{self._days}/{batch_id}"
        sightings = first_sightings(assign_report_days(batch, self._params))
        sightings.write.mode("overwrite").parquet(days)
        sightings = spark.read.schema(SIGHTING_SCHEMA).parquet(days)
        newest = sightings.select("report_date")
        before = f"{self._newest}/{batch_id - 1}"
        if path_exists(spark, before):
            newest = newest.unionByName(spark.read.schema("report_date DATE").parquet(before))
        newest = newest.agg(F.max("report_date").alias("report_date"))
        newest.write.mode("overwrite").parquet(f"{self._newest}/{batch_id}")
        last = spark.read.schema("report_date DATE").parquet(f"{self._newest}/{batch_id}").first()[0]
        limit = F.date_sub(F.lit(last).cast("date"), self._lateness)
        sightings.filter(F.col("report_date") <= limit).write.mode("overwrite").parquet(
            f"{self._late}/batch={batch_id}"
        )
        delete_folder(spark, days)
        delete_folder(spark, f"{self._newest}/{batch_id - 2}")

    def start(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            log.writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def late(self, spark: SparkSession, first_batch: int = 0) -> DataFrame:
        """Late domains and days of the batches from one on; older batches are not opened."""
        rows = spark.read.schema(f"{SIGHTING_SCHEMA}, batch BIGINT").parquet(self._late)
        return rows.filter(F.col("batch") >= first_batch).select(*DAY, "domain").distinct()

    def alerts(self, spark: SparkSession, state: StateTables, first_batch: int = 0) -> DataFrame:
        """Late domains that were new on their day, by all days that the state or these batches have."""
        late = self.late(spark, first_batch)
        first, last = late.agg(F.min("report_date"), F.max("report_date")).first()
        if first is None:
            return late
        window = self._params.known_domains_window_days
        seen = state.sightings(first - timedelta(days=window), last + timedelta(days=1))
        marked = late.withColumn("_late", F.lit(True)).unionByName(
            seen.select(*DAY, "domain", F.lit(False).alias("_late"))
        )
        days = marked.groupBy(*DAY, "domain").agg(F.max("_late").alias("_late"))
        return novel_over_history(days, window).filter("_late").select(*DAY, "domain")

    def fold(self, spark: SparkSession, state: StateTables, out: str, first_batch: int = 0) -> None:
        """Write the alerts of the batches from one on, then add their days to the state."""
        self.alerts(spark, state, first_batch).write.mode("overwrite").parquet(out)
        state.merge_domains(self.late(spark, first_batch))
