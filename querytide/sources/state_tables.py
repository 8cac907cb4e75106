"""Cross-day state as Parquet: which domains each report saw, and daily volumes.

Both tables hold one entry per report, and a run replaces its own reports only. What is known on
a date is derived from the days before it, so a late or repeated run of an older day counts from
then on, and networks can be run apart.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.operators.volume import upsert_daily_volume
from querytide.params import DAY, ReportParams
from querytide.schemas import DAILY_VOLUME_SCHEMA, SIGHTING_SCHEMA
from querytide.sources.day_tables import DayChange, clean_days, read_days, stage_days


class StateTables:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self._sightings = f"{root.rstrip('/')}/sightings"
        self._volumes = f"{root.rstrip('/')}/daily_volume"

    def known_domains(self, before: date, window_days: int | None = None) -> DataFrame:
        """Domains seen before a report date, or only in the window before it.

        With a window only its dates are read, and `first_seen` is the first day inside it.
        """
        seen = self._read(self._sightings, SIGHTING_SCHEMA, before, window_days).filter(
            F.col("domain").isNotNull()
        )
        return seen.groupBy("network_id", "domain").agg(
            F.min("report_date").alias("first_seen"), F.max("report_date").alias("last_seen")
        )

    def sightings(self, since: date, before: date) -> DataFrame:
        """Domains of the report days from one date up to another."""
        days = (before - since).days
        seen = self._read(self._sightings, SIGHTING_SCHEMA, before, days)
        return seen.filter(F.col("domain").isNotNull()).select(*DAY, "domain")

    def merge_domains(self, sightings: DataFrame) -> None:
        """Add sightings to the reports they belong to, whose own are kept."""
        days = sightings.select(*DAY).distinct()
        first, last = days.agg(F.min("report_date"), F.max("report_date")).first()
        if first is None:
            return
        old = self.sightings(first, last + timedelta(days=1)).join(days, list(DAY), "left_semi")
        self.record_domains(old.unionByName(sightings.select(*DAY, "domain")))

    def record_domains(self, sightings: DataFrame, reports: DataFrame | None = None) -> None:
        """Replace the sightings of the given reports, by default of those that have any."""
        self.stage_domains(sightings, reports).publish()

    def stage_domains(self, sightings: DataFrame, reports: DataFrame | None = None) -> DayChange:
        """The same, written but not yet published."""
        rows = sightings.select("network_id", "domain", "report_date").distinct()
        return self._stage(rows, self._sightings, SIGHTING_SCHEMA, reports)

    def daily_volume(
        self, before: date, baseline_days: int | None = ReportParams.volume_baseline_days
    ) -> DataFrame:
        """Volumes of the baseline days, or of all earlier days; only their folders are read."""
        return self._read(self._volumes, DAILY_VOLUME_SCHEMA, before, baseline_days).filter(
            F.col("client").isNotNull()
        )

    def record_volume(self, volumes: DataFrame, reports: DataFrame | None = None) -> None:
        """Replace the counts of the given reports, by default of those that have any."""
        rows = volumes.select("network_id", "client", "query_count", "report_date")
        self._stage(rows, self._volumes, DAILY_VOLUME_SCHEMA, reports).publish()

    def merge_volume(self, volumes: DataFrame) -> None:
        """Like `record_volume`, but clients absent from this run keep their counts."""
        days = volumes.select(*DAY).distinct()
        old = read_days(self._spark, self._volumes, DAILY_VOLUME_SCHEMA)
        old = old.filter(F.col("client").isNotNull()).join(days, list(DAY), "left_semi")
        self.record_volume(upsert_daily_volume(old, volumes))

    def clean(self, keep: int = 10) -> None:
        """Delete what runs have replaced, but for the newest states."""
        for path in (self._sightings, self._volumes):
            clean_days(self._spark, path, keep)

    def _read(self, path: str, schema: str, before: date, days: int | None) -> DataFrame:
        since = None if days is None else before - timedelta(days=days)
        return read_days(self._spark, path, schema, since=since, before=before)

    def _stage(
        self, rows: DataFrame, path: str, schema: str, reports: DataFrame | None
    ) -> DayChange:
        if reports is not None:
            rows = rows.join(reports.select(*DAY).distinct(), list(DAY), "left_semi")
        return stage_days(rows, path, schema, reports)
