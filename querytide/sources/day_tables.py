"""Tables of report days, replaced network by network, that several runs may write.

A run writes the folders it replaces anew, below a folder of its own, and then publishes a
manifest: which run's folder holds each report date and network bucket. Publishing the next
number is the one step that changes a table. A run that fails before it changes nothing; of two
runs that publish the same number one is refused, takes the other's manifest and, if that has
replaced a folder that it has itself, merges again.
"""

from __future__ import annotations

import json
import uuid
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.params import DAY
from querytide.session import write_and_read
from querytide.sources.files import delete_folder, matching_names, publish_file

BUCKETS = 16
FOLDERS = ("report_date", "network_bucket")
MANIFEST_SCHEMA = "report_date DATE, network_bucket INT, commit STRING"

Slots = dict[tuple[date, int], str]


def network_bucket():
    return F.pmod(F.xxhash64("network_id"), F.lit(BUCKETS)).cast("int")


def current_slots(spark: SparkSession, path: str) -> tuple[int, Slots]:
    """The newest manifest: its number, and the run that wrote each date and bucket."""
    names = matching_names(spark, f"{path}/_manifest/v*.json")
    if not names:
        return 0, {}
    rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/_manifest/{names[-1]}").collect()
    return int(names[-1][1:-5]), {(r.report_date, r.network_bucket): r.commit for r in rows}


def current_paths(spark: SparkSession, path: str) -> list[str]:
    """Folders with a table's current rows."""
    return _paths(path, current_slots(spark, path)[1])


def _paths(path: str, slots: Slots) -> list[str]:
    return [
        f"{path}/commit={commit}/report_date={day}/network_bucket={bucket}"
        for (day, bucket), commit in sorted(slots.items())
    ]


def read_days(
    spark: SparkSession,
    path: str,
    schema: str,
    file_format: str = "parquet",
    since: date | None = None,
    before: date | None = None,
) -> DataFrame:
    """The rows of a table, none if it was never written; only folders of the dates are opened."""
    slots = {
        (day, bucket): commit
        for (day, bucket), commit in current_slots(spark, path)[1].items()
        if (since is None or day >= since) and (before is None or day < before)
    }
    return _read(spark, path, slots, schema, file_format)


def _read(spark: SparkSession, path: str, slots: Slots, schema: str, file_format: str) -> DataFrame:
    if not slots:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(f"{schema}, network_bucket INT, commit STRING").format(file_format)
    return reader.option("basePath", path).load(_paths(path, slots)).drop("network_bucket", "commit")


class DayChange:
    """A replacement of reports that is written but not yet published."""

    def __init__(self, rows: DataFrame, path: str, schema: str, reports: DataFrame | None, file_format: str) -> None:
        self._spark, self._path, self._schema, self._format = rows.sparkSession, path, schema, file_format
        self._rows = write_and_read(rows, "days")
        asked = self._rows if reports is None else reports.select(*DAY).unionByName(self._rows.select(*DAY))
        asked = asked.select(*DAY).distinct().withColumn("network_bucket", network_bucket())
        self._asked = write_and_read(asked, "asked-reports")
        self._touched = {
            (r.report_date, r.network_bucket) for r in self._asked.select(*FOLDERS).distinct().collect()
        }
        self._stage()

    def _stage(self) -> None:
        """Write the new rows and, of the folders they go to, the other reports' rows."""
        self._version, self._slots = current_slots(self._spark, self._path)
        held = {slot: commit for slot, commit in self._slots.items() if slot in self._touched}
        rows = self._rows.withColumn("network_bucket", network_bucket())
        if held:
            old = _read(self._spark, self._path, held, self._schema, self._format)
            old = old.join(self._asked, list(DAY), "left_anti").withColumn("network_bucket", network_bucket())
            rows = write_and_read(rows.unionByName(old, allowMissingColumns=True), "kept-days")
        self._filled = {(r.report_date, r.network_bucket) for r in rows.select(*FOLDERS).distinct().collect()}
        self._commit = uuid.uuid4().hex
        if self._filled:
            rows.hint("rebalance", *FOLDERS).write.partitionBy(*FOLDERS).format(self._format).save(
                f"{self._path}/commit={self._commit}"
            )

    def publish(self) -> None:
        """Make the change the table's next state, on top of what other runs have published since."""
        while self._touched:
            slots = {slot: commit for slot, commit in self._slots.items() if slot not in self._touched}
            slots |= dict.fromkeys(self._filled, self._commit)
            lines = [
                json.dumps({"report_date": str(day), "network_bucket": bucket, "commit": commit})
                for (day, bucket), commit in sorted(slots.items())
            ]
            name = f"{self._path}/_manifest/v{self._version + 1:012d}.json"
            if publish_file(self._spark, name, "\n".join(lines)):
                return
            version, newer = current_slots(self._spark, self._path)
            if any(newer.get(slot) != self._slots.get(slot) for slot in self._touched):
                self._stage()
            else:
                self._version, self._slots = version, newer


def stage_days(
    rows: DataFrame, path: str, schema: str, reports: DataFrame | None = None, file_format: str = "parquet"
) -> DayChange:
    """Prepare to replace what a table has on the given reports, and nothing else.

    `reports` lists networks and dates; by default those that occur in the rows. A report without
    rows has none any more. Nothing changes until the change is published.
    """
    return DayChange(rows, path.rstrip("/"), schema, reports, file_format)


def replace_days(
    rows: DataFrame, path: str, schema: str, reports: DataFrame | None = None, file_format: str = "parquet"
) -> None:
    """Replace reports at once. Repeating a run gives the same table."""
    stage_days(rows, path, schema, reports, file_format).publish()


def clean_days(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Delete manifests but the newest `keep`, and folders that none of these names.

    For times without a run under way: what a run has staged is not yet named.
    """
    names = matching_names(spark, f"{path}/_manifest/v*.json")
    kept = names[-keep:]
    if not kept:
        return
    manifests = [spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/_manifest/{name}") for name in kept]
    used = reduce(DataFrame.unionByName, manifests).select("commit").distinct()
    current = {f"commit={row.commit}" for row in used.collect()}
    for name in names[:-keep]:
        delete_folder(spark, f"{path}/_manifest/{name}")
    for name in matching_names(spark, f"{path}/commit=*"):
        if name not in current:
            delete_folder(spark, f"{path}/{name}")
