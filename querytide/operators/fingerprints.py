"""Operating-system fingerprints of devices and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.functions.scalar import os_label
from querytide.operators.devices import label_clients
from querytide.operators.paging import paginate
from querytide.params import DAY, ReportParams

DEVICE_FIELDS = (
    "ip",
    "first_seen",
    "last_seen",
    "os",
    "http_os",
    "distance_hops",
    "uptime_min",
    "link_type",
)
CHANGE_FIELDS = ("ip", "detected_at", "previous_os", "current_os")
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def device_profiles(fingerprints: DataFrame) -> DataFrame:
    """Raw fingerprint rows -> profile rows with readable system names."""
    link = F.col("link_type") if "link_type" in fingerprints.columns else F.lit(None)
    return fingerprints.select(
        *DAY,
        "ip",
        F.date_format("first_seen", TIME_FORMAT).alias("first_seen"),
        F.date_format("last_seen", TIME_FORMAT).alias("last_seen"),
        os_label(F.col("os_name"), F.col("os_flavor")).alias("os"),
        F.coalesce("http_name", F.lit("")).alias("http_os"),
        F.col("distance").cast("int").alias("distance_hops"),
        F.col("uptime_min").cast("int").alias("uptime_min"),
        link.cast("string").alias("link_type"),
    )


def latest_changes(changes: DataFrame, k: int = ReportParams.fingerprint_changes) -> DataFrame:
    """The last k changes of each report, newest first."""
    newest = W.partitionBy(*DAY).orderBy(
        F.desc("detected_at"), "ip", "previous_os", "current_os"
    )
    return (
        changes.withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= k)
        .select(
            *DAY,
            "rank",
            "ip",
            F.date_format("detected_at", TIME_FORMAT).alias("detected_at"),
            "previous_os",
            "current_os",
        )
    )


def fingerprint_snapshot(
    fingerprints: DataFrame,
    changes: DataFrame,
    k: int = ReportParams.fingerprint_changes,
    page_size: int = ReportParams.page_size,
) -> DataFrame:
    """One snapshot document per report and `page_size` devices, the newest ones first."""
    newest = -F.unix_seconds(F.col("last_seen").cast("timestamp"))
    device_rows = paginate(
        device_profiles(fingerprints), DAY, [newest, F.col("ip")], page_size
    ).select(
        *DAY,
        "page",
        F.struct(
            F.col("rank").alias("order"), F.struct(*DEVICE_FIELDS).alias("entry")
        ).alias("device_row"),
    )
    change_rows = latest_changes(changes, k).select(
        *DAY,
        F.lit(0).cast("bigint").alias("page"),
        F.struct(F.col("rank").alias("order"), F.struct(*CHANGE_FIELDS).alias("entry")).alias(
            "change_row"
        ),
    )
    return (
        device_rows.unionByName(change_rows, allowMissingColumns=True)
        .groupBy(*DAY, "page")
        .agg(
            F.lit(True).alias("available"),
            _entries("device_row").alias("devices"),
            _entries("change_row").alias("recent_changes"),
        )
    )


def snapshot_gate(snapshots: DataFrame) -> DataFrame:
    """Drop snapshots that are not available or have no device."""
    return snapshots.filter(F.coalesce("available", F.lit(False)) & (F.size("devices") > 0))


def profile_section(snapshots: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Add device names to every profile and change of the snapshots, keeping their order."""
    usable = snapshot_gate(snapshots)
    keys = [*DAY, "page"]

    def labelled(column: str, fields: tuple[str, ...], row: str) -> DataFrame:
        exploded = usable.select(*keys, F.posexplode(column).alias("order", "entry")).select(
            *keys, "order", "entry.*"
        )
        return label_clients(exploded, devices, client="ip").select(
            *keys,
            F.struct("order", F.struct(*fields, "device").alias("entry")).alias(row),
        )

    rows = labelled("devices", DEVICE_FIELDS, "device_row").unionByName(
        labelled("recent_changes", CHANGE_FIELDS, "change_row"), allowMissingColumns=True
    )
    note = (
        "System names are guessed from passive traffic fingerprints. A change of system can be "
        "an update, a reused address or something to look into."
    )
    return rows.groupBy(*keys).agg(
        _entries("device_row").alias("devices"),
        _entries("change_row").alias("recent_changes"),
        F.lit(note).alias("note"),
    )


def _entries(row: str):
    return F.transform(F.sort_array(F.collect_list(row)), lambda x: x["entry"])
