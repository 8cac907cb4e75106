"""Optional inputs: a report must not depend on them being there."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.operators.devices import overlay_devices
from querytide.schemas import DEVICE_SCHEMA, FINGERPRINT_SCHEMA, INTERCEPT_SCHEMA
from querytide.sources.files import path_exists
from querytide.sources.day_tables import current_paths, replace_days

logger = logging.getLogger(__name__)

#: Unreadable files named in warnings, at most.
WARNINGS = 20


def read_optional_json(
    spark: SparkSession, path: str, schema: str, layout: str = "lines"
) -> DataFrame:
    """JSON documents under a path; no rows and a warning when there is nothing to read.

    `layout="lines"` is what `write_documents` writes, `layout="documents"` one indented
    document per file. Documents that are not JSON are left out; the files they come from are named in a warning.
    """
    if not path_exists(spark, path):
        logger.warning("optional input not found: %s", path)
        return spark.createDataFrame([], schema)
    multi_line = layout == "documents"
    paths = current_paths(spark, path) or [path]
    checked = (
        spark.read.schema(f"{schema}, _unreadable STRING")
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", "_unreadable")
        .json(paths)
    )
    # The largest row has the unreadable text if there is one; the other columns are taken along
    # because Spark does not read the corrupt ones alone.
    others = [name for name in checked.columns if name != "_unreadable"]
    largest = F.max(F.struct("_unreadable", *others)).alias("largest")
    broken = (
        checked.groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(largest)
        .filter("largest._unreadable IS NOT NULL")
    )
    for row in broken.select("file").orderBy("file").limit(WARNINGS).collect():
        logger.warning("optional input cannot be read: %s", row.file)
    return spark.read.schema(schema).option("multiLine", multi_line).json(paths)


def read_intercept_stats(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    return read_optional_json(spark, path, INTERCEPT_SCHEMA, layout)


def read_fingerprint_snapshots(
    spark: SparkSession, path: str, layout: str = "lines"
) -> DataFrame:
    return read_optional_json(spark, path, FINGERPRINT_SCHEMA, layout).fillna({"page": 0})


def read_devices(spark: SparkSession, path: str, local_path: str | None = None) -> DataFrame:
    """Device map, overlaid by an optional local one that adds to it and wins."""
    base = read_optional_json(spark, path, DEVICE_SCHEMA)
    if local_path is None:
        return base
    return overlay_devices(base, read_optional_json(spark, local_path, DEVICE_SCHEMA))


def parse_counter_listing(lines: DataFrame) -> DataFrame:
    """Captured firewall listings -> counter values.

    The input has `network_id`, `sample_time` and one `line` of a listing with exact packet
    and byte counters; lines that are not a DNS rule are headings or other rules.
    """
    rule = r"^\s*(\d+)\s+(\d+)\s.*\b(udp|tcp) dpt:53\b"

    def part(group: int):
        return F.regexp_extract("line", rule, group)

    return lines.filter(F.col("line").rlike(rule)).select(
        "network_id",
        "sample_time",
        part(3).alias("proto"),
        part(1).cast("bigint").alias("packets"),
        part(2).cast("bigint").alias("bytes"),
    )


def write_documents(docs: DataFrame, path: str, schema: str | None = None) -> None:
    """Write side-input documents; with a schema by report day, of which a later run replaces
    its own networks and dates."""
    if schema is not None:
        replace_days(docs, path, schema, file_format="json")
    else:
        docs.write.mode("overwrite").json(path)
