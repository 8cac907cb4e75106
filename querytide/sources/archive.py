"""Finished reports and packets by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.functions.scalar import long_date, storage_key
from querytide.operators.messages import packet_json
from querytide.params import DAY
from querytide.schemas import PACKET_STRUCT
from querytide.sources.day_tables import read_days, replace_days

REPORT_SCHEMA = "network_id STRING, page BIGINT, report STRING, report_date DATE"
PACKET_SCHEMA = f"network_id STRING, page BIGINT, packet {PACKET_STRUCT}, report_date DATE"


def write_reports(reports: DataFrame, path: str) -> None:
    """Archive report texts; writing a network's date again replaces it.

    Reports of very large networks come in pages; others have the single page 0.
    """
    page = F.col("page") if "page" in reports.columns else F.lit(0)
    replace_days(
        reports.select(
            "network_id", page.cast("bigint").alias("page"), "report", "report_date"
        ),
        path,
        REPORT_SCHEMA,
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return read_days(spark, path, REPORT_SCHEMA)


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report of every network.

    The newest dates are found without reading the texts. They are one row per network, so
    as long as Spark can broadcast them the texts stay where they are.
    """
    newest = reports.groupBy("network_id").agg(F.max("report_date").alias("report_date"))
    return reports.join(newest, list(DAY), "left_semi")


def archive_index(reports: DataFrame) -> DataFrame:
    """Archived dates with their storage key and display date, newest first."""
    return (
        reports.select(*DAY)
        .distinct()
        .select(
            *DAY,
            storage_key(F.col("report_date")).alias("storage_key"),
            long_date(F.col("report_date")).alias("display_date"),
        )
        .orderBy(F.desc("report_date"), "network_id")
    )


def read_dated_files(spark: SparkSession, path: str, suffix: str = "md") -> DataFrame:
    """Whole report files named by date in a flat folder; other files are ignored."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.", 1)
    return (
        spark.read.option("pathGlobFilter", f"????-??-??.{suffix}")
        .text(path, wholetext=True)
        .select(stem.try_cast("date").alias("report_date"), F.col("value").alias("report"))
        .filter(F.col("report_date").isNotNull())
    )


def dated_file_index(spark: SparkSession, path: str, suffix: str = "md") -> DataFrame:
    """Names and dates of the report files, newest first; contents are not read."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"????-??-??.{suffix}")
        .load(path)
        .select(name.alias("file_name"), name.substr(1, 10).try_cast("date").alias("report_date"))
        .filter(F.col("report_date").isNotNull())
        .orderBy(F.desc("report_date"))
    )


def write_packets(packets: DataFrame, path: str) -> None:
    """Packets as JSON lines by report date."""
    rows = packets.select("network_id", "page", "packet", "report_date")
    replace_days(rows, path, PACKET_SCHEMA, file_format="json")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return read_days(spark, path, PACKET_SCHEMA, "json")


def packet_documents(packets: DataFrame) -> DataFrame:
    """Packets as indented JSON text."""
    return packets.select(*DAY, "page", packet_json().alias("packet_json"))
