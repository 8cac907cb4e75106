"""The parsed log as Parquet by load and UTC date, so that a report reads only its own days."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.functions.scalar import as_utc, utc_literal
from querytide.schemas import LOG_COLUMNS, LOG_SCHEMA


def write_log(log: DataFrame, path: str, load: str) -> None:
    """Add a load to the log. Repeating a load replaces its own rows whole and no others.

    A load is a folder of its own, so dates that a repeated load no longer has are gone. Writing
    by date sorts the rows anyway; sorting by network and time as well lets readers skip row
    groups.
    """
    dated = log.select(*LOG_COLUMNS, F.col("time").cast("date").alias("log_date"))
    ordered = dated.hint("rebalance", "log_date").sortWithinPartitions(
        "log_date", "network_id", "time"
    )
    ordered.write.mode("overwrite").partitionBy("log_date").parquet(
        f"{path.rstrip('/')}/load={load}"
    )


def read_log(
    spark: SparkSession,
    path: str,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Rows of a time range, low end inclusive; folders of other dates are not opened."""
    log = spark.read.schema(f"{LOG_SCHEMA}, log_date DATE, load STRING").parquet(path)
    if since is not None:
        log = log.filter(
            (F.col("log_date") >= F.lit(as_utc(since).date()))
            & (F.col("time") >= utc_literal(since))
        )
    if until is not None:
        last = (as_utc(until) - timedelta(microseconds=1)).date()
        log = log.filter(
            (F.col("log_date") <= F.lit(last)) & (F.col("time") < utc_literal(until))
        )
    return log.select(*LOG_COLUMNS)
