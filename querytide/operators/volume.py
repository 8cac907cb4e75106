"""Daily volume per client, its trailing baseline and the days that stand out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.functions.scalar import is_anomalous, z_score
from querytide.operators.devices import label_clients
from querytide.params import DAY, ReportParams


def _population_stddev(counts: str, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """Population deviation from exact sums of integers.

    Adding up floating-point squares gives results that depend on the order of the rows,
    which would decide at random about clients exactly on the limit.
    """
    value = F.col(counts).cast("decimal(19,0)")
    days = over(F.count(counts))
    total = over(F.sum(value))
    squares = over(F.sum((value * value).cast("decimal(38,0)")))
    spread = (days * squares - total * total).cast("double")
    return F.when(days > 0, F.sqrt(spread) / days).otherwise(F.lit(0.0))


def daily_volume(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy(*DAY, "client").agg(F.sum("n").alias("query_count"))


def upsert_daily_volume(volumes: DataFrame, today: DataFrame) -> DataFrame:
    """State after a run: its counts replace earlier ones of the same client and day."""
    keys = [*DAY, "client"]
    old = volumes.select(*keys, "query_count", F.lit(0).alias("_run"))
    new = today.select(*keys, "query_count", F.lit(1).alias("_run"))
    return (
        old.unionByName(new)
        .groupBy(*keys)
        .agg(F.max_by("query_count", "_run").alias("query_count"))
    )


def with_trailing_baseline(
    volumes: DataFrame, baseline_days: int = ReportParams.volume_baseline_days
) -> DataFrame:
    """Mean, deviation and day count of the days before each day, for all days at once.

    Days without queries are absent, not zero. One group holds one client's days.
    """
    frame = (
        W.partitionBy("network_id", "client")
        .orderBy(F.unix_date("report_date"))
        .rangeBetween(-int(baseline_days), -1)
    )
    return volumes.select(
        "*",
        F.avg("query_count").over(frame).alias("mean"),
        _population_stddev("query_count", lambda c: c.over(frame)).alias("stddev"),
        F.count("query_count").over(frame).alias("days"),
    )


def trailing_baseline(
    volumes: DataFrame, baseline_days: int = ReportParams.volume_baseline_days
) -> DataFrame:
    """Baseline rows of every day that has at least one earlier day in the window."""
    return (
        with_trailing_baseline(volumes, baseline_days)
        .filter(F.col("days") > 0)
        .select(*DAY, "client", "mean", "stddev", "days")
    )


def baseline_for_date(
    volumes: DataFrame,
    reference: date | Column,
    baseline_days: int = ReportParams.volume_baseline_days,
) -> DataFrame:
    """Baseline of one report date; the date range prunes partitions of the state table."""
    day = reference if isinstance(reference, Column) else F.lit(reference).cast("date")
    return (
        volumes.filter(
            (F.col("report_date") >= F.date_sub(day, baseline_days)) & (F.col("report_date") < day)
        )
        .groupBy("network_id", "client")
        .agg(
            F.avg("query_count").alias("mean"),
            _population_stddev("query_count").alias("stddev"),
            F.count("query_count").alias("days"),
        )
        .select("network_id", day.alias("report_date"), "client", "mean", "stddev", "days")
    )


def with_baseline(volumes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Today's counts next to a given baseline; clients without one are left out."""
    return volumes.join(baseline, [*DAY, "client"], "inner")


def volume_anomalies(
    compared: DataFrame,
    devices: DataFrame | None = None,
    params: ReportParams = ReportParams(),
) -> DataFrame:
    """Clients whose count stands out; decided on exact values, reported rounded."""
    n, mean, stddev = F.col("query_count"), F.col("mean"), F.col("stddev")
    flagged = compared.filter(
        (F.col("days") > 0)
        & is_anomalous(n, mean, stddev, params.anomaly_z, params.anomaly_ratio)
    ).select(
        *DAY,
        "client",
        n.alias("today_count"),
        F.round(mean, 1).alias("baseline_mean"),
        F.round(stddev, 1).alias("baseline_stddev"),
        F.round(z_score(n, mean, stddev), 2).alias("z_score"),
        F.col("days").alias("baseline_days"),
    )
    return label_clients(flagged, devices)
