"""Which queries belong to which report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.scalar import local_date, utc_literal
from querytide.params import ReportParams
from querytide.session import pin_utc


def trailing_window(log: DataFrame, now: datetime | Column, hours: int) -> DataFrame:
    """Rows of the last `hours` hours: low end inclusive, no upper bound."""
    end = now if isinstance(now, Column) else utc_literal(now)
    return log.filter(F.col("time") >= end - F.expr(f"INTERVAL {int(hours)} HOURS"))


def assign_report_days(log: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """The trailing window of every daily run at once.

    Each run closes at the same UTC hour. Up to 24 hours a row falls in at most one window;
    longer windows slide, so a row is repeated once per report that sees it.
    """
    pin_utc(log.sparkSession)
    hours = int(params.window_hours)
    span = max(hours, 24)
    opens = (int(params.close_hour_utc) - span) % 24
    dated = log.withColumn(
        "_run", F.window("time", f"{span} hours", "24 hours", f"{opens} hours")
    )
    if hours < 24:
        dated = dated.filter(F.col("time") >= F.col("_run.end") - F.expr(f"INTERVAL {hours} HOURS"))
    return dated.withColumn(
        "report_date", local_date(F.col("_run.end"), params.timezone)
    ).drop("_run")


def single_report(
    log: DataFrame, now: datetime, report_date: Column, params: ReportParams = ReportParams()
) -> DataFrame:
    """The trailing window of one run, labelled with its report date.

    Rows at or after `now` belong to the next run, so that a run repeated later gives the
    same report.
    """
    pin_utc(log.sparkSession)
    return (
        trailing_window(log, now, params.window_hours)
        .filter(F.col("time") < utc_literal(now))
        .withColumn("report_date", report_date)
    )


def report_calendar(
    days: DataFrame, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """All report days of each network, including the ones without a single query.

    By default from a network's first to its last day; give the range when rows with wrong
    clocks may stretch it.
    """
    span = days.groupBy("network_id").agg(
        F.min("report_date").alias("_first"), F.max("report_date").alias("_last")
    )
    first = F.col("_first") if start is None else start
    last = F.col("_last") if end is None else end
    return span.select("network_id", F.explode(F.sequence(first, last)).alias("report_date"))
