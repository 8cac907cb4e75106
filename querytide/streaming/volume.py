"""Daily volume per client from a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.functions.scalar import local_date
from querytide.params import DAY, ReportParams


def stream_daily_volume(
    log: DataFrame, lateness: str = "1 hour", params: ReportParams = ReportParams()
) -> DataFrame:
    """Counts per client and report day, final once the watermark has passed the day.

    Windows are those of `assign_report_days`, so the counts are the batch ones. Rows later than
    the watermark are dropped here; `StateUpkeep` has no watermark and takes them in.
    """
    hours = int(params.window_hours)
    span = max(hours, 24)
    opens = (int(params.close_hour_utc) - span) % 24
    run = F.window("_time", f"{span} hours", "24 hours", f"{opens} hours")
    dated = (
        log.withColumn("_time", F.col("time").cast("timestamp"))
        .withWatermark("_time", lateness)
        .withColumn("_run", run)
    )
    if hours < 24:
        dated = dated.filter(F.col("_time") >= F.col("_run.end") - F.expr(f"INTERVAL {hours} HOURS"))
    counts = dated.groupBy("network_id", "_run", "client").agg(F.count("*").alias("query_count"))
    end = F.col("_run.end").cast("timestamp_ntz")
    return counts.withColumn("report_date", local_date(end, params.timezone)).select(
        *DAY, "client", "query_count"
    )
