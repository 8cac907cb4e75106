"""Counters of queries that were redirected on their way to other resolvers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.operators.report_days import assign_report_days
from querytide.params import DAY, ReportParams

SERIES = ("network_id", "proto")


def counter_deltas(
    samples: DataFrame,
    series: Sequence[str] = SERIES,
    counters: Sequence[str] = ("packets", "bytes"),
    bucket: str = "hour",
) -> DataFrame:
    """Readings of ever-growing counters -> growth since the reading before.

    A reading below the one before means the counter was reset, so it counts in full, as
    does the first reading. A series is worked on in time buckets that each start with the
    last reading of the bucket before, so a series of any length is spread over many tasks.
    Sample times are unique within a series.
    """
    series = list(series)
    readings = samples.select(
        *series,
        "sample_time",
        *counters,
        F.date_trunc(bucket, "sample_time").alias("_bucket"),
        F.lit(False).alias("_carried"),
    )
    closing = readings.groupBy(*series, "_bucket").agg(
        *[F.max_by(c, F.unix_micros(F.col("sample_time").cast("timestamp"))).alias(c)
          for c in counters]
    )
    following = W.partitionBy(*series).orderBy("_bucket")
    carried = (
        closing.withColumn("_bucket", F.lead("_bucket").over(following))
        .filter(F.col("_bucket").isNotNull())
        .withColumn("_carried", F.lit(True))
    )
    in_bucket = W.partitionBy(*series, "_bucket").orderBy(
        F.desc("_carried"), F.asc("sample_time")
    )
    grown = readings.unionByName(carried, allowMissingColumns=True)
    for counter in counters:
        before = F.lag(counter).over(in_bucket)
        value = F.col(counter)
        grown = grown.withColumn(
            f"{counter}_delta",
            F.when(before.isNull() | (value < before), value).otherwise(value - before),
        )
    return grown.filter(~F.col("_carried")).drop("_bucket", "_carried")


def daily_growth(
    readings: DataFrame, params: ReportParams = ReportParams(), bucket: str = "hour"
) -> DataFrame:
    """Readings of ever-growing counters -> counter values of report days."""
    grown = counter_deltas(readings, bucket=bucket).select(
        *SERIES,
        "sample_time",
        F.col("sample_time").alias("time"),
        F.col("packets_delta").alias("packets"),
        F.col("bytes_delta").alias("bytes"),
    )
    return assign_report_days(grown, params).drop("time")


def intercept_stats(samples: DataFrame) -> DataFrame:
    """Per-protocol sums of a day's counter values; a protocol without samples counts 0."""

    def per_proto(proto: str, counter: str):
        return F.coalesce(
            F.sum(F.when(F.col("proto") == proto, F.col(counter))), F.lit(0)
        ).cast("bigint")

    known = samples.filter(F.col("proto").isin("udp", "tcp"))
    return (
        known.groupBy(*DAY)
        .agg(
            F.max("sample_time").alias("_latest"),
            per_proto("udp", "packets").alias("udp_queries"),
            per_proto("tcp", "packets").alias("tcp_queries"),
            per_proto("udp", "bytes").alias("_udp_bytes"),
            per_proto("tcp", "bytes").alias("_tcp_bytes"),
        )
        .select(
            *DAY,
            F.lit(True).alias("available"),
            F.date_format("_latest", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            (F.col("udp_queries") + F.col("tcp_queries")).alias("intercepted_queries"),
            (F.col("_udp_bytes") + F.col("_tcp_bytes")).alias("intercepted_bytes"),
            "udp_queries",
            "tcp_queries",
        )
    )


def intercept_gate(stats: DataFrame) -> DataFrame:
    """Drop reports without counters and reports with nothing to tell."""
    return stats.filter(
        F.coalesce("available", F.lit(False))
        & (F.coalesce("intercepted_queries", F.lit(0)) != 0)
    )


def enforcement_section(stats: DataFrame) -> DataFrame:
    counts = ("intercepted_queries", "intercepted_bytes", "udp_queries", "tcp_queries")
    note = "Queries sent past the local resolver to fixed public ones and redirected back to it."
    return intercept_gate(stats).select(
        *DAY,
        *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in counts],
        F.lit(note).alias("note"),
    )
