"""Traffic frames and the sections counted from them.

A traffic frame has the keys and measures below. `as_traffic` gives one row per query;
`rollup` gives the same shape with one row per key. Every section takes either: a single
section reads the log directly, a whole report reads one rollup many times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.functions.scalar import arrival_key, in_off_hours, iso_date, local_hhmm
from querytide.operators.devices import label_clients
from querytide.params import DAY, ReportParams

ROLLUP_KEYS = (*DAY, "client", "domain", "blocked", "block_rule", "off_hours")


def as_traffic(dated_log: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    arrival = arrival_key(F.col("time"), F.col("seq"))
    return dated_log.select(
        *DAY,
        "client",
        "domain",
        "blocked",
        "block_rule",
        in_off_hours(
            F.col("time"),
            F.col("report_date"),
            params.off_hours_start,
            params.off_hours_end,
            params.timezone,
            params.wrap_off_hours,
        ).alias("off_hours"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("time").alias("first_time"),
        F.col("time").alias("last_time"),
        arrival.alias("oldest_key"),
        arrival.alias("newest_key"),
    )


def rollup(traffic: DataFrame) -> DataFrame:
    """One pass over the log that all sections can be derived from."""
    return traffic.groupBy(*ROLLUP_KEYS).agg(
        F.sum("n").alias("n"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.min("oldest_key").alias("oldest_key"),
        F.max("newest_key").alias("newest_key"),
    )


def keep_top(counts: DataFrame, group: tuple[str, ...], key: str, k: int) -> DataFrame:
    """The k largest counts of each group; ties are settled by the key.

    Spark trims every partition to k rows per group before the shuffle, so a group with a
    large share of the rows costs no more than any other.
    """
    order = W.partitionBy(*group).orderBy(F.desc("count"), F.asc(key))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def client_totals(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy(*DAY, "client").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(F.lit(0))).alias("blocked"),
    )


def domain_totals(cube: DataFrame) -> DataFrame:
    """The counts of every domain and the arrival of its newest and newest blocked query.

    Whose queries those were is looked up later, by `of_newest`, for the few domains that a
    report names; all of this is numbers and stays in a hash aggregate.
    """
    blocked = F.col("blocked")
    return cube.groupBy(*DAY, "domain").agg(
        F.sum("n").alias("count"),
        F.sum(F.when(blocked, F.lit(0)).otherwise(F.col("n"))).alias("answered"),
        F.sum(F.when(blocked, F.col("n")).otherwise(F.lit(0))).alias("blocked"),
        F.max("newest_key").alias("newest_key"),
        F.max(F.when(blocked, F.col("newest_key"))).alias("blocked_key"),
    )


def of_newest(domains: DataFrame, cube: DataFrame, key: str, value: str) -> DataFrame:
    """Add the `value` of the rollup rows with the arrival `key` to a few domains; the last by
    alphabet if there are several."""
    keys = domains.select(*DAY, "domain", F.col(key).alias("newest_key"))
    rows = cube.select(*DAY, "domain", "newest_key", value)
    picked = (
        rows.join(keys, [*DAY, "domain", "newest_key"], "left_semi")
        .groupBy(*DAY, "domain")
        .agg(F.max(value).alias(value))
    )
    return domains.join(picked, [*DAY, "domain"])


def top_answered(domains: DataFrame, k: int = ReportParams.top_domains) -> DataFrame:
    """`top_domains` from domain totals."""
    counts = domains.filter(F.col("answered") > 0).select(
        *DAY, "domain", F.col("answered").alias("count")
    )
    return keep_top(counts, DAY, "domain", k)


def top_blocked(domains: DataFrame, k: int = ReportParams.blocked_domains) -> DataFrame:
    """`blocked_domains` from domain totals, with `blocked_key` in place of the rule."""
    counts = domains.filter(F.col("blocked") > 0).select(
        *DAY, "domain", F.col("blocked").alias("count"), "blocked_key"
    )
    return keep_top(counts, DAY, "domain", k)


def summary(traffic: DataFrame) -> DataFrame:
    """Totals of a report, from the counts of its clients and the set of its domains.

    Counting both in one aggregate would make three rows of every log row; two passes of hash
    aggregates over a few columns are cheaper.
    """
    clients = client_totals(traffic).groupBy(*DAY).agg(
        F.sum("total").alias("total_queries"),
        F.count("*").alias("unique_clients"),
        F.sum("blocked").alias("total_blocked"),
    )
    domains = traffic.select(*DAY, "domain").distinct().groupBy(*DAY).agg(
        F.count("*").alias("unique_domains")
    )
    return clients.join(domains, list(DAY)).withColumn("date", iso_date(F.col("report_date")))


def summary_approx(traffic: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Opt-in summary for very large logs: distinct counts from sketches."""
    return (
        traffic.groupBy(*DAY)
        .agg(
            F.sum("n").alias("total_queries"),
            F.approx_count_distinct("client", rsd).alias("unique_clients"),
            F.approx_count_distinct("domain", rsd).alias("unique_domains"),
            F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(F.lit(0))).alias("total_blocked"),
        )
        .withColumn("date", iso_date(F.col("report_date")))
    )


def top_domains(traffic: DataFrame, k: int = ReportParams.top_domains) -> DataFrame:
    """Most queried domains that were answered."""
    counts = traffic.filter(~F.col("blocked")).groupBy(*DAY, "domain").agg(
        F.sum("n").alias("count")
    )
    return keep_top(counts, DAY, "domain", k)


def blocked_domains(traffic: DataFrame, k: int = ReportParams.blocked_domains) -> DataFrame:
    """Most blocked domains with the rule of their newest blocked query.

    Rules are counted apart first, so picking one per domain works on few rows.
    """
    per_rule = (
        traffic.filter(F.col("blocked"))
        .groupBy(*DAY, "domain", "block_rule")
        .agg(F.sum("n").alias("n"), F.max("newest_key").alias("newest_key"))
    )
    counts = per_rule.groupBy(*DAY, "domain").agg(
        F.sum("n").alias("count"),
        F.max_by("block_rule", F.struct("newest_key", "block_rule")).alias("rule"),
    )
    return keep_top(counts, DAY, "domain", k)


def per_client(traffic: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    return label_clients(client_totals(traffic), devices)


def client_top_domains(
    traffic: DataFrame, k: int = ReportParams.client_top_domains
) -> DataFrame:
    """Most queried answered domains of every client, in one pass for all clients."""
    counts = traffic.filter(~F.col("blocked")).groupBy(*DAY, "client", "domain").agg(
        F.sum("n").alias("count")
    )
    return keep_top(counts, (*DAY, "client"), "domain", k)


def off_hours_counts(traffic: DataFrame) -> DataFrame:
    """Off-hours queries per client and domain, blocked ones included."""
    return (
        traffic.filter(F.col("off_hours"))
        .groupBy(*DAY, "client", "domain")
        .agg(
            F.sum("n").alias("count"),
            F.bool_or("blocked").alias("blocked"),
            F.min("first_time").alias("first_time"),
            F.max("last_time").alias("last_time"),
        )
    )


def off_hours_domains(traffic: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    top = keep_top(
        off_hours_counts(traffic), (*DAY, "client"), "domain", params.off_hours_top_domains
    )
    return top.select(
        *DAY,
        "client",
        "rank",
        "domain",
        "count",
        "blocked",
        local_hhmm(F.col("first_time"), params.timezone).alias("first_seen_local"),
        local_hhmm(F.col("last_time"), params.timezone).alias("last_seen_local"),
    )


def off_hours_devices(traffic: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Off-hours total per client over all of its domains, not only the listed ones."""
    totals = (
        traffic.filter(F.col("off_hours"))
        .groupBy(*DAY, "client")
        .agg(F.sum("n").alias("total"))
    )
    return label_clients(totals, devices)


def off_hours_totals(traffic: DataFrame) -> DataFrame:
    return (
        traffic.filter(F.col("off_hours"))
        .groupBy(*DAY)
        .agg(F.sum("n").alias("total_queries"))
    )
