"""Domains that a network has not asked for lately."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.operators.devices import label_clients
from querytide.params import DAY, ReportParams


def domain_days(traffic: DataFrame, pick: str = "newest") -> DataFrame:
    """Query count and one client for every domain and day.

    Clients are counted apart first: that step stays in a hash aggregate and leaves few rows
    for the step that picks a client. `pick` chooses the client of the newest or the oldest
    query.
    """
    if pick not in ("newest", "earliest"):
        raise ValueError(f"unknown pick: {pick}")
    per_client = traffic.groupBy(*DAY, "domain", "client").agg(
        F.sum("n").alias("n"),
        (F.max("newest_key") if pick == "newest" else F.min("oldest_key")).alias("arrival"),
    )
    choose = F.max_by if pick == "newest" else F.min_by
    return per_client.groupBy(*DAY, "domain").agg(
        F.sum("n").alias("count"),
        choose("client", F.struct("arrival", "client")).alias("first_client"),
    )


def novel_over_history(
    days: DataFrame, window_days: int = ReportParams.known_domains_window_days
) -> DataFrame:
    """Keep the days on which a domain is new, for the whole history at once.

    New means never seen before, or last seen more than `window_days` days earlier. The
    input has one row per domain and day, so no group is longer than the history.
    """
    order = W.partitionBy("network_id", "domain").orderBy("report_date")
    last = F.lag("report_date").over(order)
    return (
        days.withColumn("_last", last)
        .filter(
            F.col("_last").isNull() | (F.datediff("report_date", "_last") > F.lit(window_days))
        )
        .drop("_last")
    )


def novel_against_state(
    days: DataFrame,
    known: DataFrame,
    window_days: int = ReportParams.known_domains_window_days,
) -> DataFrame:
    """Keep the domains of report days that the state of earlier days does not know."""
    seen = known.select(
        F.col("network_id").alias("_network"),
        F.col("domain").alias("_domain"),
        "last_seen",
    )
    return days.join(
        seen,
        (days["network_id"] == seen["_network"])
        & (days["domain"] == seen["_domain"])
        & (seen["last_seen"] >= F.date_sub(days["report_date"], window_days)),
        "left_anti",
    )


def novel_after_state(
    days: DataFrame,
    known: DataFrame,
    window_days: int = ReportParams.known_domains_window_days,
) -> DataFrame:
    """New domains over several days that follow on a state, in one pass.

    The state's last day takes part as an earlier sighting; a day the state already covers
    is known.
    """
    earlier = known.join(
        days.select("network_id", "domain").distinct(), ["network_id", "domain"], "left_semi"
    ).select(
        "network_id",
        F.col("last_seen").alias("report_date"),
        "domain",
        F.lit(False).alias("_sighting"),
    )
    order = W.partitionBy("network_id", "domain").orderBy("report_date", "_sighting")
    last = F.max(F.col("report_date")).over(order.rowsBetween(W.unboundedPreceding, -1))
    state_day = F.max(F.when(~F.col("_sighting"), F.col("report_date"))).over(
        W.partitionBy("network_id", "domain")
    )
    return (
        days.select(*DAY, "domain", F.lit(True).alias("_sighting"))
        .unionByName(earlier)
        .withColumns({"_last": F.greatest(last, state_day)})
        .filter(
            F.col("_sighting")
            & (
                F.col("_last").isNull()
                | (F.datediff("report_date", "_last") > F.lit(window_days))
            )
        )
        .select(*DAY, "domain")
    )


def first_sightings(traffic: DataFrame) -> DataFrame:
    """Distinct domains per report day."""
    return traffic.select(*DAY, "domain").distinct()


def upsert_known_domains(known: DataFrame, sightings: DataFrame) -> DataFrame:
    """State after the sightings: first date kept, last date moved forward, never back."""
    new = sightings.select(
        "network_id",
        "domain",
        F.col("report_date").alias("first_seen"),
        F.col("report_date").alias("last_seen"),
    )
    return (
        known.select("network_id", "domain", "first_seen", "last_seen")
        .unionByName(new)
        .groupBy("network_id", "domain")
        .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    )


def known_within(known: DataFrame, day: date | Column, window_days: int) -> DataFrame:
    """State rows still inside the window of a report day."""
    reference = day if isinstance(day, Column) else F.lit(day).cast("date")
    return known.filter(F.col("last_seen") >= F.date_sub(reference, window_days))


def new_domains(
    traffic: DataFrame,
    novel: DataFrame,
    devices: DataFrame | None = None,
    pick: str = "newest",
) -> DataFrame:
    """Counts and one client for the given new domains; blocked queries count as well."""
    return given_new_domains(domain_days(traffic, pick), novel, devices)


def new_domains_over_history(
    traffic: DataFrame,
    window_days: int = ReportParams.known_domains_window_days,
    devices: DataFrame | None = None,
    pick: str = "newest",
) -> DataFrame:
    """The same section for every day of a log without state: no join is needed."""
    return all_new_domains(domain_days(traffic, pick), window_days, devices)


def given_new_domains(
    days: DataFrame, novel: DataFrame, devices: DataFrame | None = None
) -> DataFrame:
    found = days.join(novel.select(*DAY, "domain"), [*DAY, "domain"], "left_semi")
    return _with_first_device(found, devices)


def all_new_domains(
    days: DataFrame,
    window_days: int = ReportParams.known_domains_window_days,
    devices: DataFrame | None = None,
) -> DataFrame:
    return _with_first_device(novel_over_history(days, window_days), devices)


def _with_first_device(rows: DataFrame, devices: DataFrame | None) -> DataFrame:
    labelled = label_clients(rows, devices, client="first_client", label="_label")
    return labelled.withColumn("first_client", F.col("_label")).drop("_label")
