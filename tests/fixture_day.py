"""A day of our own making in a network seven zones east, written as a list of spells.

A spell is one client asking for one domain, so many times, from a first moment on, with a fixed
pause. All numbers that the tests expect follow from this table by counting.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from querytide.params import ReportParams

DAY = date(2025, 11, 16)
PARAMS = ReportParams(timezone="Asia/Kolkata", off_hours_start="00:30", off_hours_end="04:30")
TOTAL = 478
DEVICES = {
    "10.7.0.2": "Printer",
    "10.7.0.3": "Tablet",
    "10.7.0.4": "Console",
    "10.7.0.5": "Server",
    "10.7.0.6": "Speaker",
}
# One far above, one far below, one that is flagged for its ratio only, two that are ordinary.
BASELINE = {
    "10.7.0.4": (40.0, 8.0, 9),
    "10.7.0.5": (160.0, 16.0, 11),
    "10.7.0.6": (12.0, 50.0, 3),
    "10.7.0.3": (100.0, 20.0, 12),
    "10.7.0.2": (24.0, 0.0, 5),
}
NEW = ["beacon.odd.example", "fresh.gadget.example"]

# Client, domain, queries, first moment (UTC), seconds between, blocking rule.
SPELLS = [
    ("10.7.0.2", "ink.paperworks.example", 24, "2025-11-16 04:00:00", 1800, ""),
    ("10.7.0.3", "news.daily.example", 61, "2025-11-16 03:10:00", 97, ""),
    ("10.7.0.3", "maps.roads.example", 33, "2025-11-16 05:40:00", 211, ""),
    ("10.7.0.3", "ads.banner.example", 17, "2025-11-16 06:00:00", 333, "||banner.example^"),
    ("10.7.0.4", "play.arena.example", 118, "2025-11-16 12:00:00", 41, ""),
    ("10.7.0.4", "chat.arena.example", 46, "2025-11-16 12:05:00", 90, ""),
    ("10.7.0.5", "mirror.depot.example", 75, "2025-11-15 19:20:00", 160, ""),
    ("10.7.0.5", "beacon.odd.example", 9, "2025-11-15 20:00:00", 700, ""),
    ("10.7.0.5", "telemetry.maker.example", 28, "2025-11-15 18:45:00", 600, "||maker.example^$important"),
    ("10.7.0.6", "music.stream.example", 52, "2025-11-16 10:00:00", 240, ""),
    ("10.7.0.7", "time.pool.example", 13, "2025-11-15 21:15:00", 3600, ""),
    ("10.7.0.7", "fresh.gadget.example", 2, "2025-11-16 07:00:00", 45, ""),
]


def queries(spark):
    spells = spark.createDataFrame(
        SPELLS, "client string, domain string, n int, first string, pause int, rule string"
    )
    moment = F.col("first").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.col("k") * F.col("pause")).cast("decimal(18,6)")
    )
    every = spells.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return every.select(F.lit("flat7").alias("network_id"), moment.alias("time"), "client", "domain", "rule")


def entries(spark):
    """The queries in the resolver's form."""
    return queries(spark).select(
        "network_id",
        "time",
        F.struct(
            "client",
            F.struct(F.col("domain").alias("name"), F.lit("HTTPS").alias("type")).alias("question"),
            F.when(F.col("rule") == "", "NotFilteredNotFound").otherwise("FilteredCustom").alias("reason"),
            "rule",
            F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        ).alias("entry"),
    )


def page_texts(spark):
    """The day as captured pages of three hours, each newest first."""
    spans = entries(spark).groupBy("network_id", F.window("time", "3 hours").alias("span"))
    rows = F.reverse(F.sort_array(F.collect_list(F.struct("time", "entry"))))
    page = F.struct(
        F.transform("rows", lambda row: row["entry"]).alias("data"),
        F.element_at("rows", -1)["entry"]["time"].alias("oldest"),
    )
    return spans.agg(rows.alias("rows")).select("network_id", F.to_json(page).alias("page"))


def log(spark):
    from querytide.sources.pages import log_rows, pages_from_text, parse_entries

    return log_rows(parse_entries(pages_from_text(page_texts(spark)))).withColumn(
        "report_date", F.lit(DAY)
    )


def devices(spark):
    return spark.createDataFrame(
        [("flat7", ip, name) for ip, name in DEVICES.items()],
        "network_id string, ip string, device string",
    )


def baseline(spark):
    return spark.createDataFrame(
        [("flat7", DAY, ip, *values) for ip, values in BASELINE.items()],
        "network_id string, report_date date, client string, mean double, stddev double, "
        "days bigint",
    )


def novel(spark):
    return spark.createDataFrame(
        [("flat7", DAY, name) for name in NEW],
        "network_id string, report_date date, domain string",
    )
