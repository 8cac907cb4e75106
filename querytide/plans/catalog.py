"""Every operator as a query over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querytide.functions.scalar import utc_literal
from querytide.operators import (
    devices,
    enforcement,
    fingerprints,
    messages,
    novelty,
    panes,
    report_days,
    traffic,
    volume,
)
from querytide.params import DAY, ReportParams
from querytide.plans import bindings as b
from querytide.plans import packet, reports
from querytide.plans.daily import run_report
from querytide.session import pin_utc, scratch_path, write_and_read
from querytide.sources import archive, pages
from querytide.sources.log_store import read_log, write_log
from querytide.sources.side_inputs import (
    parse_counter_listing,
    read_fingerprint_snapshots,
    read_intercept_stats,
    write_documents,
)
from querytide.sources.state_tables import StateTables
from querytide.streaming import novelty as novelty_stream
from querytide.streaming import volume as volume_stream
from querytide.streaming.files import append_available, log_stream
from querytide.streaming.late import LateDomains
from querytide.streaming.upkeep import StateUpkeep

PARAMS = ReportParams()
WRAPPED = replace(PARAMS, off_hours_start="22:00", wrap_off_hours=True)
REPORT_DATE = date(2024, 1, 20)
RUN_TIME = datetime(2024, 1, 20, 15)
NOVELTY_DAYS = 7

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# Log rows.


@query
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry as a captured page of its own, parsed back."""
    captured = b.raw_entries(b.event_log(spark, sf_dir)).select(
        "network_id", "seq", F.to_json(F.struct(F.array("entry").alias("data"))).alias("page")
    )
    return pages.log_rows(pages.parse_entries(pages.pages_from_text(captured, number="seq")))


@query
def log_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with planted faults, counted by fault."""
    value, kind = F.col("value"), F.col("event_type")
    log = b.events_as_log(b.table(spark, sf_dir, "events"), "value", "event_type")
    raw = log.select(
        "network_id",
        "seq",
        "client",
        F.struct(
            F.when(value >= 2, F.col("domain")).alias("name"),
            F.when((kind != "signup") | (value < 60), F.col("query_type")).alias("type"),
        ).alias("question"),
        "reason",
        F.col("block_rule").alias("rule"),
        F.when((kind == "error") & (value > 40), "not a time")
        .when(kind != "view", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(value < 50, F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .alias("time"),
    )
    rejected = pages.rejected_rows(pages.parse_entries(raw))
    return rejected.groupBy("network_id", "reject_reason").agg(F.count("*").alias("entries"))


@query
def pages_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as pages of at most 1000 entries, read back from all folders at once."""
    path = scratch_path(spark, "pages")
    entries = b.raw_entries(b.event_log(spark, sf_dir))
    page = entries.groupBy("network_id", F.floor(F.col("seq") / 1000).alias("page")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "entry"))), lambda row: row["entry"]
        ).alias("data")
    )
    page.select(
        "network_id", "data", F.element_at("data", -1)["time"].alias("oldest")
    ).write.partitionBy("network_id").json(path)
    raw = pages.read_pages(spark, path, layout="lines")
    return pages.log_rows(pages.parse_entries(raw))


@query
def pages_arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of whole days at one time, in pages of 70 and of 3000 that end at the same moment."""
    log = b.event_log(spark, sf_dir).withColumn("time", F.date_trunc("day", "time").cast("timestamp_ntz"))
    newest_first = Window.partitionBy("network_id").orderBy(F.desc("time"), "seq")
    size = F.when(F.col("network_id") == "net0", 3000).otherwise(70)
    entries = b.raw_entries(log).join(
        log.select("network_id", "seq", (F.row_number().over(newest_first) - 1).alias("place")), ["network_id", "seq"]
    )
    captured = (
        entries.groupBy("network_id", F.floor(F.col("place") / size).alias("number"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "entry"))).alias("rows"))
        .select("network_id", "number", F.to_json(F.struct(F.col("rows.entry").alias("data"))).alias("page"))
    )
    return pages.log_rows(pages.parse_entries(pages.pages_from_text(captured, number="number")))


@query
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_days.trailing_window(b.event_log(spark, sf_dir), RUN_TIME, PARAMS.window_hours)


@query
def report_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per report for daily runs that look back 12 to 48 hours."""
    log = b.event_log(spark, sf_dir)
    counts = [
        report_days.assign_report_days(log, replace(PARAMS, window_hours=hours))
        .groupBy(*DAY)
        .agg(F.count("*").alias("total_queries"))
        .withColumn("window_hours", F.lit(hours))
        for hours in (12, 24, 36, 48)
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def log_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written in two loads, one of them twice, and one report's window read back."""
    path = scratch_path(spark, "log")
    log = b.event_log(spark, sf_dir)
    early = F.col("time") < utc_literal(RUN_TIME - timedelta(hours=12))
    write_log(log.filter(early), path, "first")
    for _ in range(2):
        write_log(log.filter(~early), path, "second")
    return read_log(spark, path, RUN_TIME - timedelta(hours=PARAMS.window_hours), RUN_TIME)


@query
def log_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load written again without its later days has those days no more."""
    path = scratch_path(spark, "log")
    log = b.event_log(spark, sf_dir)
    early = F.col("time") < utc_literal(RUN_TIME)
    write_log(log, path, "first")
    write_log(log.filter(F.col("blocked")), path, "second")
    write_log(log.filter(early), path, "first")
    return read_log(spark, path)


# Report sections.


@query
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.summary(b.event_traffic(spark, sf_dir))


@query
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.top_domains(b.event_traffic(spark, sf_dir))


@query
def blocked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.blocked_domains(b.event_traffic(spark, sf_dir))


@query
def per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.per_client(b.event_traffic(spark, sf_dir), b.base_devices(spark, sf_dir))


@query
def per_client_named_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second names of addresses double no client."""
    named = b.named_twice(b.base_devices(spark, sf_dir))
    return traffic.per_client(b.event_traffic(spark, sf_dir), named)


@query
def summary_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts, and whether the sketches come within a twentieth of them."""
    log = b.event_traffic(spark, sf_dir)
    guessed = traffic.summary_approx(log).withColumnsRenamed(
        {"unique_clients": "clients", "unique_domains": "domains"}
    )
    near = [
        (F.abs(F.col(guess) - F.col(exact)) <= F.greatest(F.lit(1), F.col(exact) / 20)).alias(guess)
        for guess, exact in (("clients", "unique_clients"), ("domains", "unique_domains"))
    ]
    joined = traffic.summary(log).drop("date", "total_queries", "total_blocked").join(guessed, list(DAY))
    return joined.select(*DAY, "total_queries", "total_blocked", *near)


@query
def client_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.client_top_domains(b.event_traffic(spark, sf_dir))


@query
def off_hours_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.off_hours_domains(b.event_traffic(spark, sf_dir))


@query
def off_hours_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.off_hours_devices(
        b.event_traffic(spark, sf_dir), b.base_devices(spark, sf_dir)
    )


@query
def off_hours_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.off_hours_totals(b.event_traffic(spark, sf_dir))


@query
def off_hours_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.off_hours_domains(b.event_traffic(spark, sf_dir, WRAPPED), WRAPPED)


@query
def off_hours_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet hours over years of a zone that changes its clocks."""
    log = b.lineitem_traffic(spark, sf_dir, b.DST_PARAMS)
    return traffic.off_hours_domains(log, b.DST_PARAMS)


# Windows longer than a day, by panes.

LONG = {"36h": 36, "48h": 48, "30d": 30 * 24}


def _panes(spark: SparkSession, sf_dir: str, hours: int, log=b.event_log) -> tuple[DataFrame, ReportParams]:
    params = replace(PARAMS if log is b.event_log else b.BULK_PARAMS, window_hours=hours)
    return write_and_read(panes.pane_rollup(log(spark, sf_dir), params), "panes"), params


def _long_windows(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    parts = [
        operator(*_panes(spark, sf_dir, hours)).withColumn("lookback", F.lit(name))
        for name, hours in LONG.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def pane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_windows(spark, sf_dir, panes.summary)


@query
def pane_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_windows(spark, sf_dir, panes.top_domains)


@query
def pane_client_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_windows(spark, sf_dir, panes.client_totals)


@query
def pane_off_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off-hours over midnight from rollups of overlapping windows."""
    params = replace(WRAPPED, window_hours=48)
    return traffic.off_hours_domains(panes.report_rollup(b.event_log(spark, sf_dir), params), params)


@query
def pane_blocked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rule of a blocked domain within overlapping windows of 36 hours."""
    params = replace(PARAMS, window_hours=36)
    return traffic.blocked_domains(panes.report_rollup(b.event_log(spark, sf_dir), params))


@query
def bulk_summary_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.summary(*_panes(spark, sf_dir, 30 * 24, b.lineitem_log))


@query
def bulk_top_domains_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.top_domains(*_panes(spark, sf_dir, 30 * 24, b.lineitem_log))


# Novelty.


@query
def novel_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = novelty.first_sightings(b.event_traffic(spark, sf_dir))
    return novelty.novel_over_history(days, NOVELTY_DAYS)


def _sightings_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, StateTables]:
    """Sightings of all days, and a state that has recorded the days before the report."""
    sightings = write_and_read(
        novelty.first_sightings(b.event_traffic(spark, sf_dir)), "sightings"
    )
    state = StateTables(spark, scratch_path(spark, "state"))
    state.record_domains(sightings.filter(F.col("report_date") < F.lit(REPORT_DATE)))
    return sightings, state


@query
def novel_vs_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings, state = _sightings_state(spark, sf_dir)
    return novelty.novel_against_state(
        sightings.filter(F.col("report_date") == F.lit(REPORT_DATE)),
        state.known_domains(REPORT_DATE, NOVELTY_DAYS),
        NOVELTY_DAYS,
    )


@query
def new_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.new_domains_over_history(
        b.event_traffic(spark, sf_dir), NOVELTY_DAYS, b.base_devices(spark, sf_dir)
    )


@query
def new_domains_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given new domains looked up in the log, with the client that asked first."""
    log = b.event_traffic(spark, sf_dir)
    novel = novelty.novel_over_history(novelty.first_sightings(log), NOVELTY_DAYS)
    return novelty.new_domains(log, novel, b.base_devices(spark, sf_dir), pick="earliest")


@query
def known_domains_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings, state = _sightings_state(spark, sf_dir)
    state.record_domains(sightings.filter(F.col("report_date") >= F.lit(REPORT_DATE)))
    return state.known_domains(date.max)


@query
def state_per_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks recorded by runs of their own, the first of them again with fewer rows."""
    log = b.event_traffic(spark, sf_dir)
    state = StateTables(spark, scratch_path(spark, "state"))
    first = F.col("network_id") == "net0"
    reports = log.filter(first).select(*DAY).distinct()
    for part, asked in ((log.filter(first), None), (log.filter(~first), None), (log.filter(first & F.col("blocked")), reports)):
        state.record_domains(novelty.first_sightings(part), asked)
        state.record_volume(volume.daily_volume(part), asked)
    known = state.known_domains(date.max).select("network_id", F.col("domain").alias("name"), "first_seen", "last_seen")
    volumes = state.daily_volume(date.max, None).groupBy("network_id", F.col("client").alias("name")).agg(
        F.min("report_date").alias("first_seen"), F.max("report_date").alias("last_seen"), F.sum("query_count").alias("queries")
    )
    return known.withColumn("queries", F.lit(None).cast("bigint")).unionByName(volumes)


@query
def state_overlapping_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs that start from the same state: two publish, a third fails before it does."""
    log = b.event_traffic(spark, sf_dir)
    sightings = write_and_read(novelty.first_sightings(log), "sightings")
    state = StateTables(spark, scratch_path(spark, "state"))
    state.record_domains(sightings.filter(F.col("network_id") == "net2"))
    one = state.stage_domains(sightings.filter(F.col("network_id") == "net0"))
    blocked = novelty.first_sightings(log.filter(F.col("blocked")))
    other = state.stage_domains(blocked.filter(F.col("network_id") != "net0"))
    state.stage_domains(sightings.withColumn("domain", F.lit("never published")))
    other.publish()
    one.publish()
    return state.known_domains(date.max)


@query
def known_domains_late_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older day first recorded in part, and whole only after the days that follow it."""
    sightings = write_and_read(
        novelty.first_sightings(b.event_traffic(spark, sf_dir)), "sightings"
    )
    state = StateTables(spark, scratch_path(spark, "state"))
    older = F.col("report_date") == F.lit(date(2024, 1, 10))
    some = F.pmod(F.xxhash64("domain"), F.lit(3)) == 0
    state.record_domains(sightings.filter(older & some))
    state.record_domains(sightings.filter(~older))
    state.record_domains(sightings.filter(older))
    return state.known_domains(REPORT_DATE)


# Volume.


@query
def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.daily_volume(b.event_traffic(spark, sf_dir))


def _volume_state(spark: SparkSession, sf_dir: str) -> StateTables:
    state = StateTables(spark, scratch_path(spark, "state"))
    state.record_volume(volume.daily_volume(b.event_traffic(spark, sf_dir)))
    return state


@query
def daily_volume_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of answered queries, replaced by counts of blocked ones where there are any."""
    log = b.event_traffic(spark, sf_dir)
    first = volume.daily_volume(log.filter(~F.col("blocked")))
    second = volume.daily_volume(log.filter(F.col("blocked")))
    return volume.upsert_daily_volume(first, second)


@query
def daily_volume_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write of some dates replaces those dates and leaves the others."""
    log = b.event_traffic(spark, sf_dir)
    state = StateTables(spark, scratch_path(spark, "state"))
    state.record_volume(volume.daily_volume(log))
    again = log.filter(F.col("report_date") >= F.lit(REPORT_DATE))
    reports = again.select(*DAY).distinct()
    state.record_volume(volume.daily_volume(again.filter(F.col("blocked"))), reports)
    return state.daily_volume(date.max, None)


@query
def daily_volume_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of blocked queries merged into later days; other clients keep theirs."""
    log = b.event_traffic(spark, sf_dir)
    state = StateTables(spark, scratch_path(spark, "state"))
    state.record_volume(volume.daily_volume(log.filter(~F.col("blocked"))))
    late = log.filter(F.col("blocked") & (F.col("report_date") >= F.lit(REPORT_DATE)))
    state.merge_volume(volume.daily_volume(late))
    return state.daily_volume(date.max, None)


@query
def volume_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        volume.trailing_baseline(volume.daily_volume(b.event_traffic(spark, sf_dir)))
    )


@query
def baseline_asof_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _volume_state(spark, sf_dir)
    return _rounded(
        volume.baseline_for_date(
            state.daily_volume(REPORT_DATE, PARAMS.volume_baseline_days), REPORT_DATE
        )
    )


def _rounded(baseline: DataFrame) -> DataFrame:
    """Sums of floating-point numbers differ in the last digits between engines."""
    return baseline.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query
def volume_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes = volume.daily_volume(b.event_traffic(spark, sf_dir))
    return volume.volume_anomalies(
        volume.with_trailing_baseline(volumes), b.base_devices(spark, sf_dir)
    )


@query
def volume_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comparison for one report against the baseline kept in state tables."""
    state = _volume_state(spark, sf_dir)
    today = volume.daily_volume(b.event_traffic(spark, sf_dir)).filter(
        F.col("report_date") == F.lit(REPORT_DATE)
    )
    baseline = volume.baseline_for_date(state.daily_volume(REPORT_DATE), REPORT_DATE)
    return volume.volume_anomalies(
        volume.with_baseline(today, baseline), b.base_devices(spark, sf_dir)
    )


# Devices, counters and fingerprints.


@query
def device_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both maps name every address twice."""
    return devices.overlay_devices(
        b.named_twice(b.all_devices(spark, sf_dir)), b.named_twice(b.local_devices(spark, sf_dir))
    )


@query
def intercept_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter documents written, read back as an optional input and made a section."""
    path = scratch_path(spark, "intercepts")
    write_documents(enforcement.intercept_stats(b.counter_values(spark, sf_dir)), path)
    return enforcement.enforcement_section(read_intercept_stats(spark, path))


@query
def counter_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_counter_listing(b.counter_lines(spark, sf_dir))


@query
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforcement.counter_deltas(b.counter_readings(spark, sf_dir))


@query
def fingerprint_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot documents written, read back, gated and labelled."""
    path = scratch_path(spark, "fingerprints")
    write_documents(
        fingerprints.fingerprint_snapshot(
            b.fingerprints(spark, sf_dir), b.fingerprint_changes(spark, sf_dir)
        ),
        path,
    )
    section = fingerprints.profile_section(
        read_fingerprint_snapshots(spark, path), b.base_devices(spark, sf_dir)
    )
    return section.select(*DAY, F.inline("devices")).drop("link_type")


@query
def fingerprint_change_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as they leave the section, with device names and the section's note."""
    snapshots = fingerprints.fingerprint_snapshot(
        b.fingerprints(spark, sf_dir), b.fingerprint_changes(spark, sf_dir)
    )
    section = fingerprints.profile_section(snapshots, b.base_devices(spark, sf_dir))
    changes = section.select(*DAY, "note", F.posexplode("recent_changes"))
    return changes.select(*DAY, "note", (F.col("pos") + 1).alias("rank"), "col.*")


@query
def fingerprint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device with its place over all pages of a report, newest first."""
    size = 5
    snapshots = fingerprints.fingerprint_snapshot(
        b.event_fingerprints(spark, sf_dir), b.event_fingerprint_changes(spark, sf_dir), page_size=size
    )
    rows = snapshots.select(*DAY, "page", F.posexplode("devices"))
    return rows.select(*DAY, (F.col("page") * size + F.col("pos")).alias("place"), "col.ip", "col.last_seen")


@query
def fingerprint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.latest_changes(b.fingerprint_changes(spark, sf_dir))


# The packet and its readers.


def _packets(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    params = replace(PARAMS, known_domains_window_days=NOVELTY_DAYS, **changes)
    log = report_days.assign_report_days(b.event_log(spark, sf_dir), params)
    return packet.backfill_packets(log, params, b.base_devices(spark, sf_dir))


@query
def headline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet.headline_stats(_packets(spark, sf_dir))


@query
def packet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and first entry of every section, summed over the pages of a report."""
    p = F.col("packet")
    quiet = p["off_hours_activity"]
    first = F.lit(0)

    def rows(section) -> F.Column:
        return F.sum(F.size(section)).cast("bigint")

    def head(section, field: str):
        return F.max(F.when(F.col("page") == 0, F.get(section, first)[field]))

    return (
        _packets(spark, sf_dir)
        .groupBy(*DAY)
        .agg(
            F.max(p["summary"]["total_queries"]).alias("total_queries"),
            F.max(p["summary"]["total_blocked"]).alias("total_blocked"),
            rows(p["top_domains"]).alias("top_rows"),
            head(p["top_domains"], "domain").alias("top_first"),
            rows(p["per_client"]).alias("client_rows"),
            head(p["per_client"], "client").alias("client_first"),
            F.max(quiet["total_queries"]).alias("quiet_total"),
            rows(quiet["by_device"]).alias("quiet_rows"),
            head(quiet["by_device"], "device").alias("quiet_first"),
            rows(p["new_domains"]).alias("new_rows"),
            head(p["new_domains"], "domain").alias("new_first"),
            rows(p["volume_anomalies"]).alias("anomaly_rows"),
            head(p["volume_anomalies"], "client").alias("anomaly_first"),
            rows(p["blocked_domains"]).alias("blocked_rows"),
            head(p["blocked_domains"], "rule").alias("blocked_first_rule"),
        )
    )


@query
def backfill_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of some late days: what they find new or unusual rests on the days before them."""
    params = replace(PARAMS, known_domains_window_days=NOVELTY_DAYS)
    span = (REPORT_DATE, REPORT_DATE + timedelta(days=4))
    packets = packet.backfill_packets(
        b.event_log(spark, sf_dir), params, b.base_devices(spark, sf_dir), span=span
    )
    return _findings(packets)


@query
def packet_48h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of overlapping windows of two days, over the whole log."""
    params = replace(PARAMS, known_domains_window_days=NOVELTY_DAYS, window_hours=48)
    return _findings(
        packet.backfill_packets(b.event_log(spark, sf_dir), params, b.base_devices(spark, sf_dir))
    )


@query
def packet_client_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested per-client lists taken apart again."""
    clients = _packets(spark, sf_dir).select(*DAY, F.inline("packet.per_client"))
    return clients.select(
        *DAY, "client", "device", "total", "blocked", F.posexplode("top_domains")
    ).select(
        *DAY,
        "client",
        "device",
        "total",
        "blocked",
        (F.col("pos") + 1).alias("rank"),
        "col.domain",
        "col.count",
    )


def _places(spark: SparkSession, sf_dir: str, page_size: int) -> DataFrame:
    """Every entry of the long lists with its place over all pages of a report."""
    packets = _packets(spark, sf_dir, page_size=page_size)
    lists = {
        "per_client": ("packet.per_client", "client"),
        "by_device": ("packet.off_hours_activity.by_device", "client"),
        "new_domains": ("packet.new_domains", "domain"),
        "volume_anomalies": ("packet.volume_anomalies", "client"),
    }
    parts = [
        packets.select(*DAY, "page", F.posexplode(column)).select(
            *DAY,
            F.lit(name).alias("list"),
            (F.col("page") * page_size + F.col("pos")).alias("place"),
            F.col(f"col.{key}").alias("name"),
        )
        for name, (column, key) in lists.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def packet_lists_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, PARAMS.page_size)


@query
def packet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three entries, put together again."""
    return _places(spark, sf_dir, 3)


@query
def packet_off_hours_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested off-hours lists with both local times."""
    quiet = _packets(spark, sf_dir).select(*DAY, F.inline("packet.off_hours_activity.by_device"))
    rows = quiet.select(*DAY, "client", "device", "total", F.posexplode("top_domains"))
    return rows.select(*DAY, "client", "device", "total", (F.col("pos") + 1).alias("rank"), "col.*")


@query
def packet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written as JSON by date, read back and flattened."""
    path = scratch_path(spark, "packet-files")
    archive.write_packets(_packets(spark, sf_dir), path)
    packets = archive.read_packets(spark, path).select(*DAY, "packet.*")

    def flat(section: str, entries, amount: str, *name: str) -> DataFrame:
        return packets.select(*DAY, F.explode(entries).alias("e")).select(
            *DAY,
            F.lit(section).alias("section"),
            F.concat_ws(" ", *[F.col(f"e.{field}") for field in name]).alias("name"),
            F.col(f"e.{amount}").alias("amount"),
        )

    parts = [
        flat("top_domains", "top_domains", "count", "domain"),
        flat("blocked_domains", "blocked_domains", "count", "domain", "rule"),
        flat("new_domains", "new_domains", "count", "domain", "first_client"),
        flat("by_device", "off_hours_activity.by_device", "total", "device", "client"),
        flat("volume_anomalies", "volume_anomalies", "today_count", "device", "client"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def daily_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily run on top of the state left by all days before it."""
    params = replace(PARAMS, known_domains_window_days=NOVELTY_DAYS)
    sightings, state = _sightings_state(spark, sf_dir)
    state.record_volume(
        volume.daily_volume(b.event_traffic(spark, sf_dir)).filter(
            F.col("report_date") < F.lit(REPORT_DATE)
        )
    )
    packets = run_report(
        b.event_log(spark, sf_dir),
        RUN_TIME,
        REPORT_DATE,
        state,
        params,
        b.base_devices(spark, sf_dir),
    )
    return _findings(packets)


def _findings(packets: DataFrame) -> DataFrame:
    """New domains, unusual clients and total of every report."""
    new = packets.select(*DAY, F.explode("packet.new_domains").alias("e")).select(
        *DAY, F.lit("new").alias("section"), F.col("e.domain").alias("name"), "e.count"
    )
    unusual = packets.select(*DAY, F.explode("packet.volume_anomalies").alias("e")).select(
        *DAY, F.lit("anomaly"), "e.client", "e.today_count"
    )
    total = packets.filter(F.col("page") == 0).select(
        *DAY, F.lit("total"), F.lit(""), "packet.summary.total_queries"
    )
    return new.union(unusual).union(total)


@query
def job_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for one network of the log and a silent one, and what it leaves in the state."""
    state = _volume_state(spark, sf_dir)
    networks = b.table(spark, sf_dir, "region").select(
        F.when(F.col("r_regionkey") % 2 == 0, "net0").otherwise("silent").alias("network_id")
    )
    params = replace(PARAMS, volume_baseline_days=5, window_hours=48)
    packets = run_report(
        b.event_log(spark, sf_dir), RUN_TIME, REPORT_DATE, state, params, networks=networks
    )
    reported = packets.select(
        "network_id", F.lit("packet").alias("kind"), F.col("packet.summary.total_queries").alias("queries")
    )
    counted = state.daily_volume(date.max, None).groupBy("network_id").agg(F.sum("query_count").alias("queries"))
    return reported.unionByName(counted.withColumn("kind", F.lit("state")))


def _packets_with_side_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = replace(PARAMS, known_domains_window_days=NOVELTY_DAYS)
    log = report_days.assign_report_days(b.event_log(spark, sf_dir), params)
    return packet.backfill_packets(
        log,
        params,
        b.base_devices(spark, sf_dir),
        enforcement.intercept_stats(b.event_counters(spark, sf_dir)),
        fingerprints.fingerprint_snapshot(
            b.event_fingerprints(spark, sf_dir), b.event_fingerprint_changes(spark, sf_dir)
        ),
    )


@query
def packet_side_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional sections of the packet."""
    profiles = F.col("packet.device_profiles")
    counters = F.col("packet.dns_enforcement")
    page = F.col("page") == 0
    return (
        _packets_with_side_inputs(spark, sf_dir)
        .groupBy(*DAY)
        .agg(
            F.sum(F.size(profiles["devices"])).cast("bigint").alias("profiles"),
            F.max(F.when(page, F.get(profiles["devices"], F.lit(0))["device"])).alias("newest"),
            F.sum(F.size(profiles["recent_changes"])).cast("bigint").alias("changes"),
            F.max(
                F.when(page, F.get(profiles["recent_changes"], F.lit(0))["detected_at"])
            ).alias("last_change"),
            F.max(counters["intercepted_queries"]).alias("intercepted_queries"),
            F.max(counters["intercepted_bytes"]).alias("intercepted_bytes"),
            F.max(counters["udp_queries"]).alias("udp_queries"),
            F.max(counters["tcp_queries"]).alias("tcp_queries"),
        )
    )


@query
def packet_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as indented text, told by what a JSON reader finds in the text."""
    text = F.col("packet_json")

    def length(path: str) -> F.Column:
        return F.json_array_length(F.get_json_object(text, path))

    return archive.packet_documents(_packets_with_side_inputs(spark, sf_dir)).select(
        *DAY,
        "page",
        F.concat_ws(" ", F.json_object_keys(text)).alias("sections"),
        F.get_json_object(text, "$.summary.date").alias("date"),
        F.get_json_object(text, "$.off_hours_activity.timezone").alias("timezone"),
        F.get_json_object(text, "$.dns_enforcement.udp_queries").alias("udp_queries"),
        length("$.per_client").alias("clients"),
        length("$.off_hours_activity.by_device").alias("quiet_devices"),
        length("$.volume_anomalies").alias("anomalies"),
        length("$.device_profiles.devices").alias("profiles"),
    )


@query
def prompt_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, taken apart into the request and the evidence they carry."""
    evidence = F.substring(F.col("content"), F.instr("content", "{"), F.length("content"))
    return (
        messages.prompts(_packets(spark, sf_dir))
        .select(*DAY, "page", F.inline("messages"))
        .select(
            *DAY,
            "page",
            "role",
            F.substring_index("content", "\n", 2).alias("request"),
            F.get_json_object(evidence, "$.summary.total_queries").alias("total_queries"),
            F.get_json_object(evidence, "$.blocked_domains[0].domain").alias("top_blocked"),
        )
    )


@query
def response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.response_texts(b.response_events(spark, sf_dir))


@query
def response_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.response_stops(b.response_events(spark, sf_dir))


@query
def response_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts answered with a line from their packet, and the answers made into reports."""
    packets = _packets(spark, sf_dir)
    asked = reports.numbered_prompts(packets)
    total = F.col("packet.summary.total_queries").cast("string")

    def event(kind: str, **delta) -> F.Column:
        fields = F.struct(*[value.alias(name) for name, value in delta.items()])
        return F.to_json(F.struct(F.lit(kind).alias("type"), fields.alias("delta")))

    def text(value) -> F.Column:
        return event("content_block_delta", type=F.lit("text_delta"), text=value)

    answered = asked.select(*DAY, "page", "response_id").join(
        packets.select(*DAY, "page", total.alias("total")), [*DAY, "page"]
    )
    bodies = F.array(
        text(F.lit("Report ")),
        text(F.concat(F.col("report_date").cast("string"), F.lit(": "))),
        text(F.col("total")),
        event("message_delta", stop_reason=F.lit("end_turn")),
    )
    events = answered.select("response_id", F.posexplode(bodies).alias("seq", "body"))
    return reports.reports_from_responses(asked, events)


# The archive.


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two networks after the other one's, then two networks' later ones again."""
    path = scratch_path(spark, "reports")
    totals = traffic.summary(b.event_traffic(spark, sf_dir))

    def texts(word: str) -> DataFrame:
        return totals.select(
            *DAY,
            F.concat(
                F.lit(word), F.lit(" "), F.col("date"), F.lit(": "), F.col("total_queries")
            ).alias("report"),
        )

    first = F.col("network_id") == "net0"
    archive.write_reports(texts("draft").filter(first), path)
    archive.write_reports(texts("draft").filter(~first), path)
    late = (F.col("report_date") >= F.lit(REPORT_DATE)) & (F.col("network_id") != "net1")
    archive.write_reports(texts("final").filter(late), path)
    return archive.read_reports(spark, path)


@query
def report_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir).select(*DAY, "report")


@query
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.latest_reports(_archive(spark, sf_dir)).select(*DAY, "report")


@query
def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_index(_archive(spark, sf_dir))


# Streams. The log arrives in three deliveries, each followed by a run that stops when it
# has processed all files; state and watermark carry over through the checkpoint. The first and
# the last delivery are open-ended, so they hold every row.

DELIVERIES = (date(2024, 1, 11), date(2024, 1, 21))


def _deliver(
    spark: SparkSession,
    sf_dir: str,
    run: Callable[[DataFrame], None],
    order: tuple[int, ...] = (0, 1, 2),
) -> None:
    path = scratch_path(spark, "deliveries")
    events = b.table(spark, sf_dir, "events")
    number = sum((F.col("ts") >= F.lit(day)).cast("int") for day in DELIVERIES)
    for delivery in order:
        events.filter(number == delivery).write.mode("append").parquet(path)
        run(b.events_as_log(log_stream(spark, path, events.schema)))


def _streamed(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    pin_utc(spark)
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    _deliver(spark, sf_dir, lambda log: append_available(operator(log), out, checkpoint))
    return spark.read.parquet(out)


@query
def stream_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, volume_stream.stream_daily_volume)


@query
def stream_volume_48h(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = replace(PARAMS, window_hours=48)
    return _streamed(
        spark, sf_dir, lambda log: volume_stream.stream_daily_volume(log, params=params)
    )


@query
def stream_novel_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(
        spark, sf_dir, lambda log: novelty_stream.stream_novel_domains(log, NOVELTY_DAYS)
    )


def _upkeep(spark: SparkSession, sf_dir: str) -> StateUpkeep:
    """State kept batch by batch, merged into a base after every second batch."""
    pin_utc(spark)
    params = replace(PARAMS, known_domains_window_days=NOVELTY_DAYS)
    upkeep = StateUpkeep(scratch_path(spark, "upkeep"), params, compact_every=2)
    checkpoint = scratch_path(spark, "upkeep-state")
    _deliver(spark, sf_dir, lambda log: upkeep.start(log, checkpoint).awaitTermination())
    return upkeep


@query
def stream_state_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upkeep(spark, sf_dir).known_domains(spark)


@query
def stream_volume_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upkeep(spark, sf_dir).daily_volume(spark)


@query
def stream_batch_novel_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upkeep(spark, sf_dir).alerts(spark)


@query
def stream_late_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second delivery comes last; the days closed before it are closed again."""
    pin_utc(spark)
    upkeep = StateUpkeep(scratch_path(spark, "upkeep"), PARAMS)
    checkpoint = scratch_path(spark, "upkeep-state")
    state = StateTables(spark, scratch_path(spark, "state"))
    closed: set[date] = set()

    def run(log: DataFrame) -> None:
        upkeep.start(log, checkpoint).awaitTermination()
        days = {r.report_date for r in upkeep.daily_volume(spark).select("report_date").distinct().collect()}
        due = sorted((days - closed) | set(upkeep.reopened_days(spark)))
        upkeep.close_days(state, spark, due)
        closed.update(due)

    _deliver(spark, sf_dir, run, order=(0, 2, 1))
    return state.daily_volume(date.max, None)


@query
def stream_late_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New domains where the second delivery comes last, days behind the watermark."""
    pin_utc(spark)
    params = replace(PARAMS, known_domains_window_days=NOVELTY_DAYS)
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    late, beside = LateDomains(scratch_path(spark, "late"), params=params), scratch_path(spark, "late-state")
    state, folded = StateTables(spark, scratch_path(spark, "state")), scratch_path(spark, "late-alerts")

    def run(log: DataFrame) -> None:
        append_available(novelty_stream.stream_novel_domains(log, NOVELTY_DAYS), out, checkpoint)
        late.start(log, beside).awaitTermination()

    _deliver(spark, sf_dir, run, order=(0, 2, 1))
    day = F.col("time").cast("date")
    in_time = b.event_log(spark, sf_dir).filter((day < F.lit(DELIVERIES[0])) | (day >= F.lit(DELIVERIES[1])))
    state.record_domains(novelty.first_sightings(report_days.assign_report_days(in_time, params)))
    late.fold(spark, state, folded)
    return spark.read.parquet(out).unionByName(spark.read.parquet(folded)).distinct()


# The same operators over the largest table.


@query
def bulk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.summary(b.lineitem_traffic(spark, sf_dir))


@query
def bulk_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.top_domains(b.lineitem_traffic(spark, sf_dir))


@query
def bulk_blocked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.blocked_domains(b.lineitem_traffic(spark, sf_dir))


@query
def bulk_client_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.client_top_domains(b.lineitem_traffic(spark, sf_dir))


@query
def bulk_off_hours_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.off_hours_domains(b.lineitem_traffic(spark, sf_dir), b.BULK_PARAMS)


@query
def bulk_new_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.new_domains_over_history(
        b.lineitem_traffic(spark, sf_dir), devices=b.supplier_devices(spark, sf_dir)
    )


@query
def bulk_volume_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        volume.trailing_baseline(volume.daily_volume(b.lineitem_traffic(spark, sf_dir)))
    )


@query
def bulk_volume_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    volumes = volume.daily_volume(b.lineitem_traffic(spark, sf_dir))
    return volume.volume_anomalies(
        volume.with_trailing_baseline(volumes), b.supplier_devices(spark, sf_dir)
    )
