"""The daily run: log and state in, packets and new state out."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.operators import novelty, volume
from querytide.operators.report_days import single_report
from querytide.params import ReportParams
from querytide.plans.packet import evidence_packets, report_tables
from querytide.session import pin_utc, write_and_read
from querytide.sources.archive import write_packets
from querytide.sources.state_tables import StateTables


def run_report(
    log: DataFrame,
    now: datetime,
    report_date: date,
    state: StateTables,
    params: ReportParams = ReportParams(),
    devices: DataFrame | None = None,
    intercepts: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    networks: DataFrame | None = None,
    packet_path: str | None = None,
    trial: bool = False,
) -> DataFrame:
    """One report date for all networks in the log, or for the listed ones.

    State is read only for days before the report date, so a repeated run finds the same
    new domains and the same baseline. Listed networks get a packet even when their log is
    empty, and only their packets and state are replaced. A trial run records no state.
    """
    pin_utc(log.sparkSession)
    day = F.lit(report_date.isoformat()).cast("date")
    if networks is not None:
        networks = networks.select("network_id").distinct()
        log = log.join(networks, "network_id", "left_semi")
    tables = report_tables(single_report(log, now, day, params), params)
    novel = novelty.novel_against_state(
        tables.sightings(),
        state.known_domains(report_date, params.known_domains_window_days),
        params.known_domains_window_days,
    )
    baseline = volume.baseline_for_date(
        state.daily_volume(report_date, params.volume_baseline_days),
        report_date,
        params.volume_baseline_days,
    )

    def of_this_day(rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else rows.filter(F.col("report_date") == day)

    calendar = (
        None
        if networks is None
        else networks.withColumn("report_date", day)
    )
    packets = write_and_read(
        evidence_packets(
            tables,
            novel,
            baseline,
            params,
            devices,
            of_this_day(intercepts),
            of_this_day(snapshots),
            calendar,
        ),
        "packets",
    )
    if packet_path is not None:
        write_packets(packets, packet_path)
    if not trial:
        state.record_domains(tables.sightings(), calendar)
        state.record_volume(tables.volumes(), calendar)
    return packets
