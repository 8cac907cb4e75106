"""Batch jobs: `ingest` pages into the log, make packets and prompts by `daily` or `backfill`,
archive what came back by `reports`, or `import` a folder of report files."""

from __future__ import annotations

import argparse
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from querytide.params import DAY, ReportParams
from querytide.plans.daily import run_report
from querytide.plans.packet import backfill_packets, times_of_span
from querytide.plans.reports import (
    PROMPT_SCHEMA,
    import_dated_files,
    numbered_prompts,
    reports_from_responses,
)
from querytide.session import clear_scratch, pin_utc, write_and_read
from querytide.sources.archive import write_packets, write_reports
from querytide.sources.day_tables import read_days, replace_days
from querytide.sources.log_store import read_log, write_log
from querytide.sources.pages import log_rows, parse_entries, read_pages, rejected_rows
from querytide.sources.side_inputs import (
    read_devices,
    read_fingerprint_snapshots,
    read_intercept_stats,
)
from querytide.sources.state_tables import StateTables


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="querytide", description=__doc__)
    parser.add_argument("job", choices=["ingest", "daily", "backfill", "reports", "import"])
    parser.add_argument("--pages", help="captured pages in network_id=... folders (ingest)")
    parser.add_argument("--layout", choices=["documents", "lines"], default="lines")
    parser.add_argument("--load", help="name of this load; repeating it replaces it (ingest)")
    parser.add_argument("--log", help="folder of the parsed log (ingest, daily, backfill)")
    parser.add_argument("--rejects", help="folder for entries that cannot be read (ingest)")
    parser.add_argument("--out", help="folder for packets and prompts (read by reports)")
    parser.add_argument("--state", help="folder of the state tables (daily)")
    parser.add_argument("--now", type=datetime.fromisoformat, help="UTC end of the window (daily)")
    parser.add_argument("--devices", help="JSON lines with network_id, ip, device")
    parser.add_argument("--local-devices", help="the same, overriding --devices")
    parser.add_argument("--intercepts", help="interception counter documents")
    parser.add_argument("--fingerprints", help="fingerprint snapshot documents")
    parser.add_argument("--side-layout", choices=["documents", "lines"], default="documents")
    parser.add_argument("--timezone", default=ReportParams.timezone)
    parser.add_argument("--off-hours", nargs=2, metavar=("START", "END"))
    parser.add_argument("--window-hours", type=int, default=ReportParams.window_hours)
    parser.add_argument("--known-days", type=int, default=ReportParams.known_domains_window_days)
    parser.add_argument("--baseline-days", type=int, default=ReportParams.volume_baseline_days)
    parser.add_argument("--networks", help="JSON lines with network_id: only these, even if silent")
    parser.add_argument("--trial", action="store_true", help="leave the state alone (daily)")
    parser.add_argument("--from", dest="first", type=date.fromisoformat, help="(backfill)")
    parser.add_argument("--to", dest="last", type=date.fromisoformat, help="(backfill)")
    parser.add_argument("--responses", help="JSON lines with response_id, seq, body (reports)")
    parser.add_argument("--skip-broken", action="store_true", help="leave out cut reports (reports)")
    parser.add_argument("--archive", help="folder of the report archive (reports, import)")
    parser.add_argument("--folder", help="report files named by date (import)")
    parser.add_argument("--network", help="network the files belong to (import)")
    args = parser.parse_args()
    needed = {
        "ingest": ["log", "pages", "load"],
        "daily": ["log", "out", "state", "now"],
        "backfill": ["log", "out"],
        "reports": ["out", "responses", "archive"],
        "import": ["folder", "network", "archive"],
    }
    missing = [f"--{name}" for name in needed[args.job] if getattr(args, name) is None]
    if missing:
        parser.error(f"{args.job} needs {' and '.join(missing)}")
    if (args.first is None) != (args.last is None):
        parser.error("--from and --to go together")
    return args


def main() -> None:
    args = arguments()
    spark = pin_utc(SparkSession.builder.appName(f"querytide-{args.job}").getOrCreate())
    jobs = {"ingest": ingest, "reports": archive_reports, "import": import_reports}
    jobs.get(args.job, make_packets)(spark, args)
    clear_scratch(spark)


def make_packets(spark: SparkSession, args: argparse.Namespace) -> None:
    """Packets and prompts of one day, with state, or of all days of the log."""
    start, end = args.off_hours or (ReportParams.off_hours_start, ReportParams.off_hours_end)
    params = ReportParams(
        timezone=args.timezone,
        off_hours_start=start,
        off_hours_end=end,
        window_hours=args.window_hours,
        known_domains_window_days=args.known_days,
        volume_baseline_days=args.baseline_days,
    )
    networks = None
    if args.networks:
        networks = spark.read.schema("network_id STRING").json(args.networks)
    side_inputs = {
        "devices": (
            read_devices(spark, args.devices, args.local_devices) if args.devices else None
        ),
        "intercepts": (
            read_intercept_stats(spark, args.intercepts, args.side_layout)
            if args.intercepts
            else None
        ),
        "snapshots": (
            read_fingerprint_snapshots(spark, args.fingerprints, args.side_layout)
            if args.fingerprints
            else None
        ),
    }
    if args.job == "daily":
        since = args.now - timedelta(hours=params.window_hours)
        packets = run_report(
            read_log(spark, args.log, since, args.now),
            args.now,
            report_date_of(args.now, params),
            StateTables(spark, args.state),
            params,
            networks=networks,
            trial=args.trial,
            **side_inputs,
        )
    else:
        span = (args.first, args.last) if args.first else None
        log = read_log(spark, args.log, *(times_of_span(span, params) if span else ()))
        if networks is not None:
            log = log.join(networks.distinct(), "network_id", "left_semi")
        made = backfill_packets(log, params, span=span, **side_inputs)
        packets = write_and_read(made, "packets")
    write_packets(packets, f"{args.out}/packets")
    prompts = numbered_prompts(packets, params)
    replace_days(prompts, f"{args.out}/prompts", PROMPT_SCHEMA, file_format="json")


def archive_reports(spark: SparkSession, args: argparse.Namespace) -> None:
    """Responses to the prompts of earlier jobs -> archived reports."""
    events = spark.read.schema("response_id STRING, seq BIGINT, body STRING").json(args.responses)
    asked = read_days(spark, f"{args.out}/prompts", PROMPT_SCHEMA, "json")
    answered = asked.join(events.select("response_id"), "response_id", "left_semi").select(*DAY)
    asked = asked.join(answered.distinct(), list(DAY), "left_semi")
    write_reports(reports_from_responses(asked, events, not args.skip_broken), args.archive)


def import_reports(spark: SparkSession, args: argparse.Namespace) -> None:
    import_dated_files(spark, args.folder, args.network, args.archive)


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Pages -> log by date; without a place for rejects the first bad entry ends the job."""
    raw = read_pages(spark, args.pages, layout=args.layout)
    parsed = parse_entries(raw, strict=args.rejects is None)
    write_log(log_rows(parsed), args.log, args.load)
    if args.rejects is not None:
        rejected_rows(parsed).write.mode("overwrite").json(args.rejects)


def report_date_of(now: datetime, params: ReportParams) -> date:
    """Local date of the run, in the report's zone."""
    return now.replace(tzinfo=now.tzinfo or UTC).astimezone(ZoneInfo(params.timezone)).date()


if __name__ == "__main__":
    main()
