"""The spark-submit entry, run in the test's own session."""

from __future__ import annotations

import json
import sys
from datetime import date, datetime

import fixture_day
import pytest
from fixture_day import TOTAL

from querytide import __main__ as jobs
from querytide.params import ReportParams
from querytide.sources.archive import read_packets, read_reports
from querytide.sources.log_store import read_log, write_log
from querytide.sources.day_tables import current_paths
from querytide.sources.state_tables import StateTables

ZONE = ("--timezone", "Asia/Kolkata", "--off-hours", "00:30", "04:30")


def run(monkeypatch, *argv):
    monkeypatch.setattr(sys, "argv", ["querytide", *argv])
    jobs.main()


@pytest.fixture
def log(spark, tmp_path, monkeypatch):
    """The fixture day taken in from page files, one of them broken."""
    pages = tmp_path / "pages"
    fixture_day.page_texts(spark).write.partitionBy("network_id").text(str(pages))
    (pages / "network_id=flat7" / "broken.txt").write_text("no page\n")
    run(
        monkeypatch, "ingest", "--pages", str(pages), "--log", str(tmp_path / "log"),
        "--load", "first", "--rejects", str(tmp_path / "rejects"),
    )
    assert spark.read.json(str(tmp_path / "rejects")).count() == 1
    return str(tmp_path / "log")


def daily(monkeypatch, tmp_path, log, *more):
    run(
        monkeypatch, "daily", "--log", log, "--out", str(tmp_path / "out"),
        "--state", str(tmp_path / "state"), "--now", "2025-11-16T18:15:00", *ZONE, *more,
    )


def test_strict_ingest(spark, tmp_path, monkeypatch):
    (tmp_path / "network_id=flat7").mkdir()
    (tmp_path / "network_id=flat7" / "broken.txt").write_text("no page\n")
    with pytest.raises(Exception, match="bad log entry"):
        run(
            monkeypatch, "ingest", "--pages", str(tmp_path), "--load", "x",
            "--log", str(tmp_path / "log"),
        )


def test_log_store_opens_only_its_dates(spark, log):
    some = read_log(spark, log, datetime(2025, 11, 15, 20), datetime(2025, 11, 16))
    assert some.count() > 0
    assert some.filter("time < '2025-11-15 20:00:00' OR time >= '2025-11-16 00:00:00'").count() == 0
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert read_log(spark, log).count() == TOTAL


def test_loads_are_added_and_replaced_whole(spark, log):
    schema = read_log(spark, log).schema
    last_day = spark.createDataFrame(read_log(spark, log, datetime(2025, 11, 16)).collect(), schema)
    rest = spark.createDataFrame(read_log(spark, log, None, datetime(2025, 11, 16)).collect(), schema)
    for _ in range(2):
        write_log(last_day, log, "second")
        assert read_log(spark, log).count() == TOTAL + last_day.count()
    write_log(rest, log, "first")
    assert read_log(spark, log).count() == TOTAL
    write_log(rest.limit(0), log, "second")
    assert read_log(spark, log).count() == rest.count()


def raw(spark, path):
    """JSON documents as they were written, absent keys included."""
    return spark.read.option("basePath", str(path)).json(current_paths(spark, str(path)))


def test_daily_job(spark, log, tmp_path, monkeypatch):
    (tmp_path / "devices.json").write_text(
        json.dumps({"network_id": "flat7", "ip": "10.7.0.3", "device": "Tablet"})
    )
    counters = tmp_path / "counters" / "network_id=flat7" / "report_date=2025-11-16"
    counters.mkdir(parents=True)
    (counters / "stats.json").write_text(
        json.dumps({"available": True, "intercepted_queries": 7, "udp_queries": 7}, indent=2)
    )
    daily(
        monkeypatch, tmp_path, log, "--devices", str(tmp_path / "devices.json"),
        "--intercepts", str(tmp_path / "counters"), "--fingerprints", str(tmp_path / "none"),
    )
    (packet,) = raw(spark, tmp_path / "out/packets").collect()
    assert packet.report_date == date(2025, 11, 16)
    assert packet.packet.summary.total_queries == TOTAL
    assert "Tablet" in {c.device for c in packet.packet.per_client}
    assert packet.packet.dns_enforcement.udp_queries == 7
    assert "device_profiles" not in packet.packet.asDict()
    (prompt,) = raw(spark, tmp_path / "out/prompts").collect()
    assert prompt.response_id == "flat7/2025-11-16/0"


def test_silent_networks_trials_and_windows(spark, log, tmp_path, monkeypatch):
    (tmp_path / "networks.json").write_text('{"network_id": "flat7"}\n{"network_id": "silent"}\n')
    state = StateTables(spark, str(tmp_path / "state"))
    listed = ("--networks", str(tmp_path / "networks.json"))
    daily(monkeypatch, tmp_path, log, *listed, "--trial", "--window-hours", "6", "--known-days", "2")
    packets = {r.network_id: r.packet for r in read_packets(spark, str(tmp_path / "out/packets")).collect()}
    late = read_log(spark, log, datetime(2025, 11, 16, 12, 15)).count()
    assert packets["silent"].summary.total_queries == 0
    assert packets["flat7"].summary.total_queries == late
    assert state.known_domains(date.max).count() == 0
    daily(monkeypatch, tmp_path, log, *listed, "--baseline-days", "3")
    assert state.known_domains(date.max).count() == 12
    assert {r.network_id for r in state.daily_volume(date.max, None).collect()} == {"flat7"}


def test_a_run_for_one_network_leaves_the_others(spark, log, tmp_path, monkeypatch):
    schema = read_log(spark, log).schema
    other = spark.createDataFrame(read_log(spark, log).limit(20).collect(), schema).replace("flat7", "attic")
    write_log(other, log, "attic")
    daily(monkeypatch, tmp_path, log)
    (tmp_path / "one.json").write_text('{"network_id": "attic"}\n')
    daily(monkeypatch, tmp_path, log, "--networks", str(tmp_path / "one.json"))
    packets = read_packets(spark, str(tmp_path / "out/packets"))
    assert {r.network_id: r.packet.summary.total_queries for r in packets.collect()} == {"flat7": TOTAL, "attic": 20}
    state = StateTables(spark, str(tmp_path / "state"))
    assert {r.network_id for r in state.known_domains(date.max).collect()} == {"flat7", "attic"}


def test_backfill_job(spark, log, tmp_path, monkeypatch):
    run(
        monkeypatch, "backfill", "--log", log, "--out", str(tmp_path / "out"),
        "--off-hours", "02:00", "04:00",
    )
    rows = read_packets(spark, str(tmp_path / "out/packets")).collect()
    assert sum(r.packet.summary.total_queries for r in rows) == TOTAL
    assert {r.packet.off_hours_activity.window_start for r in rows} == {"02:00"}


def test_backfill_of_a_span(spark, log, tmp_path, monkeypatch):
    """A row with a wrong clock makes no packets outside the span."""
    schema = read_log(spark, log).schema
    stray = spark.createDataFrame(read_log(spark, log).limit(1).collect(), schema)
    write_log(stray.selectExpr("* EXCEPT (time)", "timestamp_ntz'1999-01-01 00:00:00' AS time"), log, "stray")
    run(
        monkeypatch, "backfill", "--log", log, "--out", str(tmp_path / "out"),
        "--from", "2025-11-14", "--to", "2025-11-17",
    )
    packets = read_packets(spark, str(tmp_path / "out/packets")).collect()
    assert {r.report_date.day for r in packets} == {14, 15, 16, 17}
    assert sum(r.packet.summary.total_queries for r in packets) == TOTAL


def test_reports_and_import_jobs(spark, log, tmp_path, monkeypatch):
    daily(monkeypatch, tmp_path, log)
    bodies = [
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "All "}},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "quiet."}},
        {"type": "message_delta", "delta": {"stop_reason": "end_turn"}},
    ]
    (tmp_path / "responses.json").write_text("\n".join(
        json.dumps({"response_id": "flat7/2025-11-16/0", "seq": k, "body": json.dumps(body)})
        for k, body in enumerate(bodies)
    ))
    archive = str(tmp_path / "archive")
    run(
        monkeypatch, "reports", "--out", str(tmp_path / "out"), "--archive", archive,
        "--responses", str(tmp_path / "responses.json"),
    )
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "2025-11-16.md").write_text("attic report")
    (tmp_path / "old" / "2025-11-15.md").write_text("older report")
    run(monkeypatch, "import", "--folder", str(tmp_path / "old"), "--network", "attic", "--archive", archive)
    found = {(r.network_id, r.report_date.day, r.report) for r in read_reports(spark, archive).collect()}
    assert found == {("flat7", 16, "All quiet."), ("attic", 16, "attic report"), ("attic", 15, "older report")}


def test_daily_job_needs_state(monkeypatch, capsys):
    with pytest.raises(SystemExit):
        run(monkeypatch, "daily", "--log", "l", "--out", "o")
    assert "--state and --now" in capsys.readouterr().err


def test_report_date_is_local():
    late = datetime(2026, 5, 8, 23, 30)
    assert jobs.report_date_of(late, ReportParams()) == date(2026, 5, 8)
    assert jobs.report_date_of(late, ReportParams(timezone="Asia/Tokyo")) == date(2026, 5, 9)
