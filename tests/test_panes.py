"""Long windows from panes against the same windows from copied rows."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from querytide.operators import novelty, panes, traffic, volume
from querytide.operators.report_days import assign_report_days
from querytide.params import DAY, ReportParams
from querytide.plans import packet
from querytide.schemas import LOG_COLUMNS, LOG_SCHEMA

BERLIN = ReportParams(timezone="Europe/Berlin", off_hours_start="22:00", off_hours_end="05:30", wrap_off_hours=True, close_hour_utc=22)


def make_log(spark, times, **changes):
    columns = list(LOG_COLUMNS)
    rows = []
    for k, (when, client, domain) in enumerate(times):
        row = {
            "network_id": "n", "seq": -k, "time": when, "client": client, "domain": domain, "query_type": "A",
            "reason": "", "blocked": k % 5 == 0, "block_rule": f"r{k % 3}" if k % 5 == 0 else "",
        } | changes
        rows.append(tuple(row[c] for c in columns))
    return spark.createDataFrame(rows, LOG_SCHEMA)


@pytest.mark.parametrize("hours", [25, 36, 48, 72, 24 * 30])
@pytest.mark.parametrize("params", [ReportParams(), BERLIN])
def test_rollup_of_long_windows(spark, hours, params):
    """Over both changes of the clocks, with a gap that is longer than some windows."""
    start = datetime(2025, 3, 25, 12)
    times = [(start + timedelta(minutes=97 * k), f"c{k % 3}", f"d{k % 7}") for k in range(120)]
    times += [(datetime(2025, 10, 24) + timedelta(minutes=211 * k), f"c{k % 2}", f"d{k % 4}") for k in range(40)]
    params = replace(params, window_hours=hours)
    log = make_log(spark, times)
    copied = traffic.rollup(traffic.as_traffic(assign_report_days(log, params), params))
    found = panes.report_rollup(log, params).select(*copied.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, copied.collect()))


def test_windows_hold_few_rows_for_each_pane(spark):
    """A key's spans grow with its panes, not with the hours of the window."""
    day = datetime(2025, 6, 1, 3)
    log = make_log(spark, [(day + timedelta(days=k), "c", f"d{k % 2}") for k in (0, 1, 2, 40, 41, 200)])
    params = ReportParams(window_hours=24 * 100)
    rows = panes.pane_rollup(log, params)
    spans = panes.over_windows(rows, ["network_id", "domain"], params)
    assert rows.count() == 6 and spans.count() <= 12
    assert panes.by_report(spans, params).count() > 300
    plan = spans._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Generate" not in plan


def test_summary_of_long_windows(spark):
    day = datetime(2025, 6, 1, 3)
    log = make_log(spark, [(day + timedelta(hours=7 * k), f"c{k % 4}", f"d{k % 9}") for k in range(60)])
    params = ReportParams(window_hours=60)
    copied = traffic.summary(traffic.as_traffic(assign_report_days(log, params), params))
    found = panes.summary(panes.pane_rollup(log, params), params).select(*copied.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, copied.collect()))
    none = panes.pane_rollup(log.limit(0), params)
    assert panes.summary(none, params).count() == 0 and panes.top_domains(none, params).count() == 0


def findings(packets):
    new, unusual = set(), set()
    for row in packets.collect():
        new |= {(row.report_date, e.domain) for e in row.packet.new_domains}
        unusual |= {(row.report_date, e.client) for e in row.packet.volume_anomalies}
    return new, unusual


@pytest.mark.parametrize("hours", [24, 48])
def test_a_span_knows_the_days_before_it(spark, hours):
    """One domain every day, five queries a day and fifty on the tenth."""
    day = datetime(2026, 3, 1, 10)
    times = [(day + timedelta(days=d, minutes=m), "c", "old.example") for d in range(10) for m in range(50 if d == 9 else 5)]
    times.append((day + timedelta(days=9, hours=1), "c", "new.example"))
    params = ReportParams(window_hours=hours)
    log = make_log(spark, times)
    whole = findings(packet.backfill_packets(log, params))
    last = date(2026, 3, 10)
    new, unusual = findings(packet.backfill_packets(log, params, span=(last, last)))
    assert new == {r for r in whole[0] if r[0] == last} == {(last, "new.example")}
    assert unusual == {r for r in whole[1] if r[0] == last} == {(last, "c")}


def test_only_domains_that_reach_the_last_rank_are_ranked(spark, monkeypatch):
    """Domains below the k-th count of a window are not repeated for each report that sees them."""
    day = datetime(2025, 6, 1, 3)
    times = [(day + timedelta(days=d, minutes=m), "c", f"often{m % 4}") for d in range(12) for m in range(40)]
    times += [(day + timedelta(hours=k), "c", f"once{k}") for k in range(280)]
    params = ReportParams(window_hours=24 * 10, top_domains=3)
    log = make_log(spark, times, blocked=False)
    copied = traffic.top_domains(traffic.as_traffic(assign_report_days(log, params), params), 3)
    ranked = []
    keep_top = panes.keep_top
    monkeypatch.setattr(panes, "keep_top", lambda counts, *args: ranked.append(counts.count()) or keep_top(counts, *args))
    found = panes.top_domains(panes.pane_rollup(log, params), params).select(*copied.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, copied.collect()))
    assert ranked[0] <= 100


@pytest.mark.parametrize("hours", [24, 48, 60])
def test_top_domains_of_few_and_of_equal_counts(spark, hours):
    """Fewer domains than ranks, and more domains with the last rank's count than ranks."""
    day = datetime(2025, 6, 1, 3)
    times = [(day + timedelta(hours=5 * k), "c", f"d{k % 11:02d}") for k in range(60)]
    times += [(day + timedelta(days=40, hours=30 * k), "c", f"d{k % 2}") for k in range(4)]
    params = ReportParams(window_hours=hours, top_domains=4)
    log = make_log(spark, times)
    copied = traffic.top_domains(traffic.as_traffic(assign_report_days(log, params), params), 4)
    found = panes.top_domains(panes.pane_rollup(log, params), params).select(*copied.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, copied.collect()))


def test_keys_of_a_summary_are_shuffled_twice(spark):
    """What a window has is told from the panes that have a key, without their sums or their ends."""
    day = datetime(2025, 6, 1, 3)
    log = make_log(spark, [(day + timedelta(hours=7 * k), "c", f"d{k % 9}") for k in range(20)])
    params = ReportParams(window_hours=60)
    held = panes._present(panes.pane_rollup(log, params), "domain", "unique_domains", params)
    plan = held._jdf.queryExecution().sparkPlan().toString()
    assert "Union" not in plan and plan.count("Scan ExistingRDD") == 1


def test_long_windows_are_rolled_up_once(spark, monkeypatch):
    """The rollup by panes is a report's rollup already; without a span it is written as such."""
    day = datetime(2026, 3, 1, 10)
    times = [(day + timedelta(days=d, minutes=m), "c", f"d{m % 3}") for d in range(4) for m in range(9)]
    log, params = make_log(spark, times), ReportParams(window_hours=48)
    copied = packet.backfill_packets(assign_report_days(log, params), params).collect()
    written = []
    write = packet.write_and_read
    monkeypatch.setattr(packet, "write_and_read", lambda df, label: written.append(label) or write(df, label))
    found = packet.backfill_packets(log, params).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, copied))
    assert written.count("rollup") == 1 and "report-rollup" not in written
