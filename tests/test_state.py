from __future__ import annotations

import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from querytide.operators import novelty, volume
from querytide.operators.traffic import as_traffic
from querytide.params import ReportParams
from querytide.plans.daily import run_report
from querytide.sources.archive import read_packets
from querytide.sources.state_tables import StateTables

TODAY = date(2026, 5, 8)
SIGHTING = "network_id string, report_date date, domain string"
VOLUME = "network_id string, report_date date, client string, query_count bigint"


def sightings(spark, rows):
    return spark.createDataFrame([("n", day, name) for day, name in rows], SIGHTING)


def test_without_state_each_domain_is_new(spark, workdir):
    state = StateTables(spark, workdir)
    today = sightings(spark, [(TODAY, f"site{k}") for k in range(7)])
    found = novelty.novel_against_state(today, state.known_domains(TODAY))
    assert {r.domain for r in found.collect()} == {f"site{k}" for k in range(7)}


@pytest.mark.parametrize("gap, is_new", [(2, False), (17, False), (30, False), (31, True), (90, True)])
def test_window_edge(spark, workdir, gap, is_new):
    state = StateTables(spark, workdir)
    earlier = TODAY - timedelta(days=gap)
    state.record_domains(sightings(spark, [(earlier, "old")]))
    today = sightings(spark, [(TODAY, "old"), (TODAY, "fresh")])
    found = novelty.novel_against_state(today, state.known_domains(TODAY, 30), 30)
    assert {r.domain for r in found.collect()} == ({"old", "fresh"} if is_new else {"fresh"})
    history = novelty.novel_over_history(sightings(spark, [(earlier, "old"), (TODAY, "old")]), 30)
    assert (history.filter(F.col("report_date") == F.lit(TODAY)).count() == 1) is is_new


def test_upsert_keeps_first_and_never_moves_back(spark):
    known = spark.createDataFrame(
        [("n", "a", date(2026, 5, 1), date(2026, 5, 5))],
        "network_id string, domain string, first_seen date, last_seen date",
    )
    new = sightings(spark, [(date(2026, 5, 3), "a"), (date(2026, 5, 3), "a"), (TODAY, "b")])
    rows = {r.domain: r for r in novelty.upsert_known_domains(known, new).collect()}
    assert (rows["a"].first_seen, rows["a"].last_seen) == (date(2026, 5, 1), date(2026, 5, 5))
    assert (rows["b"].first_seen, rows["b"].last_seen) == (TODAY, TODAY)


def reports(spark, *keys):
    return spark.createDataFrame(keys, "network_id string, report_date date")


def test_networks_are_recorded_apart(spark, workdir):
    state = StateTables(spark, workdir)
    networks = [f"n{k}" for k in range(40)]  # more than there are folders for a date
    for name in networks[:3]:
        state.record_domains(spark.createDataFrame([(name, TODAY, "a"), (name, TODAY, "b")], SIGHTING))
    state.record_domains(spark.createDataFrame([(name, TODAY, "c") for name in networks[3:]], SIGHTING))
    state.record_domains(spark.createDataFrame([("n1", TODAY, "z")], SIGHTING))
    tomorrow = TODAY + timedelta(days=1)
    found = {(r.network_id, r.domain) for r in state.known_domains(tomorrow).collect()}
    expected = {("n0", "a"), ("n0", "b"), ("n2", "a"), ("n2", "b"), ("n1", "z")}
    assert found == expected | {(name, "c") for name in networks[3:]}


def test_a_report_can_become_empty(spark, workdir):
    state = StateTables(spark, workdir)
    state.record_domains(sightings(spark, [(TODAY, "a")]))
    state.record_volume(volumes(spark, [(TODAY, "c", 5)]))
    asked = reports(spark, ("n", TODAY))
    state.record_domains(sightings(spark, []), asked)
    state.record_volume(volumes(spark, []), asked)
    assert state.known_domains(date.max).count() == state.daily_volume(date.max, None).count() == 0


def test_late_runs_of_older_days_count(spark, workdir):
    state = StateTables(spark, workdir)
    older, day = TODAY - timedelta(days=2), TODAY - timedelta(days=1)
    state.record_domains(sightings(spark, [(older, "a")]))
    state.record_domains(sightings(spark, [(day, "a"), (day, "b")]))
    state.record_domains(sightings(spark, [(older, "a"), (older, "late")]))
    known = {r.domain: (r.first_seen, r.last_seen) for r in state.known_domains(TODAY).collect()}
    assert known == {"a": (older, day), "b": (day, day), "late": (older, older)}
    state.record_domains(sightings(spark, [(older, "a")]))
    assert {r.domain for r in state.known_domains(TODAY, 30).collect()} == {"a", "b"}
    assert {r.domain for r in state.known_domains(day).collect()} == {"a"}


def simulate(days, window):
    """Day-by-day state as a dictionary."""
    last, new = {}, set()
    for day in sorted({d for d, _ in days}):
        for name in {n for d, n in days if d == day}:
            if name not in last or (day - last[name]).days > window:
                new.add((day, name))
            last[name] = day
    return new


@pytest.mark.parametrize("window", [0, 1, 3, 7])
def test_novelty_equals_a_simulation(spark, window):
    rng = random.Random(window)
    days = {
        (date(2026, 1, 1) + timedelta(days=rng.randrange(40)), f"d{rng.randrange(30)}")
        for _ in range(250)
    }
    rows = sightings(spark, sorted(days))
    found = {(r.report_date, r.domain) for r in novelty.novel_over_history(rows, window).collect()}
    assert found == simulate(days, window)
    cut = date(2026, 1, 20)
    known = novelty.upsert_known_domains(
        spark.createDataFrame([], "network_id string, domain string, first_seen date, last_seen date"),
        rows.filter(F.col("report_date") < F.lit(cut)),
    )
    later = novelty.novel_after_state(rows.filter(F.col("report_date") >= F.lit(cut)), known, window)
    assert {(r.report_date, r.domain) for r in later.collect()} == {
        pair for pair in found if pair[0] >= cut
    }


def test_days_older_than_the_state_are_known(spark):
    known = spark.createDataFrame(
        [("n", "a", TODAY, TODAY)],
        "network_id string, domain string, first_seen date, last_seen date",
    )
    late = sightings(spark, [(TODAY - timedelta(days=60), "a"), (TODAY, "a")])
    assert novelty.novel_after_state(late, known, 30).count() == 0


def volumes(spark, rows):
    return spark.createDataFrame([("n", *row) for row in rows], VOLUME)


def test_baseline_leaves_out_its_own_day_and_older_ones(spark, workdir):
    steady = {TODAY - timedelta(days=d): 37 for d in (1, 4, 6, 10)}
    rising = {TODAY - timedelta(days=d): 500 - 31 * d for d in range(1, 11)}
    rows = [(day, "steady", n) for day, n in steady.items()]
    rows += [(day, "rising", n) for day, n in rising.items()]
    rows += [(TODAY, "steady", 4), (TODAY - timedelta(days=11), "steady", 1), (TODAY, "unknown", 8)]
    state = StateTables(spark, workdir)
    state.record_volume(volumes(spark, rows))
    found = volume.baseline_for_date(state.daily_volume(TODAY, 10), TODAY, 10).collect()
    base = {r.client: (r["mean"], r.stddev, r.days) for r in found}
    assert base["steady"] == (37.0, 0.0, 4)
    past = list(rising.values())
    assert base["rising"] == pytest.approx((statistics.fmean(past), statistics.pstdev(past), 10))
    assert "unknown" not in base
    window = volume.trailing_baseline(volumes(spark, rows), 10).filter(
        (F.col("report_date") == F.lit(TODAY)) & (F.col("client") == "steady")
    )
    assert [(r["mean"], r.stddev, r.days) for r in window.collect()] == [(37.0, 0.0, 4)]


def test_baseline_equals_brute_force(spark):
    rng = random.Random(5)
    counts = {
        (TODAY + timedelta(days=rng.randrange(60)), f"c{rng.randrange(5)}"): rng.randrange(1, 10**6)
        for _ in range(160)
    }
    got = {
        (r.report_date, r.client): (r["mean"], r.stddev, r.days)
        for r in volume.trailing_baseline(
            volumes(spark, [(d, c, n) for (d, c), n in counts.items()]), 14
        ).collect()
    }
    want = {}
    for day, client in counts:
        past = [
            n for (d, c), n in counts.items() if c == client and 1 <= (day - d).days <= 14
        ]
        if past:
            want[(day, client)] = (statistics.fmean(past), statistics.pstdev(past), len(past))
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


@pytest.mark.parametrize(
    "count, mean, stddev, z",
    [
        (4, 2.0, 1.0, 2.0),       # exactly on the limit
        (0, 2.0, 1.0, -2.0),
        (3, 2.0, 1.0, None),
        (30, 10.0, 100.0, 0.2),   # ordinary in deviations, but three times the mean
        (29, 10.0, 100.0, None),
        (30, 10.0, 0.0, 2.0),     # no deviation: relative change
        (29, 10.0, 0.0, None),
        (5, 0.0, 0.0, 0.0),       # nothing to compare with: always reported
    ],
)
def test_anomaly_rule(spark, count, mean, stddev, z):
    row = spark.createDataFrame(
        [("n", TODAY, "c", count, mean, stddev, 14)],
        VOLUME + ", mean double, stddev double, days bigint",
    )
    found = [r.z_score for r in volume.volume_anomalies(row).collect()]
    assert found == ([] if z is None else [z])


def test_volume_writes_replace_or_merge(spark, workdir):
    state = StateTables(spark, workdir)
    before = TODAY - timedelta(days=1)
    state.record_volume(volumes(spark, [(TODAY, "a", 1), (TODAY, "b", 2), (before, "a", 7)]))
    state.merge_volume(volumes(spark, [(TODAY, "a", 10)]))

    def stored():
        rows = state.daily_volume(TODAY + timedelta(days=1)).collect()
        return sorted((r.report_date, r.client, r.query_count) for r in rows)

    assert stored() == [(before, "a", 7), (TODAY, "a", 10), (TODAY, "b", 2)]
    state.record_volume(volumes(spark, [(TODAY, "a", 11)]))
    assert stored() == [(before, "a", 7), (TODAY, "a", 11)]


def test_daily_runs_can_be_repeated(spark, tmp_path):
    """Three runs in order, then the last one again: same packet, same state."""
    rows = [
        ("n", i, datetime(2026, 5, 5 + i % 3, 10, 0, i % 60), f"c{i % 4}", f"d{i % 7 + i % 3}",
         "A", "", False, "")
        for i in range(300)
    ]
    log = spark.createDataFrame(
        rows,
        "network_id string, seq bigint, time timestamp_ntz, client string, domain string, "
        "query_type string, reason string, blocked boolean, block_rule string",
    )
    state = StateTables(spark, str(tmp_path / "state"))
    networks = spark.createDataFrame([("n",), ("silent",)], "network_id string")

    def run(day):
        now = datetime(2026, 5, day, 15)
        packets = run_report(
            log, now, date(2026, 5, day), state, ReportParams(known_domains_window_days=2),
            networks=networks, packet_path=str(tmp_path / "packets"),
        )
        return {r.network_id: r.packet for r in packets.collect()}

    run(5)
    second = run(6)["n"]
    assert {d.domain for d in second.new_domains} == {"d7"}
    first_time = run(7)
    again = run(7)
    assert first_time == again
    assert again["silent"].summary.total_queries == 0
    assert again["silent"].summary.total_blocked is None
    assert again["silent"].top_domains == []
    assert state.known_domains(date(2026, 5, 8)).count() == 9
    assert read_packets(spark, str(tmp_path / "packets")).count() == 6


def test_first_client_is_the_newest_in_arrival_order(spark):
    time = datetime(2026, 5, 8, 10)
    log = spark.createDataFrame(
        [
            ("n", TODAY, 3, time, "oldest"), ("n", TODAY, 0, time, "newest"),
            ("n", TODAY, 1, time, "between"), ("n", TODAY, 9, datetime(2026, 5, 8, 9), "earlier"),
        ],
        "network_id string, report_date date, seq bigint, time timestamp_ntz, client string",
    ).withColumns({
        "domain": F.lit("d"), "blocked": F.lit(False), "block_rule": F.lit(""),
    })
    frame = as_traffic(log)
    assert novelty.domain_days(frame).collect()[0].first_client == "newest"
    assert novelty.domain_days(frame, "earliest").collect()[0].first_client == "earlier"
    with pytest.raises(ValueError):
        novelty.domain_days(frame, "any")
