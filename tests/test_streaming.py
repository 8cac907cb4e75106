from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from querytide.operators import novelty, report_days, volume
from querytide.operators.traffic import as_traffic
from querytide.params import ReportParams
from querytide.schemas import KNOWN_DOMAINS_SCHEMA
from querytide.sources.state_tables import StateTables
from querytide.streaming.files import append_available, log_stream
from querytide.streaming.late import LateDomains
from querytide.streaming.novelty import stream_novel_domains
from querytide.streaming.upkeep import StateUpkeep
from querytide.streaming.volume import stream_daily_volume

LOG = (
    "network_id string, seq bigint, time timestamp_ntz, client string, domain string, "
    "blocked boolean, block_rule string"
)
PARAMS = ReportParams(known_domains_window_days=3)
LAST_SEEN = 0  # the state operator of the alert stream that is last in its plan


def log_of(spark, times, client="c", domain="d"):
    return spark.createDataFrame(
        [("n", i, t, client, domain, False, "") for i, t in enumerate(times)], LOG
    )


@pytest.fixture
def paths(tmp_path):
    return {name: str(tmp_path / name) for name in ("in", "out", "state", "root")}


def deliver(log, paths, operator):
    spark = log.sparkSession
    log.write.mode("append").parquet(paths["in"])
    append_available(
        operator(log_stream(spark, paths["in"], log.schema)), paths["out"], paths["state"]
    )
    return spark.read.parquet(paths["out"])


def test_volume_is_final_and_late_rows_are_dropped(spark, paths):
    def day(d, h):
        return datetime(2026, 5, d, h)

    out = deliver(log_of(spark, [day(1, 9), day(1, 10), day(2, 9)]), paths, stream_daily_volume)
    assert {(r.report_date.day, r.query_count) for r in out.collect()} == {(1, 2)}
    # The watermark has passed the first report day: its late row no longer counts.
    out = deliver(log_of(spark, [day(1, 11), day(2, 10), day(4, 0)]), paths, stream_daily_volume)
    assert {(r.report_date.day, r.query_count) for r in out.collect()} == {(1, 2), (2, 2)}


def test_alerts_follow_the_window(spark, paths):
    """The second domain's state expires while only the first one is seen."""

    def operator(log):
        return stream_novel_domains(log, 3)

    def times(day):
        return [datetime(2026, 5, day, 9)] * 50

    for day in (1, 2, 6, 7, 8, 12, 20):
        log = log_of(spark, times(day), domain="often")
        if day in (1, 20):
            log = log.union(log_of(spark, times(day), domain="rare"))
        out = deliver(log, paths, operator)
        states = spark.read.format("statestore").option("operatorId", LAST_SEEN).load(paths["state"]).count()
        assert states == (1 if day in (8, 12) else 2)
    assert sorted((r.domain, r.report_date.day) for r in out.collect()) == [
        ("often", 1), ("often", 6), ("often", 12), ("often", 20), ("rare", 1), ("rare", 20),
    ]


def test_batches_give_the_state_of_a_batch_job(spark, paths):
    rows = [
        ("n", i, datetime(2026, 5, 1 + i % 20, i % 24), f"c{i % 7}", f"d{i * i % 61}", False, "")
        for i in range(2000)
    ]
    log = spark.createDataFrame(rows, LOG)
    upkeep = StateUpkeep(paths["root"], PARAMS, compact_every=2)
    for first, last in ((1, 5), (6, 10), (11, 15), (16, 20)):
        log.filter(F.dayofmonth("time").between(first, last)).write.mode("append").parquet(
            paths["in"]
        )
        stream = log_stream(spark, paths["in"], log.schema)
        upkeep.start(stream, paths["state"]).awaitTermination()
    frame = as_traffic(report_days.assign_report_days(log, PARAMS), PARAMS)
    sightings = novelty.first_sightings(frame)

    def rows_of(df, *columns):
        return sorted(df.select(*columns).collect())

    keys = ("network_id", "report_date", "client", "query_count")
    assert rows_of(upkeep.daily_volume(spark), *keys) == rows_of(volume.daily_volume(frame), *keys)
    alert = ("network_id", "report_date", "domain")
    assert rows_of(upkeep.alerts(spark), *alert) == rows_of(
        novelty.novel_over_history(sightings, 3), *alert
    )
    known = ("network_id", "domain", "first_seen", "last_seen")
    nothing = spark.createDataFrame(
        [], "network_id string, domain string, first_seen date, last_seen date"
    )
    assert rows_of(upkeep.known_domains(spark), *known) == rows_of(
        novelty.upsert_known_domains(nothing, sightings), *known
    )


def test_closed_days_feed_daily_runs(spark, paths):
    upkeep = StateUpkeep(paths["root"], PARAMS)
    upkeep(log_of(spark, [datetime(2026, 5, 1, 9)] * 3, domain="a"), 0)
    upkeep(log_of(spark, [datetime(2026, 5, 1, 10), datetime(2026, 5, 2, 9)], domain="b"), 1)
    state = StateTables(spark, paths["state"])
    upkeep.close_days(state, spark, [date(2026, 5, day) for day in (1, 2)])
    known = {r.domain: (r.first_seen.day, r.last_seen.day)
             for r in state.known_domains(date(2026, 5, 3)).collect()}
    assert known == {"a": (1, 1), "b": (1, 2)}
    assert {r.domain: r.last_seen.day for r in state.known_domains(date(2026, 5, 2)).collect()} == {
        "a": 1, "b": 1,
    }
    volumes = {r.report_date.day: r.query_count
               for r in state.daily_volume(date(2026, 5, 3)).collect()}
    assert volumes == {1: 4, 2: 1}


def test_repeated_batch_counts_once(spark, paths):
    upkeep = StateUpkeep(paths["root"], PARAMS, compact_every=2)
    first = log_of(spark, [datetime(2026, 5, 1, 9)] * 3)
    second = log_of(spark, [datetime(2026, 5, 1, 10)] * 2)
    upkeep(first, 0)
    for _ in range(3):
        upkeep(second, 1)
    upkeep(log_of(spark, [datetime(2026, 5, 1, 11)]), 2)
    assert [r.query_count for r in upkeep.daily_volume(spark).collect()] == [6]
    assert upkeep.alerts(spark).count() == 1


def test_late_rows_reopen_closed_days(spark, paths):
    upkeep = StateUpkeep(paths["root"], PARAMS)
    state = StateTables(spark, paths["state"])
    upkeep(log_of(spark, [datetime(2026, 5, 1, 9)] * 3, domain="a"), 0)
    upkeep(log_of(spark, [datetime(2026, 5, 2, 9)], domain="a"), 1)
    assert upkeep.reopened_days(spark) == []
    upkeep.close_days(state, spark, [date(2026, 5, 1), date(2026, 5, 2)])
    assert upkeep.reopened_days(spark) == []
    upkeep(log_of(spark, [datetime(2026, 5, 1, 8)] * 2, domain="late"), 2)
    assert upkeep.reopened_days(spark) == [date(2026, 5, 1)]
    assert {r.domain for r in upkeep.alerts(spark).collect()} == {"a", "late"}
    upkeep.close_days(state, spark, upkeep.reopened_days(spark))
    assert upkeep.reopened_days(spark) == []
    volumes = {r.report_date.day: r.query_count for r in state.daily_volume(date(2026, 5, 3)).collect()}
    assert volumes == {1: 5, 2: 1}
    assert {r.domain for r in state.known_domains(date(2026, 5, 2)).collect()} == {"a", "late"}


def test_streamed_volume_has_the_windows_of_the_batch(spark, paths):
    times = [datetime(2026, 5, d, h) for d in range(1, 6) for h in (3, 14, 16)]
    params = ReportParams(window_hours=48)
    log = log_of(spark, times)
    out = deliver(log, paths, lambda rows: stream_daily_volume(rows, params=params))
    batch = volume.daily_volume(as_traffic(report_days.assign_report_days(log, params), params))
    counted = {r.report_date: r.query_count for r in batch.collect()}
    streamed = {r.report_date: r.query_count for r in out.collect()}
    assert streamed and streamed == {day: n for day, n in counted.items() if day in streamed}
    assert set(counted) - set(streamed) == {date(2026, 5, 6), date(2026, 5, 7)}


def test_only_the_state_function_runs_in_python(spark, paths):
    log_of(spark, [datetime(2026, 5, 1, 9)]).write.parquet(paths["in"])
    stream = log_stream(spark, paths["in"], spark.read.parquet(paths["in"]).schema)
    plan = stream_novel_domains(stream, 3)._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" not in plan and plan.index("FlatMapGroupsInPandasWithState") < plan.index("Deduplicate")


def test_domain_eleven_days_late(spark, paths):
    """Never seen: alerted. Seen within the window before: not. A repeated batch and fold add nothing."""
    late, state = LateDomains(paths["root"], params=PARAMS), StateTables(spark, paths["state"])
    known = log_of(spark, [datetime(2026, 5, d, 9) for d in (3, 4, 15)], domain="known")
    late(known.filter("day(time) < 5"), 0)
    late(known.filter("day(time) > 5"), 1)
    arrived = log_of(spark, [datetime(2026, 5, 4, 9)] * 3, domain="never").union(
        log_of(spark, [datetime(2026, 5, 5, 9), datetime(2026, 5, 9, 9)], domain="known")
    )
    for _ in range(2):
        late(arrived, 2)
    state.record_domains(novelty.first_sightings(report_days.assign_report_days(known, PARAMS)))
    for _ in range(2):
        late.fold(spark, state, paths["out"], first_batch=2)
        found = spark.read.parquet(paths["out"]).collect()
        assert sorted((r.domain, r.report_date.day) for r in found) == [("known", 9), ("never", 4)]
    days = state.sightings(date(2026, 5, 1), date(2026, 6, 1)).collect()
    assert sorted((r.domain, r.report_date.day) for r in days) == [
        ("known", 3), ("known", 4), ("known", 5), ("known", 9), ("known", 15), ("never", 4),
    ]


def test_nothing_late(spark, paths):
    late, state = LateDomains(paths["root"], params=PARAMS), StateTables(spark, paths["state"])
    late(log_of(spark, [datetime(2026, 5, 4, 9)]), 0)
    late(log_of(spark, []), 1)
    late(log_of(spark, [datetime(2026, 5, 5, 9)]), 2)
    late.fold(spark, state, paths["out"])
    assert spark.read.parquet(paths["out"]).count() == 0
    assert late.late(spark).count() == 0


def test_folders_do_not_grow_with_batches(spark, paths):
    """Nineteen batches, one with a clock in 1970, the last merged one repeated twice."""
    upkeep = StateUpkeep(paths["root"], PARAMS, compact_every=3)
    times = [datetime(2026, 5, 1 + k, 9) for k in range(18)]
    times.insert(7, datetime(1970, 1, 1, 9))
    sizes = []
    for k, when in enumerate(times):
        batch = log_of(spark, [when], domain="daily").union(log_of(spark, [when], domain=f"d{k % 5}"))
        for _ in range(3 if k == 17 else 1):
            upkeep(batch, k)
        folders = [f for name in ("batches", "*/shares", "*/bases") for f in Path(paths["root"]).glob(f"{name}/batch=*")]
        sizes.append(len(folders))
    assert max(sizes[6:]) <= 18 and max(sizes[13:]) <= max(sizes[6:13])
    log = spark.createDataFrame(
        [("n", 1, t, "c", d, False, "") for k, t in enumerate(times) for d in ("daily", f"d{k % 5}")], LOG
    )
    sightings = novelty.first_sightings(report_days.assign_report_days(log, PARAMS))
    nothing = spark.createDataFrame([], KNOWN_DOMAINS_SCHEMA)
    expected = novelty.upsert_known_domains(nothing, sightings)
    columns = ("network_id", "domain", "first_seen", "last_seen")
    assert sorted(upkeep.known_domains(spark).select(*columns).collect()) == sorted(expected.select(*columns).collect())
    assert sorted(r.query_count for r in upkeep.daily_volume(spark).collect()) == [2] * 19
    upkeep.forget_days(spark, date(2026, 5, 10))
    left = {p.name for p in Path(paths["root"]).glob("counts/report_date=*")}
    assert left and min(left) == "report_date=2026-05-10"
