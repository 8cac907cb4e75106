from __future__ import annotations

import json
import random
from collections import Counter
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from querytide.functions import scalar
from querytide.operators import devices, enforcement, fingerprints, messages, traffic
from querytide.operators.paging import paginate
from querytide.operators.report_days import report_calendar
from querytide.params import ReportParams
from querytide.plans import packet, reports
from querytide.sources import archive, side_inputs

DAY = date(2026, 5, 8)


# Time.


@pytest.mark.parametrize("zone", ["America/New_York", "America/Phoenix", "Europe/Berlin", "Asia/Kolkata"])
@pytest.mark.parametrize("day", [date(2024, 3, 10), date(2024, 3, 31), date(2024, 11, 3), date(2024, 10, 27)])
@pytest.mark.parametrize("clock", ["01:00", "01:30", "02:30", "05:00"])
def test_local_instants_like_zoneinfo(spark, zone, day, clock):
    hour, minute = map(int, clock.split(":"))
    want = datetime(day.year, day.month, day.day, hour, minute, tzinfo=ZoneInfo(zone))
    row = spark.range(1).select(
        scalar.local_instant(F.lit(day), clock, zone).alias("utc")
    ).collect()[0]
    assert row.utc == want.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def test_local_clock_and_date(spark):
    time = F.lit("2024-11-03 06:30:00").cast("timestamp_ntz")
    row = spark.range(1).select(
        scalar.local_hhmm(time, "America/New_York").alias("c"),
        scalar.local_date(time, "Asia/Tokyo").alias("d"),
    ).collect()[0]
    assert (row.c, row.d) == ("01:30", date(2024, 11, 3))


def off_hours(spark, start, end, wrap=False):
    log = spark.sql(
        f"SELECT 'n' AS network_id, DATE'{DAY}' AS report_date, id AS seq, '' AS client,"
        "'' AS domain, false AS blocked, '' AS block_rule,"
        "timestamp_ntz'2026-05-07 15:00:00' + make_dt_interval(0, id) AS time FROM range(24)"
    )
    params = ReportParams(off_hours_start=start, off_hours_end=end, wrap_off_hours=wrap)
    rows = traffic.as_traffic(log, params).filter("off_hours").collect()
    return sorted(r.first_time for r in rows)


def test_off_hours_are_half_open(spark):
    assert [t.hour for t in off_hours(spark, "01:00", "05:00")] == [8, 9, 10, 11]


def test_off_hours_do_not_wrap_unless_asked(spark):
    assert off_hours(spark, "22:00", "05:00") == []
    wrapped = off_hours(spark, "22:00", "05:00", wrap=True)
    assert [t.hour for t in wrapped] == [5, 6, 7, 8, 9, 10, 11]


# Small expressions.


def test_scalars(spark):
    day = F.lit(DAY)
    row = spark.range(1).select(
        scalar.os_label(F.lit("Linux"), F.lit("5.x")).alias("a"),
        scalar.os_label(F.lit(None).cast("string"), F.lit("5.x")).alias("b"),
        scalar.os_label(F.lit(" "), F.lit("")).alias("c"),
        scalar.iso_date(day).alias("d"),
        scalar.storage_key(day).alias("e"),
        scalar.long_date(day).alias("f"),
        scalar.blocked_percent(F.lit(5), F.lit(16)).alias("g"),
        scalar.blocked_percent(F.lit(None).cast("bigint"), F.lit(0)).alias("h"),
    ).collect()[0]
    assert tuple(row) == (
        "Linux 5.x", "5.x", "unknown", "2026-05-08", "2026/05/08", "Friday, May 8, 2026",
        "31.2%", "0.0%",
    )


# Devices.


def test_overlay_and_labels(spark):
    columns = "network_id string, ip string, device string"
    base = spark.createDataFrame([("n", "1", "base one"), ("n", "2", "base two")], columns)
    local = spark.createDataFrame([("n", "2", "mine"), ("m", "1", "other")], columns)
    names = devices.overlay_devices(base, local)
    rows = spark.createDataFrame(
        [("n", "1"), ("n", "2"), ("n", "3"), ("m", "1")], "network_id string, client string"
    )
    got = {(r.network_id, r.client): r.device for r in devices.label_clients(rows, names).collect()}
    assert got == {
        ("n", "1"): "base one", ("n", "2"): "mine", ("n", "3"): "3", ("m", "1"): "other",
    }
    assert devices.label_clients(rows, None).filter("device <> client").count() == 0


# Counters.


def samples(spark, values, proto="udp"):
    rows = [("n", proto, datetime(2026, 5, 8, h, m), p, b) for h, m, p, b in values]
    return spark.createDataFrame(
        rows, "network_id string, proto string, sample_time timestamp_ntz, packets bigint, bytes bigint"
    )


def test_counter_deltas_with_reset_and_gaps(spark):
    readings = samples(
        spark, [(0, 5, 10, 100), (0, 30, 15, 150), (4, 0, 20, 180), (4, 1, 3, 30), (9, 0, 3, 31)]
    )
    for bucket in ("minute", "hour", "day"):
        rows = enforcement.counter_deltas(readings, bucket=bucket).orderBy("sample_time").collect()
        assert [r.packets_delta for r in rows] == [10, 5, 5, 3, 0]
        assert [r.bytes_delta for r in rows] == [100, 50, 30, 30, 1]


def test_intercept_sections(spark):
    day = F.lit(DAY).alias("report_date")
    one = enforcement.intercept_stats(
        samples(spark, [(1, 0, 4, 40), (2, 0, 6, 60)]).select("*", day)
    ).collect()[0]
    assert (one.udp_queries, one.tcp_queries, one.intercepted_queries, one.intercepted_bytes) == (
        10, 0, 10, 100,
    )
    gate = spark.createDataFrame(
        [("a", DAY, True, 5), ("b", DAY, True, 0), ("c", DAY, False, 5), ("d", DAY, None, 5),
         ("e", DAY, True, None)],
        "network_id string, report_date date, available boolean, intercepted_queries bigint",
    )
    assert [r.network_id for r in enforcement.intercept_gate(gate).collect()] == ["a"]


def test_counter_deltas_equal_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for network in ("a", "b"):
        for proto in ("udp", "tcp"):
            before = None
            minutes = sorted(rng.sample(range(6 * 24 * 60), 300))
            for minute in minutes:
                value = rng.randrange(50) if rng.random() < 0.1 else (before or 0) + rng.randrange(9)
                time = datetime(2026, 5, 1) + timedelta(minutes=minute)
                rows.append((network, proto, time, value, 2 * value))
                grown = value if before is None or value < before else value - before
                want[(network, proto, time)] = grown
                before = value
    readings = spark.createDataFrame(
        rows, "network_id string, proto string, sample_time timestamp_ntz, packets bigint, bytes bigint"
    )
    got = enforcement.counter_deltas(readings).collect()
    assert {(r.network_id, r.proto, r.sample_time): r.packets_delta for r in got} == want
    assert all(r.bytes_delta == 2 * r.packets_delta for r in got)


def test_readings_become_daily_stats(spark):
    readings = samples(spark, [(14, 0, 10, 100), (14, 30, 30, 300), (16, 0, 35, 350), (17, 0, 2, 20)])
    stats = enforcement.intercept_stats(enforcement.daily_growth(readings))
    rows = {r.report_date.day: (r.intercepted_queries, r.intercepted_bytes) for r in stats.collect()}
    assert rows == {8: (30, 300), 9: (7, 70)}


def test_firewall_listing(spark):
    lines = [
        "Chain REDIRECT_DNS (1 references)",
        "    pkts      bytes target     prot opt in     out     source               destination",
        "     120     8400 REDIRECT   17   --  *      *       0.0.0.0/0            0.0.0.0/0            udp dpt:53 redir ports 53",
        "       3      180 REDIRECT   6    --  *      *       0.0.0.0/0            0.0.0.0/0            tcp dpt:53 redir ports 53",
        "       9      999 RETURN     17   --  *      *       10.0.0.2             0.0.0.0/0            udp dpt:5353",
        "",
    ]
    listing = spark.createDataFrame(
        [("n", datetime(2026, 5, 8, 9), line) for line in lines],
        "network_id string, sample_time timestamp_ntz, line string",
    )
    rows = side_inputs.parse_counter_listing(listing)
    assert {(r.proto, r.packets, r.bytes) for r in rows.collect()} == {
        ("udp", 120, 8400), ("tcp", 3, 180),
    }
    day = rows.withColumn("report_date", F.lit(DAY))
    assert enforcement.intercept_stats(day).collect()[0].intercepted_queries == 123


# Optional inputs.


def test_missing_and_broken_side_inputs(spark, tmp_path):
    assert side_inputs.read_intercept_stats(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "broken.json").write_text("{ not json")
    broken = side_inputs.read_intercept_stats(spark, str(tmp_path), layout="documents")
    assert enforcement.intercept_gate(broken).count() == 0
    assert fingerprints.snapshot_gate(
        side_inputs.read_fingerprint_snapshots(spark, str(tmp_path), layout="documents")
    ).count() == 0


def test_documents_as_written_by_other_tools(spark, tmp_path):
    (tmp_path / "snapshot.json").write_text(json.dumps({
        "network_id": "n", "report_date": "2026-05-08", "available": True,
        "devices": [
            {"ip": "1", "first_seen": "a", "last_seen": "b", "os": "Linux", "http_os": "",
             "distance_hops": 1, "uptime_min": 2},
            {"ip": "2", "os": "unknown"},
        ],
        "recent_changes": [{"ip": "2", "detected_at": "t", "previous_os": "x", "current_os": "y"}],
    }, indent=2))
    names = spark.createDataFrame([("n", "2", "Box")], "network_id string, ip string, device string")
    section = fingerprints.profile_section(
        side_inputs.read_fingerprint_snapshots(spark, str(tmp_path), layout="documents"), names
    ).collect()[0]
    assert [(d.ip, d.device, d.link_type) for d in section.devices] == [
        ("1", "1", None), ("2", "Box", None),
    ]
    assert [(c.ip, c.device) for c in section.recent_changes] == [("2", "Box")]


def test_snapshot_pages_and_last_changes(spark):
    seen = spark.sql(
        f"SELECT 'n' AS network_id, DATE'{DAY}' AS report_date, concat('ip', id) AS ip,"
        "timestamp_ntz'2026-05-01 00:00:00' AS first_seen,"
        "timestamp_ntz'2026-05-01 00:00:00' + make_dt_interval(id % 5, 0, 0, id) AS last_seen,"
        "'os' AS os_name, '' AS os_flavor, '' AS http_name, 1 AS distance, 1 AS uptime_min "
        "FROM range(100)"
    )
    changed = spark.sql(
        f"SELECT 'n' AS network_id, DATE'{DAY}' AS report_date, concat('ip', id) AS ip,"
        "timestamp_ntz'2026-05-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS detected_at,"
        "'a' AS previous_os, 'b' AS current_os FROM range(50)"
    )
    (one,) = fingerprints.fingerprint_snapshot(seen, changed).collect()
    times = [d.last_seen for d in one.devices]
    assert len(times) == 100 and times == sorted(times, reverse=True)
    assert [c.ip for c in one.recent_changes] == [f"ip{i}" for i in range(49, 29, -1)]
    pages = fingerprints.fingerprint_snapshot(seen, changed, page_size=30).collect()
    assert len(pages) > 1 and sum(len(p.devices) for p in pages) == 100
    assert {d.ip for p in pages for d in p.devices} == {f"ip{i}" for i in range(100)}


# Pages of long lists.


def test_pages_are_whole_bounded_and_ordered(spark):
    rows = spark.sql(
        "SELECT 'n' AS network_id, id AS key, CAST(CASE WHEN id < 4000 THEN 1 ELSE id % 50 + 2 END"
        " AS BIGINT) AS weight FROM range(5000)"
    ).unionByName(spark.sql("SELECT 'small' AS network_id, id AS key, id AS weight FROM range(10)"))
    paged = paginate(rows, ["network_id"], [-F.col("weight"), F.col("key")], 500).collect()
    for name in ("n", "small"):
        own = sorted((-r.weight, r.key, r.rank, r.page) for r in paged if r.network_id == name)
        assert [rank for _, _, rank, _ in own] == list(range(len(own)))
        assert all(page == rank // 500 for _, _, rank, page in own)
    assert len(paged) == 5010


def test_rows_that_tie_have_ranks_of_their_own(spark):
    rows = spark.sql("SELECT 'n' AS network_id, 1 AS key, id % 3 AS other FROM range(300)")
    ranks = [r.rank for r in paginate(rows, ["network_id"], [F.col("key")], 10).collect()]
    assert sorted(ranks) == list(range(300))


def test_long_packets_are_split_but_whole(spark):
    log = spark.sql(
        f"SELECT 'n' AS network_id, DATE'{DAY}' AS report_date, id AS seq,"
        "timestamp_ntz'2026-05-08 09:00:00' + make_dt_interval(0, 0, 0, id) AS time,"
        "concat('c', id % 120) AS client, concat('d', id) AS domain, false AS blocked,"
        "'' AS block_rule FROM range(600)"
    )
    whole = packet.backfill_packets(log)
    split = packet.backfill_packets(log, ReportParams(page_size=50))
    (one,) = whole.collect()
    parts = {r.page: r.packet for r in split.collect()}
    assert len(parts) >= 12
    assert [p for p, part in parts.items() if part.summary is not None] == [0]

    def gathered(pick):
        return [e for page in sorted(parts) for e in pick(parts[page])]

    for pick in (
        lambda p: p.per_client, lambda p: p.new_domains, lambda p: p.off_hours_activity.by_device,
    ):
        assert gathered(pick) == list(pick(one.packet))
    assert parts[0].top_domains == one.packet.top_domains
    (headline,) = packet.headline_stats(split).collect()
    assert headline.total_queries == 600


# Empty days and optional sections.


def test_empty_days_are_kept(spark):
    log = spark.sql(
        "SELECT 'n' AS network_id, explode(array(DATE'2026-05-01', DATE'2026-05-04')) AS report_date,"
        "0L AS seq, timestamp_ntz'2026-05-01 09:00:00' AS time, 'c' AS client, 'd' AS domain,"
        "true AS blocked, 'r' AS block_rule"
    )
    rows = {r.report_date.day: r.packet for r in packet.backfill_packets(log).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    empty = rows[2]
    assert (empty.summary.date, empty.summary.total_queries, empty.summary.total_blocked) == (
        "2026-05-02", 0, None,
    )
    assert empty.per_client == [] and empty.off_hours_activity.total_queries == 0
    calendar = report_calendar(log, F.lit(date(2026, 4, 30)), F.lit(date(2026, 5, 5)))
    assert calendar.count() == 6
    span = (date(2026, 4, 30), date(2026, 5, 5))
    assert packet.backfill_packets(log, span=span).count() == 6


def test_optional_sections_are_absent_keys(spark):
    log = spark.sql(
        "SELECT explode(array('with', 'without')) AS network_id, DATE'2026-05-01' AS report_date,"
        "0L AS seq, timestamp_ntz'2026-05-01 09:00:00' AS time, 'c' AS client, 'd' AS domain,"
        "false AS blocked, '' AS block_rule"
    )
    stats = spark.createDataFrame(
        [("with", date(2026, 5, 1), True, "t", 7, 70, None, 7), ("elsewhere", DAY, True, "t", 1, 1, 1, 0)],
        "network_id string, report_date date, available boolean, timestamp string, "
        "intercepted_queries bigint, intercepted_bytes bigint, udp_queries bigint, tcp_queries bigint",
    )
    rows = packet.backfill_packets(log, intercepts=stats)
    documents = {
        r.network_id: json.loads(r.packet_json) for r in archive.packet_documents(rows).collect()
    }
    assert set(documents) == {"with", "without"}
    assert "dns_enforcement" not in documents["without"]
    section = documents["with"]["dns_enforcement"]
    assert (section["intercepted_queries"], section["udp_queries"]) == (7, 0)
    assert list(documents["without"]) == [
        "summary", "top_domains", "per_client", "off_hours_activity", "new_domains",
        "volume_anomalies", "blocked_domains",
    ]


def test_top_lists_count_answered_queries_only(spark):
    log = spark.sql(
        "SELECT 'n' AS network_id, DATE'2026-05-08' AS report_date, id AS seq,"
        "timestamp_ntz'2026-05-08 09:00:00' AS time, 'c' AS client, concat('d', id % 3) AS domain,"
        "id % 3 = 0 AS blocked, '' AS block_rule FROM range(30)"
    )
    rows = traffic.as_traffic(log)
    assert [r.domain for r in traffic.top_domains(rows).orderBy("rank").collect()] == ["d1", "d2"]
    assert traffic.client_top_domains(rows).count() == 2
    assert traffic.off_hours_domains(rows).count() == 3


def test_empty_log(spark):
    log = spark.sql(
        "SELECT '' AS network_id, DATE'2026-05-08' AS report_date, 0L AS seq,"
        "timestamp_ntz'2026-05-08 09:00:00' AS time, '' AS client, '' AS domain,"
        "false AS blocked, '' AS block_rule WHERE 1 = 0"
    )
    assert packet.backfill_packets(log).count() == 0


# Messages.


def events(spark, *bodies):
    return spark.createDataFrame(
        [("r", i, json.dumps(body)) for i, body in enumerate(bodies)],
        "response_id string, seq bigint, body string",
    )


def piece(text):
    return {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": text}}


def stop(reason):
    return {"type": "message_delta", "delta": {"stop_reason": reason}}


def test_response_is_joined_in_order(spark):
    words = ["Two ", "new ", "domains, ", "no ", "alarm."]
    rows = events(spark, {"type": "ping"}, *map(piece, words), {"type": "message_start"}, stop("end_turn"))
    shuffled = rows.orderBy(F.xxhash64("seq"))
    assert [r.text for r in messages.response_texts(shuffled).collect()] == ["".join(words)]
    (row,) = messages.response_stops(rows).collect()
    assert (row.stop_reason, row.truncated) == ("end_turn", False)


def test_long_response_is_joined_in_runs(spark):
    bodies = [piece(f"{i:05d}") for i in range(1000)]
    rows = events(spark, *bodies).repartition(7)
    want = "".join(f"{i:05d}" for i in range(1000))
    for run_length in (3, 64, 4096):
        assert messages.response_texts(rows, run_length).collect()[0].text == want


def test_truncated_response(spark):
    rows = events(spark, piece("cut"), stop("end_turn"), stop("max_tokens"))
    assert messages.response_stops(rows).collect()[0].truncated
    with pytest.raises(Exception, match="response cut off"):
        messages.response_stops(rows, strict=True).collect()
    no_stop = events(spark, piece("open"))
    assert messages.response_stops(no_stop, strict=True).collect()[0].truncated is False


# The archive.


def test_dated_files(spark, tmp_path):
    for name, text in [
        ("2026-05-07.md", "seven"), ("2026-05-08.md", "eight\nlines"), ("latest.md", "x"),
        ("2026-05-08.html", "y"), ("index.html", "z"), ("2026-13-45.md", "no date"),
    ]:
        (tmp_path / name).write_text(text)
    rows = archive.read_dated_files(spark, str(tmp_path)).orderBy("report_date").collect()
    assert [(r.report_date.day, r.report) for r in rows] == [(7, "seven"), (8, "eight\nlines")]
    index = archive.dated_file_index(spark, str(tmp_path)).collect()
    assert [r.file_name for r in index] == ["2026-05-08.md", "2026-05-07.md"]


def test_archive_replaces_dates(spark, workdir):
    columns = "network_id string, report_date date, report string"
    first = [("a", date(2026, 5, 7), "old"), ("a", DAY, "old"), ("b", DAY, "other"), ("c", date(2026, 5, 7), "only")]
    archive.write_reports(spark.createDataFrame(first, columns), workdir)
    archive.write_reports(spark.createDataFrame([("a", DAY, "new")], columns), workdir)
    reports = archive.read_reports(spark, workdir)
    assert reports.count() == 4
    latest = {r.network_id: r.report for r in archive.latest_reports(reports).collect()}
    assert latest == {"a": "new", "b": "other", "c": "only"}
    index = archive.archive_index(reports).collect()
    assert (index[0].report_date, index[0].storage_key) == (DAY, "2026/05/08")


# From prompts to reports.


def test_reports_are_whole_or_absent(spark, tmp_path):
    asked = spark.createDataFrame(
        [("a/0", "a", DAY, 0), ("a/1", "a", DAY, 1), ("b/0", "b", DAY, 0), ("c/0", "c", DAY, 0)],
        "response_id string, network_id string, report_date date, page bigint",
    )
    bodies = [
        ("a/1", 0, piece("second")), ("a/1", 1, stop("end_turn")),
        ("a/0", 0, piece("first")), ("a/0", 1, stop("end_turn")),
        ("b/0", 0, piece("cut")), ("b/0", 1, stop("max_tokens")),
    ]
    rows = spark.createDataFrame(
        [(r, i, json.dumps(body)) for r, i, body in bodies],
        "response_id string, seq bigint, body string",
    )
    done = reports.reports_from_responses(asked, rows, strict=False).collect()
    assert sorted((r.network_id, r.page, r.report) for r in done) == [
        ("a", 0, "first"), ("a", 1, "second"),
    ]
    with pytest.raises(Exception, match="response cut off"):
        reports.reports_from_responses(asked, rows).collect()
    answered = rows.filter("response_id <> 'b/0'")
    with pytest.raises(Exception, match="no response"):
        reports.reports_from_responses(asked, answered).collect()
    archive.write_reports(
        reports.reports_from_responses(asked.filter("network_id = 'a'"), answered),
        str(tmp_path / "reports"),
    )
    assert archive.read_reports(spark, str(tmp_path / "reports")).count() == 2


def test_dated_files_into_the_archive(spark, tmp_path):
    (tmp_path / "2026-05-07.md").write_text("seven")
    reports.import_dated_files(spark, str(tmp_path), "home", str(tmp_path / "archive"))
    (row,) = archive.read_reports(spark, str(tmp_path / "archive")).collect()
    assert (row.network_id, row.report_date.day, row.report) == ("home", 7, "seven")


def test_device_files_overlay(spark, tmp_path):
    for name, rows in (("base", [("1", "one"), ("2", "two")]), ("local", [("2", "mine")])):
        (tmp_path / f"{name}.json").write_text(
            "\n".join(json.dumps({"network_id": "n", "ip": i, "device": d}) for i, d in rows)
        )
    both = side_inputs.read_devices(spark, str(tmp_path / "base.json"), str(tmp_path / "local.json"))
    assert {r.ip: r.device for r in both.collect()} == {"1": "one", "2": "mine"}
    alone = side_inputs.read_devices(spark, str(tmp_path / "base.json"), str(tmp_path / "none.json"))
    assert {r.ip: r.device for r in alone.collect()} == {"1": "one", "2": "two"}
