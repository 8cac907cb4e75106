"""Known numbers of the fixture day, through single sections and through the packet."""

from __future__ import annotations

import json

import fixture_day
import pytest
from fixture_day import PARAMS, TOTAL
from pyspark.sql import functions as F

from querytide.operators import novelty, traffic, volume
from querytide.operators.messages import packet_json, prompts
from querytide.plans import packet


@pytest.fixture(scope="module", params=["log", "rollup"])
def frame(request, day_log):
    rows = traffic.as_traffic(day_log, PARAMS)
    return rows if request.param == "log" else traffic.rollup(rows)


@pytest.fixture(scope="module")
def the_packet(spark, day_log):
    rows = packet.evidence_packets(
        packet.report_tables(day_log, PARAMS), fixture_day.novel(spark),
        fixture_day.baseline(spark), PARAMS, fixture_day.devices(spark),
    ).collect()
    assert len(rows) == 1
    return rows[0].packet.asDict(recursive=True)


def test_summary(frame):
    (row,) = traffic.summary(frame).collect()
    assert (row.total_queries, row.unique_clients, row.unique_domains, row.total_blocked) == (
        TOTAL, 6, 12, 45,
    )
    assert row.date == "2025-11-16"


def test_approximate_summary_is_close(frame):
    (row,) = traffic.summary_approx(frame).collect()
    assert row.total_queries == TOTAL and row.total_blocked == 45
    assert abs(row.unique_domains - 12) <= 1


def test_top_domains(frame):
    rows = traffic.top_domains(frame).orderBy("rank").collect()
    assert [(r.domain.split(".")[0], r["count"]) for r in rows] == [
        ("play", 118), ("mirror", 75), ("news", 61), ("music", 52), ("chat", 46), ("maps", 33),
        ("ink", 24), ("time", 13), ("beacon", 9), ("fresh", 2),
    ]


def test_per_client(spark, frame):
    rows = traffic.per_client(frame, fixture_day.devices(spark)).collect()
    assert {(r.device, r.total, r.blocked) for r in rows} == {
        ("Console", 164, 0), ("Server", 112, 28), ("Tablet", 111, 17), ("Speaker", 52, 0),
        ("Printer", 24, 0), ("10.7.0.7", 15, 0),
    }


def test_blocked_domains(frame):
    rows = traffic.blocked_domains(frame).orderBy("rank").collect()
    assert [(r["count"], r.domain, r.rule) for r in rows] == [
        (28, "telemetry.maker.example", "||maker.example^$important"),
        (17, "ads.banner.example", "||banner.example^"),
    ]


def test_off_hours(spark, frame):
    totals = traffic.off_hours_devices(frame, fixture_day.devices(spark)).collect()
    assert {r.device: r.total for r in totals} == {"Server": 108, "10.7.0.7": 2}
    rows = traffic.off_hours_domains(frame, PARAMS).orderBy("client", "rank").collect()
    assert [
        (r.domain.split(".")[0], r["count"], r.blocked, r.first_seen_local, r.last_seen_local) for r in rows
    ] == [
        ("mirror", 75, False, "00:50", "04:07"), ("telemetry", 24, True, "00:35", "04:25"),
        ("beacon", 9, False, "01:30", "03:03"), ("time", 2, False, "02:45", "03:45"),
    ]


def test_new_domains(spark, frame):
    rows = novelty.new_domains(frame, fixture_day.novel(spark), fixture_day.devices(spark))
    assert {(r.domain, r["count"], r.first_client) for r in rows.collect()} == {
        ("beacon.odd.example", 9, "Server"), ("fresh.gadget.example", 2, "10.7.0.7"),
    }


def test_volume_anomalies(spark, frame):
    rows = volume.volume_anomalies(
        volume.with_baseline(volume.daily_volume(frame), fixture_day.baseline(spark)),
        fixture_day.devices(spark),
    ).collect()
    assert {r.device: r.z_score for r in rows} == {"Console": 15.5, "Server": -3.0, "Speaker": 0.8}


def test_packet_order_and_shape(the_packet):
    assert the_packet["summary"] == {
        "date": "2025-11-16", "total_queries": TOTAL, "unique_clients": 6, "unique_domains": 12,
        "total_blocked": 45,
    }
    assert [c["device"] for c in the_packet["per_client"]] == [
        "Console", "Server", "Tablet", "Speaker", "Printer", "10.7.0.7",
    ]
    assert the_packet["per_client"][2]["top_domains"] == [
        {"domain": "news.daily.example", "count": 61}, {"domain": "maps.roads.example", "count": 33},
    ]
    quiet = the_packet["off_hours_activity"]
    assert (quiet["window_start"], quiet["window_end"], quiet["timezone"]) == (
        "00:30", "04:30", "Asia/Kolkata",
    )
    assert quiet["total_queries"] == 110
    assert [d["device"] for d in quiet["by_device"]] == ["Server", "10.7.0.7"]
    assert [a["device"] for a in the_packet["volume_anomalies"]] == ["Console", "Server", "Speaker"]
    assert [d["domain"] for d in the_packet["new_domains"]] == fixture_day.NEW
    assert "device_profiles" not in the_packet and "dns_enforcement" not in the_packet


def test_doubled_names_change_no_number(spark, day_log, the_packet):
    names = fixture_day.devices(spark)
    again = names.withColumn("device", F.concat(F.lit("zz "), F.col("device")))
    (row,) = packet.evidence_packets(
        packet.report_tables(day_log, PARAMS), fixture_day.novel(spark),
        fixture_day.baseline(spark), PARAMS, names.unionByName(again),
    ).collect()
    assert row.packet.asDict(recursive=True) == the_packet


def test_packet_as_prompt(spark, day_log):
    packets = packet.backfill_packets(day_log, PARAMS, fixture_day.devices(spark))
    row = prompts(packets, PARAMS).select(F.explode("messages").alias("m")).collect()[0].m
    assert row.role == "user"
    assert "TL;DR" in row.content and "beacon.odd.example" in row.content
    assert "Console" in row.content and "Asia/Kolkata" in row.content
    document = json.loads(packets.select(packet_json()).collect()[0][0])
    assert document["summary"]["total_queries"] == TOTAL
    assert len(document["new_domains"]) == 12


def test_headline(spark, day_log):
    (row,) = packet.headline_stats(packet.backfill_packets(day_log, PARAMS)).collect()
    assert (row.total_queries, row.total_blocked, row.unique_clients) == (TOTAL, 45, 6)
    assert (row.top_blocked_domain, row.top_blocked_count) == ("telemetry.maker.example", 28)
    assert row.blocked_percent == "9.4%"
    assert row.stat_line == (
        "478 queries | 9.4% blocked | 6 clients | top blocked telemetry.maker.example (28)"
    )
