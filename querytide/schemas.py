"""Declared schemas: nothing in the package infers a schema from data."""

from __future__ import annotations

# Field names of one captured page of the resolver's query log. Only the fields
# the report uses are declared, so the JSON reader skips the rest.
PAGE_SCHEMA = """
    data ARRAY<STRUCT<
        client: STRING,
        question: STRUCT<name: STRING, type: STRING>,
        reason: STRING,
        rule: STRING,
        time: STRING>>,
    oldest STRING,
    _corrupt_record STRING
"""

LOG_SCHEMA = """
    network_id STRING,
    seq BIGINT,
    time TIMESTAMP_NTZ,
    client STRING,
    domain STRING,
    query_type STRING,
    reason STRING,
    blocked BOOLEAN,
    block_rule STRING
"""

LOG_COLUMNS = tuple(line.split()[0] for line in LOG_SCHEMA.strip().splitlines())

KNOWN_DOMAINS_SCHEMA = "network_id STRING, domain STRING, first_seen DATE, last_seen DATE"

SIGHTING_SCHEMA = "network_id STRING, domain STRING, report_date DATE"

DAILY_VOLUME_SCHEMA = (
    "network_id STRING, client STRING, query_count BIGINT, report_date DATE"
)

DEVICE_SCHEMA = "network_id STRING, ip STRING, device STRING"

# Field names of the optional side-input documents.
INTERCEPT_SCHEMA = """
    network_id STRING,
    report_date DATE,
    available BOOLEAN,
    timestamp STRING,
    intercepted_queries BIGINT,
    intercepted_bytes BIGINT,
    udp_queries BIGINT,
    tcp_queries BIGINT
"""

FINGERPRINT_SCHEMA = """
    network_id STRING,
    report_date DATE,
    page BIGINT,
    available BOOLEAN,
    devices ARRAY<STRUCT<
        ip: STRING, first_seen: STRING, last_seen: STRING, os: STRING, http_os: STRING,
        distance_hops: INT, uptime_min: INT, link_type: STRING>>,
    recent_changes ARRAY<STRUCT<
        ip: STRING, detected_at: STRING, previous_os: STRING, current_os: STRING>>
"""

# Field names of a model's response events.
RESPONSE_EVENT_SCHEMA = """
    type STRING,
    delta STRUCT<type: STRING, text: STRING, stop_reason: STRING>
"""

# Names and order of the packet's fields.
PACKET_STRUCT = """STRUCT<
    summary: STRUCT<date: STRING, total_queries: BIGINT, unique_clients: BIGINT,
        unique_domains: BIGINT, total_blocked: BIGINT>,
    top_domains: ARRAY<STRUCT<domain: STRING, count: BIGINT>>,
    per_client: ARRAY<STRUCT<client: STRING, device: STRING, total: BIGINT, blocked: BIGINT,
        top_domains: ARRAY<STRUCT<domain: STRING, count: BIGINT>>>>,
    off_hours_activity: STRUCT<window_start: STRING, window_end: STRING, timezone: STRING,
        total_queries: BIGINT,
        by_device: ARRAY<STRUCT<device: STRING, client: STRING, total: BIGINT,
            top_domains: ARRAY<STRUCT<domain: STRING, count: BIGINT, blocked: BOOLEAN,
                first_seen_local: STRING, last_seen_local: STRING>>>>>,
    new_domains: ARRAY<STRUCT<domain: STRING, count: BIGINT, first_client: STRING>>,
    volume_anomalies: ARRAY<STRUCT<client: STRING, device: STRING, today_count: BIGINT,
        baseline_mean: DOUBLE, baseline_stddev: DOUBLE, z_score: DOUBLE, baseline_days: BIGINT>>,
    blocked_domains: ARRAY<STRUCT<domain: STRING, count: BIGINT, rule: STRING>>,
    device_profiles: STRUCT<
        devices: ARRAY<STRUCT<ip: STRING, first_seen: STRING, last_seen: STRING, os: STRING,
            http_os: STRING, distance_hops: INT, uptime_min: INT, link_type: STRING,
            device: STRING>>,
        recent_changes: ARRAY<STRUCT<ip: STRING, detected_at: STRING, previous_os: STRING,
            current_os: STRING, device: STRING>>,
        note: STRING>,
    dns_enforcement: STRUCT<intercepted_queries: BIGINT, intercepted_bytes: BIGINT,
        udp_queries: BIGINT, tcp_queries: BIGINT, note: STRING>>
"""
