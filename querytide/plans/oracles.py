"""Plain SQL for the queries of the catalog, written apart from the operators."""

from __future__ import annotations

LOG = """
log AS (
  SELECT 'net' || (user_id % 3) AS network_id, -event_id AS seq, ts AS time,
         '10.0.0.' || user_id AS client,
         'd' || json_extract_string(props, '$.k') || '.u' || (user_id % 50) || '.example' AS domain,
         CASE event_type WHEN 'view' THEN 'AAAA' ELSE 'A' END AS query_type,
         CASE event_type WHEN 'error' THEN 'FilteredBlackList'
              WHEN 'signup' THEN 'FilteredSafeSearch' ELSE 'NotFilteredNotFound' END AS reason,
         event_type IN ('error', 'signup') AS blocked,
         CASE WHEN event_type IN ('error', 'signup')
              THEN '||d' || json_extract_string(props, '$.k') || '.u' || (user_id % 50) || '.example^'
              ELSE '' END AS block_rule
  FROM events)"""

DATED = f"""{LOG},
dated AS (
  SELECT *, CAST(time - INTERVAL 15 HOURS AS DATE) + 1 AS report_date FROM log)"""

BULK = """
dated AS (
  SELECT 'site' || (l_suppkey % 3) AS network_id, -(l_orderkey * 10 + l_linenumber) AS seq,
         l_shipdate AS time, 's' || l_suppkey AS client, 'p' || l_partkey AS domain,
         l_returnflag = 'R' AS blocked,
         CASE WHEN l_returnflag = 'R' THEN 'rule-' || l_linestatus ELSE '' END AS block_rule,
         CAST(l_shipdate - INTERVAL 15 HOURS AS DATE) + 1 AS report_date
  FROM lineitem)"""



def long_windows(windows: str, log: str = "log") -> str:
    """Every row once for each report whose window of so many hours it is in."""
    return f"""
runs AS (
  SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS report_date
  FROM (SELECT CAST(min(time) AS DATE) AS a, CAST(max(time) AS DATE) + 40 AS z FROM {log})),
dated AS (
  SELECT l.*, d.report_date, w.lookback
  FROM {log} l JOIN (VALUES {windows}) w(lookback, hours) ON TRUE
  JOIN runs d ON time < d.report_date + INTERVAL 15 HOURS
             AND time >= d.report_date + INTERVAL 15 HOURS - hours * INTERVAL 1 HOUR)"""


LONG = f"{LOG}," + long_windows("('36h', 36), ('48h', 48), ('30d', 720)")
LONG_36 = f"{LOG}," + long_windows("('36h', 36)")
LONG_48 = f"{LOG}," + long_windows("('48h', 48)")

DEVICES = """
devices AS (
  SELECT 'net' || (c_custkey % 3) AS network_id, '10.0.0.' || c_custkey AS ip, c_name AS device
  FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')"""

BULK_30 = BULK.replace("dated AS", "log AS").replace(
    ",\n         CAST(l_shipdate - INTERVAL 15 HOURS AS DATE) + 1 AS report_date", ""
) + "," + long_windows("('30d', 720)")

SUPPLIERS = """
devices AS (
  SELECT 'site' || (s_suppkey % 3) AS network_id, 's' || s_suppkey AS ip, s_name AS device
  FROM supplier WHERE s_acctbal > 0)"""

SUMMARY = """
SELECT network_id, report_date, COUNT(*) AS total_queries,
       COUNT(DISTINCT client) AS unique_clients, COUNT(DISTINCT domain) AS unique_domains,
       CAST(SUM(CAST(blocked AS INT)) AS BIGINT) AS total_blocked,
       strftime(report_date, '%Y-%m-%d') AS date
FROM dated GROUP BY ALL"""

TOP = """
SELECT network_id, report_date, domain, COUNT(*) AS count,
       CAST(row_number() OVER (PARTITION BY network_id, report_date
                               ORDER BY COUNT(*) DESC, domain) AS INT) AS rank
FROM dated WHERE NOT blocked GROUP BY network_id, report_date, domain
QUALIFY rank <= 20"""

BLOCKED = """
SELECT network_id, report_date, domain, COUNT(*) AS count,
       arg_max(block_rule, (time, -seq)) AS rule,
       CAST(row_number() OVER (PARTITION BY network_id, report_date
                               ORDER BY COUNT(*) DESC, domain) AS INT) AS rank
FROM dated WHERE blocked GROUP BY network_id, report_date, domain
QUALIFY rank <= 20"""

CLIENT_TOP = """
SELECT network_id, report_date, client, domain, COUNT(*) AS count,
       CAST(row_number() OVER (PARTITION BY network_id, report_date, client
                               ORDER BY COUNT(*) DESC, domain) AS INT) AS rank
FROM dated WHERE NOT blocked GROUP BY network_id, report_date, client, domain
QUALIFY rank <= 5"""

CLIENTS = """
SELECT t.network_id, report_date, client, total, blocked, COALESCE(device, client) AS device
FROM (SELECT network_id, report_date, client, COUNT(*) AS total,
             CAST(SUM(CAST(blocked AS INT)) AS BIGINT) AS blocked
      FROM dated GROUP BY ALL) t
LEFT JOIN devices v ON v.network_id = t.network_id AND v.ip = t.client"""


def quiet(start_shift: int, start: str, end: str, zone: str = "America/Phoenix") -> str:
    """Rows between two local times, the start on the report date or some days before."""

    def instant(day: str, clock: str) -> str:
        wall = f"CAST({day} AS TIMESTAMP) + INTERVAL '{clock}'"
        return f"timezone('UTC', timezone('{zone}', {wall}))"

    return f"""
quiet AS (
  SELECT * FROM dated
  WHERE time >= {instant(f"(report_date - {start_shift})", start)}
    AND time < {instant("report_date", end)})"""


QUIET = quiet(0, "1 hour", "5 hours")
QUIET_WRAPPED = quiet(1, "22 hours", "5 hours")
QUIET_BULK = quiet(1, "16 hours", "5 hours")

QUIET_DST = quiet(0, "90 minutes", "5 hours", "Europe/Berlin")

QUIET_TOP = """
SELECT network_id, report_date, client, domain, COUNT(*) AS count, bool_or(blocked) AS blocked,
       strftime(timezone('America/Phoenix', timezone('UTC', MIN(time))), '%H:%M') AS first_seen_local,
       strftime(timezone('America/Phoenix', timezone('UTC', MAX(time))), '%H:%M') AS last_seen_local,
       CAST(row_number() OVER (PARTITION BY network_id, report_date, client
                               ORDER BY COUNT(*) DESC, domain) AS INT) AS rank
FROM quiet GROUP BY network_id, report_date, client, domain
QUALIFY rank <= 10"""

QUIET_DEVICES = """
SELECT t.network_id, report_date, client, total, COALESCE(device, client) AS device
FROM (SELECT network_id, report_date, client, COUNT(*) AS total FROM quiet GROUP BY ALL) t
LEFT JOIN devices v ON v.network_id = t.network_id AND v.ip = t.client"""


def novel(window: int) -> str:
    """New domains by looking for an earlier sighting inside the window."""
    return f"""
sightings AS (SELECT DISTINCT network_id, report_date, domain FROM dated),
novel AS (
  SELECT * FROM sightings s WHERE NOT EXISTS (
    SELECT 1 FROM sightings p
    WHERE p.network_id = s.network_id AND p.domain = s.domain
      AND p.report_date < s.report_date AND p.report_date >= s.report_date - {window}))"""


def found(pick: str) -> str:
    return f"""
found AS (
  SELECT network_id, report_date, domain, COUNT(*) AS count,
         {pick}(client, (time, -seq)) AS picked
  FROM dated SEMI JOIN novel USING (network_id, report_date, domain) GROUP BY ALL)"""


FOUND = """
SELECT f.network_id, report_date, domain, count, COALESCE(device, picked) AS first_client
FROM found f LEFT JOIN devices v ON v.network_id = f.network_id AND v.ip = f.picked"""

VOLUMES = """
volumes AS (
  SELECT network_id, report_date, client, COUNT(*) AS query_count FROM dated GROUP BY ALL)"""

BASELINE = """
baseline AS (
  SELECT t.network_id, t.report_date, t.client, t.query_count,
         AVG(h.query_count) AS mean, STDDEV_POP(h.query_count) AS stddev, COUNT(*) AS days
  FROM volumes t JOIN volumes h
    ON h.network_id = t.network_id AND h.client = t.client
   AND h.report_date >= t.report_date - 14 AND h.report_date < t.report_date
  GROUP BY ALL)"""

BASELINE_ROWS = """
SELECT network_id, report_date, client, round(mean, 6) AS mean, round(stddev, 6) AS stddev, days
FROM baseline"""

# Decisions at the limit need a deviation that does not depend on the order of addition, so
# this is STDDEV_POP written out over whole numbers.
ANOMALIES = """
exact AS (
  SELECT t.network_id, t.report_date, t.client, t.query_count, AVG(h.query_count) AS mean,
         sqrt(CAST(COUNT(*) * SUM(h.query_count * h.query_count)
                   - SUM(h.query_count) * SUM(h.query_count) AS DOUBLE)) / COUNT(*) AS stddev,
         COUNT(*) AS days
  FROM volumes t JOIN volumes h
    ON h.network_id = t.network_id AND h.client = t.client
   AND h.report_date >= t.report_date - 14 AND h.report_date < t.report_date
  GROUP BY ALL),
scored AS (
  SELECT *, CASE WHEN stddev > 0 THEN (query_count - mean) / stddev
                 WHEN mean > 0 THEN (query_count - mean) / mean ELSE 0 END AS z
  FROM exact),
anomalies AS (
  SELECT s.network_id, report_date, client, query_count AS today_count,
         round(mean, 1) AS baseline_mean, round(stddev, 1) AS baseline_stddev,
         round(z, 2) AS z_score, days AS baseline_days, COALESCE(device, client) AS device
  FROM scored s LEFT JOIN devices v ON v.network_id = s.network_id AND v.ip = s.client
  WHERE abs(z) >= 2.0 OR query_count >= 3 * mean)"""

RESPONSES = """
SELECT conv_id AS response_id,
       COALESCE(string_agg(text, '' ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS text
FROM conversations GROUP BY conv_id"""

NO_DAY = "report_date < DATE '2024-01-20'"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(part for part in parts[:-1]) + parts[-1]




def packet_parts(dated: str) -> str:
    return f"""{dated},{DEVICES},{VOLUMES},{ANOMALIES},{QUIET},{novel(7)},{found("arg_max")},
clients AS ({CLIENTS}), client_top AS ({CLIENT_TOP}), top AS ({TOP}), blocked AS ({BLOCKED}),
quiet_devices AS ({QUIET_DEVICES}), new_domains AS ({FOUND}), totals AS ({SUMMARY}),
span AS (SELECT network_id, MIN(report_date) AS a, MAX(report_date) AS z FROM dated GROUP BY ALL),
days AS (SELECT network_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS report_date
         FROM span)"""


PACKET_PARTS = packet_parts(DATED)


def _section(table: str, order: str, first: str, prefix: str, alias: str) -> str:
    return f"""
LEFT JOIN (SELECT network_id, report_date, COUNT(*) AS {prefix}_rows,
                  first({first} ORDER BY {order}) AS {alias}
           FROM {table} GROUP BY ALL) {prefix} USING (network_id, report_date)"""


def findings(days: str) -> str:
    return f"""
SELECT network_id, report_date, 'new' AS section, domain AS name, count
FROM new_domains WHERE report_date {days}
UNION ALL SELECT network_id, report_date, 'anomaly', client, today_count
FROM anomalies WHERE report_date {days}
UNION ALL SELECT network_id, report_date, 'total', '', total_queries
FROM totals WHERE report_date {days}"""


PACKET_SECTIONS = f"""
SELECT network_id, report_date, COALESCE(total_queries, 0) AS total_queries, total_blocked,
       COALESCE(top_rows, 0) AS top_rows, top_first,
       COALESCE(client_rows, 0) AS client_rows, client_first,
       CAST(COALESCE(quiet_total, 0) AS BIGINT) AS quiet_total,
       COALESCE(quiet_rows, 0) AS quiet_rows, quiet_first,
       COALESCE(new_rows, 0) AS new_rows, new_first,
       COALESCE(anomaly_rows, 0) AS anomaly_rows, anomaly_first,
       COALESCE(blocked_rows, 0) AS blocked_rows, blocked_first_rule
FROM days LEFT JOIN totals USING (network_id, report_date)
{_section("top", "rank", "domain", "top", "top_first")}
{_section("clients", "total DESC, client", "client", "client", "client_first")}
{_section("quiet_devices", "total DESC, client", "device", "quiet", "quiet_first")}
LEFT JOIN (SELECT network_id, report_date, COUNT(*) AS quiet_total FROM quiet GROUP BY ALL) q
  USING (network_id, report_date)
{_section("new_domains", "count DESC, domain", "domain", "new", "new_first")}
{_section("anomalies", "abs(z_score) DESC, client", "client", "anomaly", "anomaly_first")}
{_section("blocked", "rank", "rule", "blocked", "blocked_first_rule")}"""

PLACES = """
, places AS (
  SELECT network_id, report_date, 'per_client' AS list, client AS name, -total AS weight FROM clients
  UNION ALL SELECT network_id, report_date, 'by_device', client, -total FROM quiet_devices
  UNION ALL SELECT network_id, report_date, 'new_domains', domain, -count FROM new_domains
  UNION ALL SELECT network_id, report_date, 'volume_anomalies', client, -abs(z_score) FROM anomalies)
SELECT network_id, report_date, list, name,
       row_number() OVER (PARTITION BY network_id, report_date, list ORDER BY weight, name) - 1 AS place
FROM places"""

HEADLINE = """
, numbers AS (
  SELECT network_id, report_date, COALESCE(total_queries, 0) AS total_queries, total_blocked,
         COALESCE(unique_clients, 0) AS unique_clients, b.domain AS top_blocked_domain,
         b.count AS top_blocked_count,
         printf('%.1f', CASE WHEN total_queries > 0 THEN total_blocked / total_queries * 100
                             ELSE 0.0 END) || '%' AS blocked_percent
  FROM days LEFT JOIN totals USING (network_id, report_date)
  LEFT JOIN (SELECT * FROM blocked WHERE rank = 1) b USING (network_id, report_date))
SELECT *, format('{:,}', total_queries) || ' queries | ' || blocked_percent || ' blocked | '
          || unique_clients || ' clients'
          || COALESCE(' | top blocked ' || top_blocked_domain || ' ('
                      || format('{:,}', top_blocked_count) || ')', '') AS stat_line
FROM numbers"""

ARCHIVE = f"""{DATED}, totals AS ({SUMMARY}),
reports AS (
  SELECT network_id, report_date,
         CASE WHEN {NO_DAY} OR network_id = 'net1' THEN 'draft ' ELSE 'final ' END || date || ': ' || total_queries AS report
  FROM totals)"""

ORDER_DEVICES = """
seen AS (
  SELECT *, 'net' || (o_custkey % 3) AS network_id, last_day(o_orderdate) AS report_date,
         '10.0.0.' || o_custkey AS ip
  FROM orders)"""

ORACLES: dict[str, str] = {
    "log_parse": with_(
        LOG,
        """
SELECT * REPLACE ((4102444800000000 - epoch_us(time)) // 1000000 * 2147483648 - 1 + row_number() OVER (
    PARTITION BY network_id, (4102444800000000 - epoch_us(time)) // 1000000 ORDER BY time DESC, seq) AS seq)
FROM log""",
    ),
    "log_rejects": """
WITH faults AS (
  SELECT 'net' || (user_id % 3) AS network_id,
         CASE WHEN event_type = 'view' AND value >= 50 THEN 'missing time'
              WHEN event_type = 'error' AND value > 40 THEN 'bad time'
              WHEN value < 2 THEN 'missing question name'
              WHEN event_type = 'signup' AND value >= 60 THEN 'missing question type'
         END AS reject_reason
  FROM events)
SELECT network_id, reject_reason, COUNT(*) AS entries FROM faults
WHERE reject_reason IS NOT NULL GROUP BY ALL""",
    "pages_concat": with_(
        LOG,
        """
, placed AS (
  SELECT *, row_number() OVER page AS place, floor(seq / 1000) AS number,
         last_value(time) OVER (page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS oldest,
         first_value(time) OVER page AS newest
  FROM log WINDOW page AS (PARTITION BY network_id, floor(seq / 1000) ORDER BY seq))
SELECT * EXCLUDE (place, number, oldest, newest)
         REPLACE ((4102444800000000 - epoch_us(oldest)) // 1000000 * 2147483648 - 1 + row_number() OVER (
           PARTITION BY network_id, (4102444800000000 - epoch_us(oldest)) // 1000000
           ORDER BY oldest DESC, newest DESC, number, place) AS seq)
FROM placed""",
    ),
    "pages_arrival_order": with_(
        LOG,
        """
, days AS (SELECT * REPLACE (date_trunc('day', time)::TIMESTAMP AS time) FROM log),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY time DESC, seq) - 1 AS place FROM days),
placed AS (
  SELECT *, min(time) OVER page AS oldest, max(time) OVER page AS newest
  FROM ranked WINDOW page AS (
    PARTITION BY network_id, place // CASE WHEN network_id = 'net0' THEN 3000 ELSE 70 END))
SELECT * EXCLUDE (place, oldest, newest)
         REPLACE ((4102444800 - epoch(oldest)::BIGINT) * 2147483648 - 1 + row_number() OVER (
           PARTITION BY network_id, oldest ORDER BY newest DESC, place) AS seq)
FROM placed""",
    ),
    "trailing_window": with_(
        LOG, " SELECT * FROM log WHERE time >= TIMESTAMP '2024-01-19 15:00:00'"
    ),
    "log_store": with_(
        LOG,
        """
SELECT * FROM log
WHERE time >= TIMESTAMP '2024-01-19 15:00:00' AND time < TIMESTAMP '2024-01-20 15:00:00'""",
    ),
    "log_reload": with_(
        LOG,
        """
SELECT * FROM log WHERE time < TIMESTAMP '2024-01-20 15:00:00'
UNION ALL SELECT * FROM log WHERE blocked""",
    ),
    "report_windows": with_(
        LOG,
        """
, runs AS (
  SELECT network_id, CAST(unnest(generate_series(DATE '2023-12-31', DATE '2024-02-03',
                                                 INTERVAL 1 DAY)) AS DATE) AS report_date
  FROM (SELECT DISTINCT network_id FROM log))
SELECT r.network_id, report_date, COUNT(*) AS total_queries, window_hours
FROM runs r CROSS JOIN (VALUES (12), (24), (36), (48)) w(window_hours)
JOIN log l ON l.network_id = r.network_id
 AND l.time < report_date + INTERVAL 15 HOURS
 AND l.time >= report_date + INTERVAL 15 HOURS - window_hours * INTERVAL 1 HOUR
GROUP BY ALL""",
    ),
    "summary": with_(DATED, SUMMARY),
    "top_domains": with_(DATED, TOP),
    "blocked_domains": with_(DATED, BLOCKED),
    "per_client": with_(DATED, DEVICES, CLIENTS),
    "per_client_named_twice": with_(DATED, DEVICES, CLIENTS),
    "summary_approx": with_(
        DATED,
        """
SELECT network_id, report_date, COUNT(*) AS total_queries,
       CAST(SUM(CAST(blocked AS INT)) AS BIGINT) AS total_blocked, TRUE AS clients, TRUE AS domains
FROM dated GROUP BY network_id, report_date""",
    ),
    "client_top_domains": with_(DATED, CLIENT_TOP),
    "off_hours_domains": with_(DATED, QUIET, QUIET_TOP),
    "off_hours_devices": with_(DATED, QUIET, DEVICES, QUIET_DEVICES),
    "off_hours_totals": with_(
        DATED,
        QUIET,
        " SELECT network_id, report_date, COUNT(*) AS total_queries FROM quiet GROUP BY ALL",
    ),
    "off_hours_wrap": with_(DATED, QUIET_WRAPPED, QUIET_TOP),
    "off_hours_dst": with_(BULK, QUIET_DST, QUIET_TOP.replace("America/Phoenix", "Europe/Berlin")),
    "novel_domains": with_(DATED, novel(7), " SELECT network_id, report_date, domain FROM novel"),
    "novel_vs_state": with_(
        DATED,
        novel(7),
        " SELECT network_id, report_date, domain FROM novel WHERE report_date = DATE '2024-01-20'",
    ),
    "new_domains": with_(DATED, DEVICES, novel(7), found("arg_max"), FOUND),
    "new_domains_earliest": with_(DATED, DEVICES, novel(7), found("arg_min"), FOUND),
    "known_domains_upsert": with_(
        DATED,
        """
SELECT network_id, domain, MIN(report_date) AS first_seen, MAX(report_date) AS last_seen
FROM dated GROUP BY ALL""",
    ),
    "state_per_network": with_(
        DATED,
        """
, kept AS (SELECT * FROM dated WHERE network_id <> 'net0' OR blocked)
SELECT network_id, domain AS name, MIN(report_date) AS first_seen, MAX(report_date) AS last_seen,
       NULL::BIGINT AS queries
FROM kept GROUP BY ALL
UNION ALL
SELECT network_id, client, MIN(report_date), MAX(report_date), COUNT(*) FROM kept GROUP BY ALL""",
    ),
    "state_overlapping_runs": with_(
        DATED,
        """
SELECT network_id, domain, MIN(report_date) AS first_seen, MAX(report_date) AS last_seen
FROM (
  SELECT network_id, domain, report_date FROM dated WHERE network_id = 'net0' OR blocked
  UNION ALL
  SELECT network_id, domain, report_date FROM dated d WHERE network_id = 'net2' AND NOT EXISTS (
    SELECT 1 FROM dated b WHERE b.blocked AND b.network_id = d.network_id AND b.report_date = d.report_date))
GROUP BY network_id, domain""",
    ),
    "known_domains_late_rerun": with_(
        DATED,
        f"""
SELECT network_id, domain, MIN(report_date) AS first_seen, MAX(report_date) AS last_seen
FROM dated WHERE {NO_DAY} GROUP BY ALL""",
    ),
    "daily_volume_merge": with_(
        DATED,
        f"""
SELECT network_id, report_date, client,
       CASE WHEN bool_or(blocked AND NOT ({NO_DAY})) THEN COUNT(*) FILTER (WHERE blocked)
            ELSE COUNT(*) FILTER (WHERE NOT blocked) END AS query_count
FROM dated GROUP BY ALL HAVING query_count > 0""",
    ),
    "daily_volume": with_(DATED, VOLUMES, " SELECT * FROM volumes"),
    "daily_volume_upsert": with_(
        DATED,
        """
SELECT network_id, report_date, client,
       CASE WHEN bool_or(blocked) THEN COUNT(*) FILTER (WHERE blocked)
            ELSE COUNT(*) END AS query_count
FROM dated GROUP BY ALL""",
    ),
    "daily_volume_rerun": with_(
        DATED,
        f"""
SELECT network_id, report_date, client, COUNT(*) AS query_count
FROM dated WHERE {NO_DAY} OR blocked GROUP BY ALL""",
    ),
    "volume_baseline": with_(DATED, VOLUMES, BASELINE, BASELINE_ROWS),
    "baseline_asof_date": with_(
        DATED,
        VOLUMES,
        """
SELECT network_id, DATE '2024-01-20' AS report_date, client, round(AVG(query_count), 6) AS mean,
       round(STDDEV_POP(query_count), 6) AS stddev, COUNT(*) AS days
FROM volumes WHERE report_date >= DATE '2024-01-06' AND report_date < DATE '2024-01-20'
GROUP BY ALL""",
    ),
    "volume_anomalies": with_(
        DATED, VOLUMES, DEVICES, ANOMALIES, " SELECT * FROM anomalies"
    ),
    "volume_vs_baseline": with_(
        DATED,
        VOLUMES,
        DEVICES,
        ANOMALIES,
        " SELECT * FROM anomalies WHERE report_date = DATE '2024-01-20'",
    ),
    "device_overlay": """
SELECT 'net' || (c_custkey % 3) AS network_id, '10.0.0.' || c_custkey AS ip,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'local ' || c_name ELSE c_name END AS device
FROM customer""",
    "intercept_counters": """
WITH sums AS (
  SELECT 'site' || (l_suppkey % 3) AS network_id, CAST(l_shipdate AS DATE) AS report_date,
         CAST(SUM(floor(l_quantity)) AS BIGINT) AS intercepted_queries,
         CAST(SUM(floor(l_extendedprice)) AS BIGINT) AS intercepted_bytes,
         CAST(COALESCE(SUM(floor(l_quantity)) FILTER (WHERE l_linestatus = 'O'), 0) AS BIGINT)
           AS udp_queries,
         CAST(COALESCE(SUM(floor(l_quantity)) FILTER (WHERE l_linestatus <> 'O'), 0) AS BIGINT)
           AS tcp_queries
  FROM lineitem GROUP BY ALL)
SELECT *, 'Queries sent past the local resolver to fixed public ones and redirected back to it.' AS note
FROM sums WHERE intercepted_queries <> 0""",
    "counter_listing": """
SELECT 'net' || (user_id % 3) AS network_id, ts AS sample_time,
       CASE event_type WHEN 'view' THEN 'udp' ELSE 'tcp' END AS proto,
       CAST(floor(value) AS BIGINT) AS packets, CAST(floor(value * 100) AS BIGINT) AS bytes
FROM events WHERE event_type IN ('view', 'click')""",
    "counter_delta": """
WITH readings AS (
  SELECT 'net' || (user_id % 3) AS network_id, event_type AS proto, ts AS sample_time,
         CAST(floor(value * 10) AS BIGINT) AS packets, CAST(floor(value * 100) AS BIGINT) AS bytes
  FROM events),
before AS (
  SELECT *, lag(packets) OVER w AS p, lag(bytes) OVER w AS q
  FROM readings WINDOW w AS (PARTITION BY network_id, proto ORDER BY sample_time))
SELECT network_id, proto, sample_time, packets, bytes,
       CASE WHEN p IS NULL OR packets < p THEN packets ELSE packets - p END AS packets_delta,
       CASE WHEN q IS NULL OR bytes < q THEN bytes ELSE bytes - q END AS bytes_delta
FROM before""",
    "fingerprint_profiles": with_(
        ORDER_DEVICES,
        DEVICES,
        """
SELECT s.network_id, report_date, s.ip,
       strftime(o_orderdate - INTERVAL 7 DAYS, '%Y-%m-%dT%H:%M:%S') AS first_seen,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS last_seen,
       COALESCE(nullif(trim(concat_ws(' ',
         CASE o_orderstatus WHEN 'F' THEN 'Linux' WHEN 'O' THEN 'Windows' END,
         CASE WHEN o_totalprice >= 100000 THEN o_orderpriority END)), ''), 'unknown') AS os,
       CASE o_orderstatus WHEN 'O' THEN 'browser' ELSE '' END AS http_os,
       CAST(month(o_orderdate) AS INT) AS distance_hops,
       CAST(floor(o_totalprice) AS INT) AS uptime_min, COALESCE(device, s.ip) AS device
FROM seen s LEFT JOIN devices v ON v.network_id = s.network_id AND v.ip = s.ip""",
    ),
    "fingerprint_changes": with_(
        ORDER_DEVICES,
        """
SELECT network_id, report_date, ip, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS detected_at,
       o_orderstatus AS previous_os, o_orderpriority AS current_os,
       CAST(row_number() OVER (PARTITION BY network_id, report_date
         ORDER BY o_orderdate DESC, ip, o_orderstatus, o_orderpriority) AS INT) AS rank
FROM seen QUALIFY rank <= 20""",
    ),
    "fingerprint_change_labels": with_(
        ORDER_DEVICES,
        DEVICES,
        """
, ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY network_id, report_date
              ORDER BY o_orderdate DESC, ip, o_orderstatus, o_orderpriority) AS INT) AS rank
  FROM seen QUALIFY rank <= 20)
SELECT r.network_id, report_date, r.ip, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS detected_at,
       o_orderstatus AS previous_os, o_orderpriority AS current_os, rank,
       COALESCE(device, r.ip) AS device,
       'System names are guessed from passive traffic fingerprints. A change of system can be '
       || 'an update, a reused address or something to look into.' AS note
FROM ranked r LEFT JOIN devices v ON v.network_id = r.network_id AND v.ip = r.ip""",
    ),
    "fingerprint_pages": with_(
        DATED,
        """
, spans AS (SELECT network_id, report_date, client AS ip, MAX(time) AS seen FROM dated GROUP BY ALL)
SELECT network_id, report_date, ip, strftime(seen, '%Y-%m-%dT%H:%M:%S') AS last_seen,
       row_number() OVER (PARTITION BY network_id, report_date
                          ORDER BY date_trunc('second', seen) DESC, ip) - 1 AS place
FROM spans""",
    ),
    "headline_stats": with_(PACKET_PARTS, HEADLINE),
    "packet_sections": with_(PACKET_PARTS, PACKET_SECTIONS),
    "packet_client_lists": with_(
        PACKET_PARTS,
        """
SELECT network_id, report_date, client, device, total, blocked, rank, domain, count
FROM client_top JOIN clients USING (network_id, report_date, client)""",
    ),
    "packet_lists_ranked": with_(PACKET_PARTS, PLACES),
    "packet_pages": with_(PACKET_PARTS, PLACES),
    "packet_off_hours_lists": with_(
        PACKET_PARTS,
        f"""
, quiet_top AS ({QUIET_TOP})
SELECT network_id, report_date, client, device, total, rank, domain, count, blocked,
       first_seen_local, last_seen_local
FROM quiet_top JOIN quiet_devices USING (network_id, report_date, client)""",
    ),
    "packet_roundtrip": with_(
        PACKET_PARTS,
        """
SELECT network_id, report_date, 'top_domains' AS section, domain AS name, count AS amount FROM top
UNION ALL SELECT network_id, report_date, 'blocked_domains', domain || ' ' || rule, count FROM blocked
UNION ALL SELECT network_id, report_date, 'new_domains', domain || ' ' || first_client, count
          FROM new_domains
UNION ALL SELECT network_id, report_date, 'by_device', device || ' ' || client, total
          FROM quiet_devices
UNION ALL SELECT network_id, report_date, 'volume_anomalies', device || ' ' || client, today_count
          FROM anomalies""",
    ),
    "pane_summary": with_(LONG, SUMMARY.replace("network_id,", "lookback, network_id,")),
    "pane_top_domains": with_(LONG, TOP.replace("network_id,", "lookback, network_id,")),
    "pane_client_totals": with_(
        LONG,
        """
SELECT lookback, network_id, report_date, client, COUNT(*) AS total,
       CAST(SUM(CAST(blocked AS INT)) AS BIGINT) AS blocked
FROM dated GROUP BY ALL""",
    ),
    "pane_off_hours": with_(LONG_48, QUIET_WRAPPED, QUIET_TOP),
    "pane_blocked_domains": with_(LONG_36, BLOCKED),
    "bulk_summary_30d": with_(BULK_30, SUMMARY),
    "bulk_top_domains_30d": with_(BULK_30, TOP),
    "backfill_span": with_(PACKET_PARTS, findings("BETWEEN DATE '2024-01-20' AND DATE '2024-01-24'")),
    "packet_48h": with_(packet_parts(LONG_48), findings("IS NOT NULL")),
    "daily_run": with_(PACKET_PARTS, findings("= DATE '2024-01-20'")),
    "job_daily": with_(
        DATED,
        VOLUMES,
        """
, run AS (
  SELECT client, COUNT(*) AS n FROM log
  WHERE network_id = 'net0' AND time >= TIMESTAMP '2024-01-18 15:00:00'
    AND time < TIMESTAMP '2024-01-20 15:00:00' GROUP BY ALL)
SELECT 'net0' AS network_id, 'packet' AS kind, CAST(SUM(n) AS BIGINT) AS queries FROM run
UNION ALL SELECT 'silent', 'packet', 0
UNION ALL
SELECT network_id, 'state', CAST(SUM(query_count) AS BIGINT) FROM (
  SELECT network_id, query_count FROM volumes
  WHERE network_id <> 'net0' OR report_date <> DATE '2024-01-20'
  UNION ALL SELECT 'net0', n FROM run)
GROUP BY network_id""",
    ),
    "packet_side_sections": with_(
        DATED,
        DEVICES,
        """
, spans AS (
  SELECT network_id, report_date, client, MAX(time) AS last_seen FROM dated GROUP BY ALL),
profiled AS (
  SELECT s.network_id, report_date, COUNT(*) AS profiles,
         first(COALESCE(device, client) ORDER BY date_trunc('second', last_seen) DESC, client)
           AS newest
  FROM spans s LEFT JOIN devices v ON v.network_id = s.network_id AND v.ip = s.client
  GROUP BY ALL),
counted AS (
  SELECT 'net' || (user_id % 3) AS network_id,
         CAST(ts - INTERVAL 15 HOURS AS DATE) + 1 AS report_date,
         least(COUNT(*), 20) AS changes,
         strftime(MAX(ts), '%Y-%m-%dT%H:%M:%S') AS last_change,
         CAST(SUM(floor(value)) AS BIGINT) AS intercepted_queries,
         CAST(SUM(floor(value * 100)) AS BIGINT) AS intercepted_bytes,
         CAST(SUM(CASE WHEN event_type IN ('view', 'click') THEN floor(value) ELSE 0 END)
           AS BIGINT) AS udp_queries,
         CAST(SUM(CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE floor(value) END)
           AS BIGINT) AS tcp_queries
  FROM events GROUP BY ALL)
SELECT network_id, report_date, profiles, newest, changes, last_change, intercepted_queries,
       intercepted_bytes, udp_queries, tcp_queries
FROM profiled JOIN counted USING (network_id, report_date)""",
    ),
    "packet_json": with_(
        PACKET_PARTS,
        """
SELECT network_id, report_date, 0::BIGINT AS page,
       'summary top_domains per_client off_hours_activity new_domains volume_anomalies '
       || 'blocked_domains device_profiles dns_enforcement' AS sections,
       date, 'America/Phoenix' AS timezone, CAST(udp AS VARCHAR) AS udp_queries,
       clients, quiet_devices, anomalies, clients AS profiles
FROM (SELECT network_id, report_date, CAST(COUNT(*) AS INT) AS clients FROM clients GROUP BY ALL)
JOIN totals USING (network_id, report_date)
JOIN (SELECT 'net' || (user_id % 3) AS network_id,
             CAST(ts - INTERVAL 15 HOURS AS DATE) + 1 AS report_date,
             CAST(SUM(CASE WHEN event_type IN ('view', 'click') THEN floor(value) ELSE 0 END)
               AS BIGINT) AS udp
      FROM events GROUP BY ALL) USING (network_id, report_date)
JOIN (SELECT d.network_id, d.report_date, CAST(COUNT(q.client) AS INT) AS quiet_devices
      FROM days d LEFT JOIN quiet_devices q USING (network_id, report_date) GROUP BY ALL)
  USING (network_id, report_date)
JOIN (SELECT d.network_id, d.report_date, CAST(COUNT(a.client) AS INT) AS anomalies
      FROM days d LEFT JOIN anomalies a USING (network_id, report_date) GROUP BY ALL)
  USING (network_id, report_date)""",
    ),
    "prompt_dataset": with_(
        PACKET_PARTS,
        """
SELECT network_id, report_date, 0::BIGINT AS page, 'user' AS role,
       'Write the daily network report for ' || strftime(report_date, '%Y-%m-%d') || '.' || chr(10)
       || 'Local time zone: America/Phoenix. Quiet hours: 01:00 to 05:00.' AS request,
       CAST(COALESCE(total_queries, 0) AS VARCHAR) AS total_queries, b.domain AS top_blocked
FROM days LEFT JOIN totals USING (network_id, report_date)
LEFT JOIN (SELECT * FROM blocked WHERE rank = 1) b USING (network_id, report_date)""",
    ),
    "response_text": RESPONSES,
    "response_truncated": """
SELECT conv_id AS response_id,
       CASE arg_max(role, turn) WHEN 'assistant' THEN 'end_turn' ELSE 'max_tokens' END AS stop_reason,
       arg_max(role, turn) <> 'assistant' AS truncated
FROM conversations GROUP BY conv_id""",
    "response_reports": with_(
        PACKET_PARTS,
        """
SELECT network_id, report_date, 0::BIGINT AS page,
       'Report ' || strftime(report_date, '%Y-%m-%d') || ': ' || COALESCE(total_queries, 0) AS report
FROM days LEFT JOIN totals USING (network_id, report_date)""",
    ),
    "report_archive": with_(ARCHIVE, " SELECT network_id, report_date, report FROM reports"),
    "latest_report": with_(
        ARCHIVE,
        """
SELECT network_id, report_date, report FROM reports
QUALIFY row_number() OVER (PARTITION BY network_id ORDER BY report_date DESC) = 1""",
    ),
    "archive_index": with_(
        ARCHIVE,
        """
SELECT network_id, report_date, strftime(report_date, '%Y/%m/%d') AS storage_key,
       strftime(report_date, '%A, %B %-d, %Y') AS display_date
FROM reports""",
    ),
    "stream_daily_volume": with_(
        DATED,
        VOLUMES,
        """
SELECT * FROM volumes
WHERE report_date + INTERVAL 15 HOURS <= (SELECT MAX(time) - INTERVAL 1 HOUR FROM log)""",
    ),
    "stream_volume_48h": with_(
        DATED,
        """
, runs AS (
  SELECT network_id, CAST(unnest(generate_series(
           (SELECT MIN(report_date) FROM dated), (SELECT MAX(report_date) + 1 FROM dated),
           INTERVAL 1 DAY)) AS DATE) AS report_date
  FROM (SELECT DISTINCT network_id FROM log))
SELECT r.network_id, report_date, client, COUNT(*) AS query_count
FROM runs r JOIN log l ON l.network_id = r.network_id
 AND l.time < report_date + INTERVAL 15 HOURS AND l.time >= report_date - INTERVAL 33 HOURS
WHERE report_date + INTERVAL 15 HOURS <= (SELECT MAX(time) - INTERVAL 1 HOUR FROM log)
GROUP BY ALL""",
    ),
    "stream_late_volume": with_(DATED, VOLUMES, " SELECT * FROM volumes"),
    "stream_novel_domains": with_(
        DATED, novel(7), " SELECT network_id, report_date, domain FROM novel"
    ),
    "stream_late_domains": with_(
        DATED,
        """
, days AS (
  SELECT DISTINCT network_id, report_date, domain,
         time >= TIMESTAMP '2024-01-11' AND time < TIMESTAMP '2024-01-21' AS late FROM dated)
SELECT DISTINCT network_id, report_date, domain FROM days s WHERE NOT EXISTS (
  SELECT 1 FROM days p
  WHERE p.network_id = s.network_id AND p.domain = s.domain AND (s.late OR NOT p.late)
    AND p.report_date < s.report_date AND p.report_date >= s.report_date - 7)""",
    ),
    "stream_batch_novel_domains": with_(
        DATED, novel(7), " SELECT network_id, report_date, domain FROM novel"
    ),
    "stream_state_upkeep": with_(
        DATED,
        """
SELECT network_id, domain, MIN(report_date) AS first_seen, MAX(report_date) AS last_seen
FROM dated GROUP BY ALL""",
    ),
    "stream_volume_upkeep": with_(DATED, VOLUMES, " SELECT * FROM volumes"),
    "bulk_summary": with_(BULK, SUMMARY),
    "bulk_top_domains": with_(BULK, TOP),
    "bulk_blocked_domains": with_(BULK, BLOCKED),
    "bulk_client_top_domains": with_(BULK, CLIENT_TOP),
    "bulk_off_hours_domains": with_(BULK, QUIET_BULK, QUIET_TOP),
    "bulk_new_domains": with_(BULK, SUPPLIERS, novel(30), found("arg_max"), FOUND),
    "bulk_volume_baseline": with_(BULK, VOLUMES, BASELINE, BASELINE_ROWS),
    "bulk_volume_anomalies": with_(
        BULK, VOLUMES, SUPPLIERS, ANOMALIES, " SELECT * FROM anomalies"
    ),
}
