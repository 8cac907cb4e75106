"""The evidence packet: all sections of a report in one nested row."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.functions.scalar import blocked_percent, iso_date, utc_literal
from querytide.operators import enforcement, fingerprints, novelty, panes, traffic, volume
from querytide.operators.devices import label_clients
from querytide.operators.paging import paginate
from querytide.operators.report_days import assign_report_days, report_calendar
from querytide.params import DAY, ReportParams
from querytide.session import write_and_read

PAGE = (*DAY, "page")


@dataclass(frozen=True)
class ReportTables:
    """What all sections are derived from, each kept as a table in the shared folder."""

    cube: DataFrame
    """One row per client, domain, rule and off-hours flag of a report day."""
    clients: DataFrame
    """One row per client of a report day."""
    domains: DataFrame
    """One row per domain of a report day."""

    def volumes(self) -> DataFrame:
        return self.clients.select(*DAY, "client", F.col("total").alias("query_count"))

    def sightings(self) -> DataFrame:
        return self.domains.select(*DAY, "domain")


def report_tables(dated_log: DataFrame, params: ReportParams = ReportParams()) -> ReportTables:
    """Scan the log once; sections then read the smallest table that has what they need."""
    return rollup_tables(traffic.rollup(traffic.as_traffic(dated_log, params)))


def rollup_tables(rollup: DataFrame) -> ReportTables:
    cube = write_and_read(rollup.drop("oldest_key"), "rollup")
    return ReportTables(
        cube,
        write_and_read(traffic.client_totals(cube), "clients"),
        write_and_read(traffic.domain_totals(cube), "domains"),
    )


def backfill_packets(
    log: DataFrame,
    params: ReportParams = ReportParams(),
    devices: DataFrame | None = None,
    intercepts: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    span: tuple[date, date] | None = None,
) -> DataFrame:
    """Packets of every report day in a log, with state taken from the log's own history.

    The log is dated, by `assign_report_days`, or not; only a log without dates is aggregated by
    panes where windows overlap. `span` gives the first and the last report date; without it every
    network's own first and last day count, which rows with wrong clocks may stretch. The days
    before a span that its first days look back on are read as well, for their domains and volumes
    only, so a span's packets are those of the whole backfill.
    """
    first, last = (F.lit(d) for d in span) if span else (None, None)
    window, baseline = params.known_domains_window_days, params.volume_baseline_days
    if span and "report_date" not in log.columns:
        since, until = map(utc_literal, times_of_span(span, params))
        log = log.filter((F.col("time") >= since) & (F.col("time") < until))
    rolled = False
    if "report_date" in log.columns:
        rows = traffic.as_traffic(log, params)
    elif params.window_hours <= 24:
        rows = traffic.as_traffic(assign_report_days(log, params), params)
    else:
        rows = panes.report_rollup(log, params)
        rows = write_and_read(rows, "report-rollup") if span else rows
        rolled = True
    inside = rows.filter(F.col("report_date").between(first, last)) if span else rows
    tables = rollup_tables(inside if rolled else traffic.rollup(inside))
    days, volumes = tables.domains, tables.volumes()
    if span:
        earlier = _earlier_days(rows, first, max(window, baseline))
        days = days.unionByName(novelty.first_sightings(earlier), allowMissingColumns=True)
        volumes = volumes.unionByName(volume.daily_volume(earlier))
    novel = novelty.novel_over_history(days, window)
    compared = volume.with_trailing_baseline(volumes, baseline)
    if span:
        novel, compared = (found.filter(F.col("report_date") >= first) for found in (novel, compared))
    return assemble(
        tables, novel, compared, params, devices, intercepts, snapshots, report_calendar(tables.clients, first, last)
    )


def times_of_span(span: tuple[date, date], params: ReportParams) -> tuple[datetime, datetime]:
    """What any report of a span, or of the days before it, can see; days to spare for time zones."""
    days = max(params.known_domains_window_days, params.volume_baseline_days)
    days += -(-int(params.window_hours) // 24) + 2
    first, last = (datetime.combine(day, time()) for day in span)
    return first - timedelta(days=days), last + timedelta(days=2)


def _earlier_days(rows: DataFrame, first: Column, days: int) -> DataFrame:
    """Clients and domains of the days before a span, one row each a day with its queries."""
    before = (F.col("report_date") >= F.date_sub(first, days)) & (F.col("report_date") < first)
    counted = rows.filter(before).groupBy(*DAY, "client", "domain").agg(F.sum("n").alias("n"))
    return write_and_read(counted, "earlier-days")


def evidence_packets(
    tables: ReportTables,
    novel: DataFrame,
    baseline: DataFrame,
    params: ReportParams = ReportParams(),
    devices: DataFrame | None = None,
    intercepts: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Packets for given new domains and a given baseline, as kept in state tables."""
    return assemble(
        tables,
        tables.domains.join(novel.select(*DAY, "domain"), [*DAY, "domain"], "left_semi"),
        volume.with_baseline(tables.volumes(), baseline),
        params,
        devices,
        intercepts,
        snapshots,
        calendar,
    )


def assemble(
    tables: ReportTables,
    found_domains: DataFrame,
    compared_volumes: DataFrame,
    params: ReportParams,
    devices: DataFrame | None,
    intercepts: DataFrame | None,
    snapshots: DataFrame | None,
    calendar: DataFrame | None,
) -> DataFrame:
    """Bring all section rows together with one grouping instead of one join per section.

    Lists without a limit are paged by exact rank, so no packet row grows with the size of a
    network: page 0 has the first `page_size` entries of each, and the pages put together are the
    whole lists in order.
    """
    first_page = F.lit(0).cast("bigint").alias("page")

    def listed(rows: DataFrame, name: str, order: list[Column], entry: Column) -> DataFrame:
        return rows.select(*DAY, first_page, F.struct(*order, entry.alias("entry")).alias(name))

    def single(rows: DataFrame, name: str, *fields) -> DataFrame:
        return rows.select(*DAY, first_page, F.struct(*fields).alias(name))

    cube = tables.cube
    totals = tables.clients.groupBy(*DAY).agg(
        F.sum("total").alias("total_queries"),
        F.count("*").alias("unique_clients"),
        F.sum("blocked").alias("total_blocked"),
    )
    quiet_counts = traffic.off_hours_counts(cube)
    quiet_clients = quiet_counts.groupBy(*DAY, "client").agg(F.sum("count").alias("total"))
    quiet_totals = quiet_clients.groupBy(*DAY).agg(F.sum("total").alias("total_queries"))
    long_lists = _long_lists(tables, quiet_clients, found_domains, compared_volumes, params)
    ranked = paginate(
        write_and_read(long_lists, "lists"),
        (*DAY, "list"),
        [-F.col("weight"), F.col("key")],
        params.page_size,
    )
    paged = label_clients(ranked, devices, client="address").select(
        *DAY, "page", *[_list_entry(name, fields) for name, fields in LONG_LISTS.items()]
    )
    sections = [
        paged,
        single(totals, "summary", "total_queries", "unique_clients", "total_blocked"),
        single(
            tables.domains.groupBy(*DAY).agg(F.count("*").alias("unique_domains")),
            "variety",
            "unique_domains",
        ),
        single(quiet_totals, "quiet_total", "total_queries"),
        listed(
            traffic.top_answered(tables.domains, params.top_domains),
            "top_domains",
            [F.col("rank")],
            F.struct("domain", "count"),
        ),
        listed(
            traffic.of_newest(
                traffic.top_blocked(tables.domains, params.blocked_domains),
                cube,
                "blocked_key",
                "block_rule",
            ),
            "blocked_domains",
            [F.col("rank")],
            F.struct("domain", "count", F.col("block_rule").alias("rule")),
        ),
    ]
    if calendar is not None:
        sections.append(calendar.select(*DAY, first_page))
    reported = totals.select(*DAY) if calendar is None else (
        totals.select(*DAY).unionByName(calendar.select(*DAY))
    )

    def of_reports(side_input: DataFrame) -> DataFrame:
        return side_input.join(reported, list(DAY), "left_semi")

    if intercepts is not None:
        sections.append(
            single(
                enforcement.enforcement_section(of_reports(intercepts)),
                "dns_enforcement",
                "intercepted_queries",
                "intercepted_bytes",
                "udp_queries",
                "tcp_queries",
                "note",
            )
        )
    if snapshots is not None:
        sections.append(
            fingerprints.profile_section(of_reports(snapshots), devices).select(
                *PAGE, F.struct("devices", "recent_changes", "note").alias("device_profiles")
            )
        )
    rows = _union(sections)

    def entries(name: str) -> Column:
        ordered = F.sort_array(F.collect_list(name))
        return F.transform(ordered, lambda row: row["entry"]).alias(name)

    def value(name: str) -> Column:
        found = F.any_value(name, F.lit(True)) if name in rows.columns else F.lit(None)
        return found.alias(name)

    lists = (
        "top_domains",
        "per_client",
        "by_device",
        "new_domains",
        "volume_anomalies",
        "blocked_domains",
    )
    values = ["summary", "variety", "quiet_total"]
    optional = [name for name in ("device_profiles", "dns_enforcement") if name in rows.columns]
    grouped = rows.groupBy(*PAGE).agg(
        *[entries(name) for name in lists], *[value(name) for name in (*values, *optional)]
    )

    def count_of(field: str, found: str = "summary") -> Column:
        return F.coalesce(F.col(f"{found}.{field}"), F.lit(0)).alias(field)

    on_first_page = F.col("page") == 0
    packet = F.struct(
        F.when(
            on_first_page,
            F.struct(
                iso_date(F.col("report_date")).alias("date"),
                count_of("total_queries"),
                count_of("unique_clients"),
                count_of("unique_domains", "variety"),
                F.col("summary.total_blocked").alias("total_blocked"),
            ),
        ).alias("summary"),
        "top_domains",
        "per_client",
        F.struct(
            F.lit(params.off_hours_start).alias("window_start"),
            F.lit(params.off_hours_end).alias("window_end"),
            F.lit(params.timezone).alias("timezone"),
            F.when(
                on_first_page, F.coalesce(F.col("quiet_total.total_queries"), F.lit(0))
            ).alias("total_queries"),
            "by_device",
        ).alias("off_hours_activity"),
        "new_domains",
        "volume_anomalies",
        "blocked_domains",
        *optional,
    )
    return grouped.select(*PAGE, packet.alias("packet"))


def headline_stats(packets: DataFrame) -> DataFrame:
    """The few numbers shown above a report."""
    top_blocked = F.get("packet.blocked_domains", F.lit(0))
    total = F.coalesce(F.col("packet.summary.total_queries"), F.lit(0))
    blocked = F.coalesce(F.col("packet.summary.total_blocked"), F.lit(0))
    percent = blocked_percent(blocked, total)
    line = F.concat_ws(
        " | ",
        F.concat(F.format_number(total, 0), F.lit(" queries")),
        F.concat(percent, F.lit(" blocked")),
        F.concat(
            F.coalesce(F.col("packet.summary.unique_clients"), F.lit(0)), F.lit(" clients")
        ),
        F.concat(
            F.lit("top blocked "),
            top_blocked["domain"],
            F.lit(" ("),
            F.format_number(top_blocked["count"], 0),
            F.lit(")"),
        ),
    )
    return packets.filter(F.col("page") == 0).select(
        *DAY,
        F.col("packet.summary.total_queries").alias("total_queries"),
        F.col("packet.summary.total_blocked").alias("total_blocked"),
        F.col("packet.summary.unique_clients").alias("unique_clients"),
        top_blocked["domain"].alias("top_blocked_domain"),
        top_blocked["count"].alias("top_blocked_count"),
        percent.alias("blocked_percent"),
        line.alias("stat_line"),
    )


# Lists without a limit and the fields of their entries; `device` is the name of the address.
LONG_LISTS = {
    "per_client": ("client", "device", "total", "blocked", "top_domains"),
    "by_device": ("device", "client", "total", "top_domains"),
    "new_domains": ("domain", "count", "device"),
    "volume_anomalies": (
        "client", "device", "today_count", "baseline_mean", "baseline_stddev", "z_score",
        "baseline_days",
    ),
}


def _long_lists(
    tables: ReportTables,
    quiet_clients: DataFrame,
    found_domains: DataFrame,
    compared_volumes: DataFrame,
    params: ReportParams,
) -> DataFrame:
    """All lists without a limit in one frame: address to be named, order, and other fields."""

    def rows(source: DataFrame, name: str, address: str, weight: Column, key: str) -> DataFrame:
        fields = [field for field in LONG_LISTS[name] if field != "device"]
        return source.select(
            *DAY,
            F.lit(name).alias("list"),
            F.col(address).alias("address"),
            weight.cast("double").alias("weight"),
            F.col(key).alias("key"),
            F.struct(*fields).alias(name),
        )

    clients = _with_top_domains(
        tables.clients,
        traffic.client_top_domains(tables.cube, params.client_top_domains),
        F.struct("domain", "count"),
    )
    quiet = _with_top_domains(
        quiet_clients,
        traffic.off_hours_domains(tables.cube, params),
        F.struct("domain", "count", "blocked", "first_seen_local", "last_seen_local"),
    )
    found = traffic.of_newest(found_domains, tables.cube, "newest_key", "client")
    anomalies = volume.volume_anomalies(compared_volumes, None, params)
    return _union(
        [
            rows(clients, "per_client", "client", F.col("total"), "client"),
            rows(quiet, "by_device", "client", F.col("total"), "client"),
            rows(found, "new_domains", "client", F.col("count"), "domain"),
            rows(anomalies, "volume_anomalies", "client", F.abs("z_score"), "client"),
        ]
    )


def _list_entry(name: str, fields: tuple[str, ...]) -> Column:
    """An entry of a list with its rank, NULL on the rows of other lists."""
    label = "first_client" if name == "new_domains" else "device"
    entry = F.struct(
        *[
            F.col("device").alias(label) if field == "device" else F.col(f"{name}.{field}")
            for field in fields
        ]
    )
    return F.when(F.col("list") == name, F.struct("rank", entry.alias("entry"))).alias(name)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _with_top_domains(totals: DataFrame, top: DataFrame, entry: Column) -> DataFrame:
    """Attach each client's short list.

    The list is collected over the order the rows were ranked in, so ranking, collecting
    and joining share one shuffle and one sort.
    """
    keys = [*DAY, "client"]
    ranked = W.partitionBy(*keys).orderBy(F.desc("count"), F.asc("domain"))
    lists = (
        top.withColumn(
            "top_domains",
            F.collect_list(entry).over(
                ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            ),
        )
        .filter(F.col("rank") == 1)
        .select(*keys, "top_domains")
    )
    empty = F.array().cast(lists.schema["top_domains"].dataType)
    return totals.join(lists, keys, "left").withColumn(
        "top_domains", F.coalesce("top_domains", empty)
    )
