"""The shared test tables seen as query logs, device maps, counters and response events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.functions.scalar import is_blocked
from querytide.operators.report_days import assign_report_days
from querytide.operators.traffic import as_traffic
from querytide.params import ReportParams
from querytide.session import pin_utc

# Shipping times are whole days, so the bulk log's quiet hours reach over midnight.
BULK_PARAMS = ReportParams(off_hours_start="16:00", off_hours_end="05:00", wrap_off_hours=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_log(events: DataFrame, *extra: str) -> DataFrame:
    """Events as a query log, with any extra columns; `event_id` grows with time, so arrival
    order is its reverse."""
    reason = (
        F.when(F.col("event_type") == "error", "FilteredBlackList")
        .when(F.col("event_type") == "signup", "FilteredSafeSearch")
        .otherwise("NotFilteredNotFound")
    )
    domain = F.concat(
        F.lit("d"),
        F.get_json_object("props", "$.k"),
        F.lit(".u"),
        (F.col("user_id") % 50).cast("string"),
        F.lit(".example"),
    )
    blocked = is_blocked(reason)
    return events.select(
        F.concat(F.lit("net"), (F.col("user_id") % 3).cast("string")).alias("network_id"),
        (-F.col("event_id")).alias("seq"),
        F.col("ts").alias("time"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("client"),
        domain.alias("domain"),
        F.when(F.col("event_type") == "view", "AAAA").otherwise("A").alias("query_type"),
        reason.alias("reason"),
        blocked.alias("blocked"),
        F.when(blocked, F.concat(F.lit("||"), domain, F.lit("^"))).otherwise("").alias(
            "block_rule"
        ),
        *extra,
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_log(table(spark, sf_dir, "events"))


def event_traffic(
    spark: SparkSession, sf_dir: str, params: ReportParams = ReportParams()
) -> DataFrame:
    return as_traffic(assign_report_days(event_log(spark, sf_dir), params), params)


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("site"), (F.col("l_suppkey") % 3).cast("string")).alias("network_id"),
        (-(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("seq"),
        F.col("l_shipdate").alias("time"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("client"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("domain"),
        F.lit("A").alias("query_type"),
        F.when(blocked, "FilteredCustom").otherwise("NotFilteredNotFound").alias("reason"),
        blocked.alias("blocked"),
        F.when(blocked, F.concat(F.lit("rule-"), F.col("l_linestatus"))).otherwise("").alias(
            "block_rule"
        ),
    )


def lineitem_traffic(
    spark: SparkSession, sf_dir: str, params: ReportParams = BULK_PARAMS
) -> DataFrame:
    return as_traffic(assign_report_days(lineitem_log(spark, sf_dir), params), params)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("net"), (key % 3).cast("string")).alias("network_id"),
        F.concat(F.lit("10.0.0."), key.cast("string")).alias("ip"),
        F.col("c_name").alias("device"),
        "c_mktsegment",
    )


# Midnight in UTC is before the start of these hours in winter and inside them in summer.
DST_PARAMS = ReportParams(timezone="Europe/Berlin", off_hours_start="01:30")


def base_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One market segment has no name, so that addresses without a device occur."""
    return _customers(spark, sf_dir).filter(F.col("c_mktsegment") != "HOUSEHOLD").select(
        "network_id", "ip", "device"
    )


def named_twice(devices: DataFrame) -> DataFrame:
    """A device map in which every address occurs under a second name as well."""
    again = devices.withColumn("device", F.concat(F.lit("second "), F.col("device")))
    return devices.unionByName(again)


def all_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).drop("c_mktsegment")


def local_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).filter(F.col("c_mktsegment") == "BUILDING").select(
        "network_id", "ip", F.concat(F.lit("local "), F.col("device")).alias("device")
    )


def supplier_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 0).select(
        F.concat(F.lit("site"), (key % 3).cast("string")).alias("network_id"),
        F.concat(F.lit("s"), key.cast("string")).alias("ip"),
        F.col("s_name").alias("device"),
    )


def raw_entries(log: DataFrame) -> DataFrame:
    """Log rows back in the form the resolver reports them."""
    return log.select(
        "network_id",
        "seq",
        F.struct(
            "client",
            F.struct(F.col("domain").alias("name"), F.col("query_type").alias("type")).alias(
                "question"
            ),
            "reason",
            F.col("block_rule").alias("rule"),
            F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'").alias("time"),
        ).alias("entry"),
    )


def counter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as counter values of a day: quantity is packets, price is bytes."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("site"), (F.col("l_suppkey") % 3).cast("string")).alias("network_id"),
        F.col("l_shipdate").cast("date").alias("report_date"),
        F.when(F.col("l_linestatus") == "O", "udp").otherwise("tcp").alias("proto"),
        F.col("l_shipdate").alias("sample_time"),
        F.floor("l_quantity").alias("packets"),
        F.floor("l_extendedprice").alias("bytes"),
    )


def counter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of firewall listings: rules of either protocol, other rules, headings."""
    kind = F.col("event_type")
    packets, volume = F.floor("value"), F.floor(F.col("value") * 100)
    numbers = F.concat_ws(" ", F.lit("  "), packets.cast("string"), volume.cast("string"))
    line = (
        F.when(kind == "view", F.concat(numbers, F.lit(" REDIRECT udp -- any any udp dpt:53 redir")))
        .when(kind == "click", F.concat(numbers, F.lit(" REDIRECT tcp -- any any tcp dpt:53 redir")))
        .when(kind == "error", F.concat(numbers, F.lit(" ACCEPT tcp -- any any tcp dpt:443")))
        .otherwise(F.lit("Chain PREROUTING (policy ACCEPT)"))
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("net"), (F.col("user_id") % 3).cast("string")).alias("network_id"),
        F.col("ts").alias("sample_time"),
        line.alias("line"),
    )


def counter_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of counters that are often reset."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("net"), (F.col("user_id") % 3).cast("string")).alias("network_id"),
        F.col("event_type").alias("proto"),
        F.col("ts").alias("sample_time"),
        F.floor(F.col("value") * 10).alias("packets"),
        F.floor(F.col("value") * 100).alias("bytes"),
    )


def _order_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns(
        {
            "network_id": F.concat(F.lit("net"), (F.col("o_custkey") % 3).cast("string")),
            "report_date": F.last_day("o_orderdate"),
            "ip": F.concat(F.lit("10.0.0."), F.col("o_custkey").cast("string")),
        }
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as monthly fingerprints; some have no name, no flavor or neither."""
    status = F.col("o_orderstatus")
    return _order_devices(spark, sf_dir).select(
        "network_id",
        "report_date",
        "ip",
        F.date_sub("o_orderdate", 7).cast("timestamp_ntz").alias("first_seen"),
        F.col("o_orderdate").alias("last_seen"),
        F.when(status == "F", "Linux").when(status == "O", "Windows").alias("os_name"),
        F.when(F.col("o_totalprice") >= 100000, F.col("o_orderpriority")).alias("os_flavor"),
        F.when(status == "O", "browser").alias("http_name"),
        F.month("o_orderdate").alias("distance"),
        F.floor("o_totalprice").alias("uptime_min"),
    )


def fingerprint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_devices(spark, sf_dir).select(
        "network_id",
        "report_date",
        "ip",
        F.col("o_orderdate").alias("detected_at"),
        F.col("o_orderstatus").alias("previous_os"),
        F.col("o_orderpriority").alias("current_os"),
    )


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter values on the report days of the event log."""
    log = assign_report_days(
        table(spark, sf_dir, "events").withColumn("time", F.col("ts"))
    )
    return log.select(
        F.concat(F.lit("net"), (F.col("user_id") % 3).cast("string")).alias("network_id"),
        "report_date",
        F.when(F.col("event_type").isin("view", "click"), "udp").otherwise("tcp").alias("proto"),
        F.col("time").alias("sample_time"),
        F.floor(F.col("value")).alias("packets"),
        F.floor(F.col("value") * 100).alias("bytes"),
    )


def event_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's span of activity on a report day as a fingerprint."""
    return (
        assign_report_days(event_log(spark, sf_dir))
        .groupBy("network_id", "report_date", F.col("client").alias("ip"))
        .agg(
            F.min("time").alias("first_seen"),
            F.max("time").alias("last_seen"),
            F.max("query_type").alias("os_name"),
            F.lit(None).cast("string").alias("os_flavor"),
            F.lit(None).cast("string").alias("http_name"),
            F.count("*").alias("distance"),
            F.lit(0).alias("uptime_min"),
        )
    )


def event_fingerprint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_report_days(event_log(spark, sf_dir)).select(
        "network_id",
        "report_date",
        F.col("client").alias("ip"),
        F.col("time").alias("detected_at"),
        F.col("query_type").alias("previous_os"),
        F.col("reason").alias("current_os"),
    )


def response_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as response events: system turns carry no text, and every turn is
    followed by a stop event whose reason depends on who spoke."""
    turns = table(spark, sf_dir, "conversations")
    piece = F.struct(
        F.when(F.col("role") == "system", "message_start").otherwise("content_block_delta").alias(
            "type"
        ),
        F.struct(F.lit("text_delta").alias("type"), "text").alias("delta"),
    )
    stop = F.struct(
        F.lit("message_delta").alias("type"),
        F.struct(
            F.when(F.col("role") == "assistant", "end_turn").otherwise("max_tokens").alias(
                "stop_reason"
            )
        ).alias("delta"),
    )
    return turns.select(
        F.col("conv_id").alias("response_id"),
        F.inline(
            F.array(
                F.struct((F.col("turn") * 2).alias("seq"), F.to_json(piece).alias("body")),
                F.struct((F.col("turn") * 2 + 1).alias("seq"), F.to_json(stop).alias("body")),
            )
        ),
    )
