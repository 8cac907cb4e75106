"""Reports over windows longer than a day, from one aggregate for each day.

Such windows overlap, so a log row counts for several reports. The log is aggregated once into
panes: the day up to a report's close, cut in two where the oldest day of a window is only partly
inside. A report adds up the panes of its window. For a key that sum changes only when a pane
comes in or falls out, so it is kept as rows (from, upto) of reports with equal values; log rows
and panes are never copied for each report that sees them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.functions.scalar import arrival_key, in_off_hours, iso_date, local_date
from querytide.operators.report_days import assign_report_days
from querytide.operators.traffic import ROLLUP_KEYS, as_traffic, keep_top
from querytide.params import DAY, ReportParams
from querytide.session import pin_utc

HOUR = 3_600_000_000
PANE_KEYS = ("network_id", "pane", "late", "client", "domain", "blocked", "block_rule", "quiet_date")
SUMS, LEAST, MOST = ("n",), ("first_time", "oldest_key"), ("last_time", "newest_key")


def _window(params: ReportParams) -> tuple[int, int]:
    """Whole days of a window, and the hours of the day before them."""
    return divmod(max(int(params.window_hours), 24), 24)


def pane_rollup(log: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """One pass over the log: a row for each pane and what sections tell apart.

    `pane` numbers the closes, `late` marks the part of a pane that the oldest day of a window
    has, and `quiet_date` is the report whose off-hours a query falls in.
    """
    pin_utc(log.sparkSession)
    _, hours = _window(params)
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    since_close = micros - F.lit(int(params.close_hour_utc) * HOUR)
    pane = (F.floor(since_close / F.lit(24 * HOUR)) + 1).cast("int")
    late = F.pmod(since_close, F.lit(24 * HOUR)) >= F.lit((24 - hours) * HOUR)
    arrival = arrival_key(F.col("time"), F.col("seq"))
    rows = log.withColumns({"pane": pane, "late": late, "quiet_date": _quiet_date(params)})
    return rows.groupBy(*PANE_KEYS).agg(
        F.count("*").alias("n"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.min(arrival).alias("oldest_key"),
        F.max(arrival).alias("newest_key"),
    )


def _quiet_date(params: ReportParams) -> Column:
    """Off-hours end on the local day of a query or, when they wrap over midnight, on the next."""
    today = local_date(F.col("time"), params.timezone)

    def inside(day: Column) -> Column:
        hours = (params.off_hours_start, params.off_hours_end, params.timezone, params.wrap_off_hours)
        return in_off_hours(F.col("time"), day, *hours)

    tomorrow = F.date_add(today, 1)
    return F.when(inside(today), today).when(inside(tomorrow), tomorrow)


def over_windows(
    panes: DataFrame,
    keys: Sequence[str],
    params: ReportParams = ReportParams(),
    sums: Sequence[str] = SUMS,
    least: Sequence[str] = (),
    most: Sequence[str] = (),
) -> DataFrame:
    """Sums, minima and maxima of the keys over every window: rows with `from` and `upto` closes.

    Each pane of a key counts from its own close on and falls out a window later, its late part a
    day after the rest. Between two such closes nothing changes. A key's group has at most three
    rows for each of its panes, however long the window. The panes are dealt out by their keys
    once, and the rows of each of the three closes are windows over them.
    """
    whole, hours = _window(params)
    names = {**{c: F.sum for c in sums}, **{c: F.min for c in least}, **{c: F.max for c in most}}
    # Only the late part is left of a window's oldest day.
    own = panes.groupBy(*keys, "pane").agg(
        *[f(c).alias(c) for c, f in names.items()],
        *[f(F.when(F.col("late"), F.col(c))).alias(f"late_{c}") for c, f in names.items() if hours],
    )
    order = W.partitionBy(*keys).orderBy("pane")

    def changes(after: int, unless: Sequence[int] = ()) -> DataFrame:
        """The rows that begin so many closes after a pane, `unless` another pane's begin there."""
        days, before = order.rangeBetween(after + 1 - whole, after), order.rangeBetween(after - whole, after - whole)
        ahead = order.rangeBetween(after + 1, after + whole)
        start = F.col("pane") + after
        ends = [F.min("pane").over(ahead), F.min("pane").over(days) + whole]
        if hours:
            ends.append(F.when(F.max(f"late_{sums[0]}").over(before).isNotNull(), start + 1))

        def value(name: str) -> Column:
            of_days = names[name](name).over(days)
            if not hours:
                return F.coalesce(of_days, F.lit(0)) if name in sums else of_days
            of_late = names[name](f"late_{name}").over(before)
            if name in sums:
                return F.coalesce(of_days, F.lit(0)) + F.coalesce(of_late, F.lit(0))
            return (F.least if name in least else F.greatest)(of_days, of_late)

        taken = [F.count("pane").over(order.rangeBetween(k, k)) for k in unless]
        late = [F.col(f"late_{sums[0]}").isNotNull()] if after > whole else []
        rows = own.select(
            *keys, start.alias("from"), (F.least(*ends) - 1).alias("upto"),
            *[value(name).alias(name) for name in names],
            reduce(Column.__and__, [*late, *[n == 0 for n in taken]], F.lit(True)).alias("_begins"),
        )
        return rows.filter(F.col("_begins") & (F.col(sums[0]) > 0)).drop("_begins")

    found = changes(0).unionByName(changes(whole, [whole]))
    return found.unionByName(changes(whole + 1, [whole + 1, 1])) if hours else found


def by_report(spans: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """A row for each report of a span, with its `report_date`."""
    return _with_date(spans.withColumn("_close", F.explode(F.sequence("from", "upto"))).drop("from", "upto"), params)


def _with_date(rows: DataFrame, params: ReportParams) -> DataFrame:
    close = F.col("_close").cast("bigint") * F.lit(24 * HOUR) + F.lit(int(params.close_hour_utc) * HOUR)
    instant = F.timestamp_micros(close).cast("timestamp_ntz")
    return rows.withColumn("report_date", local_date(instant, params.timezone)).drop("_close")


def report_rollup(log: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """What `traffic.rollup` gives for all reports of a log, for windows of any length.

    The result has the rows of every report's own rollup, which sections and packets read; up to a
    day's window they come straight from the log.
    """
    if int(params.window_hours) <= 24:
        return _merged(as_traffic(assign_report_days(log, params), params))
    keys = [k for k in PANE_KEYS if k not in ("pane", "late")]
    spans = over_windows(pane_rollup(log, params), keys, params, SUMS, LEAST, MOST)
    quiet = F.coalesce(F.col("quiet_date") == F.col("report_date"), F.lit(False))
    return _merged(by_report(spans, params).withColumn("off_hours", quiet))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ROLLUP_KEYS).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.min(c).alias(c) for c in LEAST],
        *[F.max(c).alias(c) for c in MOST],
    )


def summary(panes: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """`traffic.summary` of every window.

    How many clients and domains a window has is counted by when they come in and fall out, so no
    key is repeated for each report that it is in.
    """
    blocked = panes.withColumn("blocked_n", F.when(F.col("blocked"), F.col("n")).otherwise(0))
    totals = by_report(over_windows(blocked, ["network_id"], params, ("n", "blocked_n")), params)
    joined = totals.select(
        *DAY, F.col("n").alias("total_queries"), F.col("blocked_n").alias("total_blocked")
    )
    for key, name in (("client", "unique_clients"), ("domain", "unique_domains")):
        joined = joined.join(by_report(_present(panes, key, name, params), params), list(DAY))
    return joined.withColumn("date", iso_date(F.col("report_date")))


def _present(panes: DataFrame, key: str, name: str, params: ReportParams) -> DataFrame:
    """How many values of a key each window has.

    A pane's key is there until its pane falls out or the key's next one comes in, so only the
    panes that have it are shuffled, without what was counted in them.
    """
    whole, hours = _window(params)
    late = F.max(F.col("late").cast("int")) if hours else F.lit(0)
    held = panes.groupBy("network_id", key, "pane").agg(late.alias("late"))
    following = F.lead("pane").over(W.partitionBy("network_id", key).orderBy("pane"))
    spans = held.select("network_id", F.col("pane").alias("from"), (F.least(F.col("pane") + whole + F.col("late"), following) - 1).alias("upto"))
    return _held(spans, ["network_id"], name)


def _held(spans: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The number of spans that hold at each close, as spans of equal numbers."""
    steps = F.explode(
        F.array(
            F.struct(F.col("from").alias("close"), F.lit(1).alias("step")),
            F.struct((F.col("upto") + 1).alias("close"), F.lit(-1).alias("step")),
        )
    ).alias("s")
    changes = spans.select(*keys, steps).groupBy(*keys, F.col("s.close").alias("from"))
    order = W.partitionBy(*keys).orderBy("from")
    return (
        changes.agg(F.sum("s.step").alias("step"))
        .select(
            *keys, "from", (F.lead("from").over(order) - 1).alias("upto"),
            F.sum("step").over(order).alias(name),
        )
        .filter(F.col(name) > 0)
    )


def top_domains(panes: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """`traffic.top_domains` of every window; only domains that reach its k-th count are ranked."""
    spans = over_windows(panes.filter(~F.col("blocked")), ["network_id", "domain"], params)
    rows = _reaching(spans, params.top_domains, params).withColumnRenamed("n", "count")
    return keep_top(_with_date(rows, params), DAY, "domain", params.top_domains)


def _reaching(spans: DataFrame, k: int, params: ReportParams) -> DataFrame:
    """A row for each report of a span whose `n` is at least the k-th largest there, ties included.

    How many spans have each count tells the k-th count of a close without ranking any. Spans are
    first held against the least of these counts in two windows' time, so that few are repeated for
    their reports.
    """
    whole, _ = _window(params)
    counts = _held(spans, ["network_id", "n"], "spans").withColumn("_close", F.explode(F.sequence("from", "upto")))
    above = W.partitionBy("network_id", "_close").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    limits = (
        counts.withColumn("above", F.coalesce(F.sum("spans").over(above), F.lit(0)))
        .filter(F.col("above") < k)
        .groupBy("network_id", "_close")
        .agg(F.min("n").alias("_least"))
    )
    block = F.floor(F.col("_close") / whole)
    # A span is no longer than a window, so it ends in the block that it begins in or in the next.
    blocks = (
        limits.select("network_id", "_least", F.explode(F.array(block, block - 1)).alias("_block"))
        .groupBy("network_id", "_block")
        .agg(F.min("_least").alias("_least"))
    )
    near = spans.withColumn("_block", F.floor(F.col("from") / whole)).join(blocks, ["network_id", "_block"])
    near = near.filter(F.col("n") >= F.col("_least")).drop("_block", "_least")
    rows = near.withColumn("_close", F.explode(F.sequence("from", "upto"))).drop("from", "upto")
    met = rows.join(limits, ["network_id", "_close"]).filter(F.col("n") >= F.col("_least"))
    return met.select("network_id", "domain", "n", "_close")


def client_totals(panes: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """`traffic.client_totals` of every window."""
    rows = panes.withColumn("blocked", F.when(F.col("blocked"), F.col("n")).otherwise(0))
    spans = over_windows(rows, ["network_id", "client"], params, ("n", "blocked"))
    return by_report(spans.withColumnRenamed("n", "total"), params)


def daily_volume(panes: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """`volume.daily_volume` of every window."""
    return client_totals(panes, params).select(*DAY, "client", F.col("total").alias("query_count"))
