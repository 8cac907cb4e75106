"""Alerts for new domains from a stream of log rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from querytide.operators.report_days import assign_report_days
from querytide.params import ReportParams

MS_PER_DAY = 86_400_000
#: Tasks over which the rows of one domain and day are dealt before they become one.
SHARES = 16


def stream_novel_domains(
    log: DataFrame,
    window_days: int = ReportParams.known_domains_window_days,
    lateness: str = "2 days",
    params: ReportParams = ReportParams(),
) -> DataFrame:
    """Emit a domain on each report day on which it is new.

    State is the last day each domain was seen. It expires when the domain would count as
    new anyway, so the state holds one window of domains and not all domains ever seen.
    Days older than the state's last day count as known. Rows whose report day is behind the
    watermark, `lateness` before the newest, are dropped here, also those of a domain never seen;
    `LateDomains` beside this stream keeps them and gives their alerts.

    Rows are reduced to one a domain, day and share before the state function sees them, by
    Spark's own deduplication, whose state the watermark empties. The shares deal a hot domain's
    rows out over the tasks.
    """
    share = F.pmod(F.xxhash64("client", "time"), F.lit(SHARES)).cast("int")
    days = (
        assign_report_days(log, params)
        .select("network_id", "domain", F.unix_date("report_date").alias("day"), share.alias("share"))
        .withColumn("day_time", F.timestamp_seconds(F.col("day").cast("bigint") * 86400))
        .withWatermark("day_time", lateness)
        .dropDuplicates(["network_id", "domain", "day_time", "share"])
        .select("network_id", "domain", "day", "day_time")
    )

    # A local function travels with the query, so the workers need no copy of this package.

    def alerts(
        key: tuple, frames: Iterable[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        seen: set[int] = set()
        for frame in frames:
            seen.update(frame["day"].unique().tolist())
        new = []
        for day in sorted(seen):
            if last is None or day - last > window_days:
                new.append(day)
            last = day if last is None else max(last, day)
        state.update((last,))
        expiry = (last + window_days + 1) * MS_PER_DAY
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"network_id": key[0], "domain": key[1], "day": new})

    return (
        days.groupBy("network_id", "domain")
        .applyInPandasWithState(
            alerts,
            "network_id string, domain string, day int",
            "last int",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
        .select("network_id", F.date_from_unix_date("day").alias("report_date"), "domain")
    )
