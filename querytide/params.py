"""Report parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Resolver reason codes that mean "answered by a block filter".
BLOCKED_REASONS = (
    "FilteredBlackList",
    "FilteredSafeSearch",
    "FilteredParental",
    "FilteredCustom",
)

# Keys of one report: every operator works on many networks and many days at once.
DAY = ("network_id", "report_date")


@dataclass(frozen=True)
class ReportParams:
    """Everything a report run can be tuned with."""

    # Windows, list lengths and limits of the daily report.
    timezone: str = "America/Phoenix"
    off_hours_start: str = "01:00"
    off_hours_end: str = "05:00"
    wrap_off_hours: bool = False
    window_hours: int = 24
    close_hour_utc: int = 15
    known_domains_window_days: int = 30
    volume_baseline_days: int = 14
    top_domains: int = 20
    client_top_domains: int = 5
    off_hours_top_domains: int = 10
    blocked_domains: int = 20
    anomaly_z: float = 2.0
    anomaly_ratio: float = 3.0
    fingerprint_changes: int = 20
    page_size: int = 1000
