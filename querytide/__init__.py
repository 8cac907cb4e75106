"""Daily evidence reports over resolver query logs, as Spark DataFrame jobs."""

from querytide.params import ReportParams

__all__ = ["ReportParams"]
