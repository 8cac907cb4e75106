"""From packets to archived report texts, around a model that runs elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.functions.scalar import iso_date
from querytide.operators.messages import prompts, response_stops, response_texts
from querytide.params import DAY, ReportParams
from querytide.sources.archive import read_dated_files, write_reports


PROMPT_SCHEMA = (
    "network_id STRING, page BIGINT, messages ARRAY<STRUCT<role: STRING, content: STRING>>, "
    "response_id STRING, report_date DATE"
)


def numbered_prompts(packets: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """Prompts with the id under which their response events must come back."""
    return prompts(packets, params).withColumn(
        "response_id",
        F.concat_ws(
            "/", "network_id", iso_date(F.col("report_date")), F.col("page").cast("string")
        ),
    )


def reports_from_responses(
    asked: DataFrame, events: DataFrame, strict: bool = True
) -> DataFrame:
    """Report texts from the response events of the prompts, one row per packet page.

    A response that was cut off or never came ends the job, or leaves the whole report of
    its day out when `strict` is off: a report is never archived in part.
    """
    answers = response_texts(events).join(response_stops(events, strict=strict), "response_id")
    parts = asked.select("response_id", *DAY, "page").join(answers, "response_id", "left")
    usable = F.col("text").isNotNull() & ~F.coalesce("truncated", F.lit(True))
    if strict:
        missing = F.raise_error(F.concat(F.lit("no response: "), F.col("response_id")))
        return parts.select(
            *DAY, "page", F.when(usable, F.col("text")).otherwise(missing).alias("report")
        )
    broken = parts.filter(~usable).select(*DAY).distinct()
    return parts.join(broken, list(DAY), "left_anti").select(
        *DAY, "page", F.col("text").alias("report")
    )


def import_dated_files(spark: SparkSession, folder: str, network_id: str, archive: str) -> None:
    """Take a flat folder of report files named by date into the archive."""
    files = read_dated_files(spark, folder)
    write_reports(files.withColumn("network_id", F.lit(network_id)), archive)
