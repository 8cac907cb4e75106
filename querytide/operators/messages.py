"""Texts before and after a model call: prompts out, response events in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.functions.scalar import iso_date
from querytide.params import DAY, ReportParams
from querytide.schemas import RESPONSE_EVENT_SCHEMA

PROMPT_HEAD = (
    "Write the daily network report for {date}.\n"
    "Local time zone: {timezone}. Quiet hours: {start} to {end}.\n"
    "Start with a TL;DR, then new domains, quiet-hours activity, volume changes, blocked\n"
    "domains and an all-clear. Use only this evidence:\n\n"
)


def packet_json(packet="packet"):
    return F.to_json(packet, {"pretty": "true"})


def prompts(packets: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
    """One message list per packet page, ready for a batch inference job."""
    before, after = PROMPT_HEAD.format(
        date="\0",
        timezone=params.timezone,
        start=params.off_hours_start,
        end=params.off_hours_end,
    ).split("\0")
    content = F.concat(
        F.lit(before), iso_date(F.col("report_date")), F.lit(after), packet_json()
    )
    return packets.select(
        *DAY,
        "page",
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias(
            "messages"
        ),
    )


def parse_response_events(events: DataFrame) -> DataFrame:
    """Event bodies -> type, text and stop reason."""
    return events.select(
        "response_id", "seq", F.from_json("body", RESPONSE_EVENT_SCHEMA).alias("event")
    ).select(
        "response_id",
        "seq",
        F.col("event.type").alias("type"),
        F.col("event.delta.text").alias("text"),
        F.col("event.delta.stop_reason").alias("stop_reason"),
    )


def response_texts(events: DataFrame, run_length: int = 4096) -> DataFrame:
    """Join the text pieces of each response in order; other event types carry no text.

    Runs of neighbouring pieces are joined first, so one long response is put together by
    many tasks and the last step only sees one string per run. A response without any text
    event comes out as empty text.
    """
    parsed = parse_response_events(events)
    is_text = F.col("type") == "content_block_delta"

    def joined(order: str, text: str):
        pieces = F.sort_array(
            F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text)))
        )
        return F.array_join(F.transform(pieces, lambda piece: piece[text]), "")

    runs = (
        parsed.withColumn("_text", F.when(is_text, F.col("text")))
        .withColumn("_run", F.floor(F.col("seq") / run_length))
        .groupBy("response_id", "_run")
        .agg(joined("seq", "_text").alias("_joined"))
    )
    return runs.groupBy("response_id").agg(joined("_run", "_joined").alias("text"))


def response_stops(
    events: DataFrame, limit_reason: str = "max_tokens", strict: bool = False
) -> DataFrame:
    """Last stop reason of each response and whether it was cut off.

    `strict=True` ends the job when a response was cut off.
    """
    parsed = parse_response_events(events)
    is_stop = F.col("type") == "message_delta"
    stops = (
        parsed.groupBy("response_id", F.when(is_stop, F.col("stop_reason")).alias("stop_reason"))
        .agg(F.max(F.when(is_stop, F.col("seq"))).alias("seq"))
        .groupBy("response_id")
        .agg(F.max_by("stop_reason", "seq").alias("stop_reason"))
    )
    truncated = F.coalesce(F.col("stop_reason") == limit_reason, F.lit(False))
    if strict:
        truncated = F.when(
            truncated,
            F.raise_error(
                F.concat(F.lit("response cut off: "), F.col("response_id").cast("string"))
            ).cast("boolean"),
        ).otherwise(truncated)
    return stops.select("response_id", "stop_reason", truncated.alias("truncated"))
