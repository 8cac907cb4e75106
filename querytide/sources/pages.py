"""Captured query-log pages -> log rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querytide.functions.scalar import is_blocked, normalised_domain, or_empty, utc_time
from querytide.params import BLOCKED_REASONS
from querytide.schemas import LOG_COLUMNS, PAGE_SCHEMA

#: 2100-01-01, from which the age of pages is counted, the oldest age in seconds that has numbers
#: of its own, and the numbers of a second, which are more than any network has entries in one.
LAST_MICROSECOND = 4_102_444_800_000_000
OLDEST_SECOND = 2**32 - 1
SECOND_PLACES = 2**31


def read_pages(
    spark: SparkSession,
    paths: str | Sequence[str],
    network_id: str | Column = "network_id",
    layout: str = "documents",
) -> DataFrame:
    """Read any number of page files as one frame of raw entries.

    `layout="documents"` is one page per file as captured; `layout="lines"` is one page per
    line, which Spark can split and is the form to keep at scale. A page that is not JSON
    becomes one row with only `raw_page` set, so that `rejected_rows` reports it.
    `network_id` is a partition column of the folder or a literal column. Of pages that cover the
    same times the one in the file of the lower number, or earlier in a file, arrived first.
    """
    if layout not in ("documents", "lines"):
        raise ValueError(f"unknown page layout: {layout}")
    pages = (
        spark.read.schema(PAGE_SCHEMA)
        .option("multiLine", layout == "documents")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(paths if isinstance(paths, str) else list(paths))
    )
    network = F.col(network_id) if isinstance(network_id, str) else network_id
    name = F.col("_metadata.file_name")
    number = F.struct(
        F.length(name).alias("length"),
        name.alias("name"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return _unwrap(
        pages.select(
            network.alias("network_id"),
            F.col("_corrupt_record").alias("raw_page"),
            "oldest",
            "data",
            number.alias("_number"),
        )
    )


def pages_from_text(
    captured: DataFrame, column: str = "page", number: str | None = None
) -> DataFrame:
    """The same for pages kept as a text column next to their `network_id`.

    `number` is a column that grows from newer pages to older ones, for pages that cover the same
    times; without it their text decides.
    """
    parsed = F.from_json(
        column,
        PAGE_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    return _unwrap(
        captured.select(
            "network_id", parsed.alias("_page"), F.col(number or column).alias("_number")
        ).select(
            "network_id",
            F.col("_page._corrupt_record").alias("raw_page"),
            "_page.oldest",
            "_page.data",
            "_number",
        )
    )


def _unwrap(pages: DataFrame) -> DataFrame:
    """One row per entry, numbered so that `seq` grows from the newest entry to the oldest.

    Pages follow each other by their oldest entry, to the microsecond; of equal ones that which
    begins with the newer entry comes first, then `_number` decides. A page's entries come after
    those of all pages before it, whatever their number. Without its own statement the time of a
    page's last entry tells how old it is. Only pages that end within the same second are looked at
    together, so the numbers of a load hold beside those of other loads. Pages without a time stand
    for themselves.

    The explode also keeps later filters from being pushed into the JSON parser, which would
    parse every page twice.
    """
    unreadable = F.col("raw_page").isNotNull()
    missing = F.array(F.lit(None).cast(pages.schema["data"].dataType.elementType))
    oldest = F.coalesce(
        utc_time(F.col("oldest")), utc_time(F.try_element_at("data", F.lit(-1))["time"])
    )
    newest = utc_time(F.try_element_at("data", F.lit(1))["time"])
    aged = pages.select(
        "network_id",
        "raw_page",
        F.when(unreadable, missing).otherwise(F.col("data")).alias("data"),
        "_number",
        (F.lit(LAST_MICROSECOND) - F.unix_micros(oldest.cast("timestamp"))).alias("_age"),
        newest.alias("_newest"),
    )
    second = F.floor(F.col("_age") / 1_000_000)
    second = F.greatest(F.least(second, F.lit(OLDEST_SECOND)), F.lit(-OLDEST_SECOND))
    alone = F.when(F.col("_age").isNull(), F.xxhash64("raw_page", "_number"))
    before = (
        Window.partitionBy("network_id", "_second", "_alone")
        .orderBy("_age", F.desc_nulls_last("_newest"), "_number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    entries = (
        aged.withColumn("_second", second)
        .withColumn("_alone", alone)
        .withColumn("_before", F.coalesce(F.sum(F.size("data")).over(before), F.lit(0)))
        .select(
            "network_id",
            "raw_page",
            (F.coalesce("_second", F.lit(0)) * SECOND_PLACES + F.col("_before")).alias("_first"),
            F.posexplode("data").alias("_place", "entry"),
        )
    )
    return entries.select(
        "network_id",
        (F.col("_first") + F.col("_place")).cast("bigint").alias("seq"),
        "raw_page",
        "entry.*",
    )


def parse_entries(
    raw: DataFrame,
    blocked_reasons: Iterable[str] = BLOCKED_REASONS,
    normalize: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Project raw entries to log columns plus `reject_reason` (NULL for good rows).

    Bad rows carry the entry, or the unreadable page, as `raw_text`. `strict=True` ends the job on the first bad entry instead of setting it apart.
    """
    domain = F.col("question.name")
    page = F.col("raw_page") if "raw_page" in raw.columns else F.lit(None).cast("string")
    entry = F.to_json(F.struct("client", "question", "reason", "rule", "time"))
    time = utc_time(F.col("time"))
    reject = (
        F.when(page.isNotNull(), F.lit("unreadable page"))
        .when(F.col("time").isNull(), F.lit("missing time"))
        .when(time.isNull(), F.lit("bad time"))
        .when(domain.isNull(), F.lit("missing question name"))
        .when(F.col("question.type").isNull(), F.lit("missing question type"))
    )
    if strict:
        reject = F.when(
            reject.isNotNull(),
            F.raise_error(F.concat(F.lit("bad log entry: "), reject)).cast("string"),
        )
    return raw.select(
        "network_id",
        "seq",
        time.alias("time"),
        or_empty(F.col("client")).alias("client"),
        (normalised_domain(domain) if normalize else domain).alias("domain"),
        F.col("question.type").alias("query_type"),
        or_empty(F.col("reason")).alias("reason"),
        is_blocked(F.col("reason"), blocked_reasons).alias("blocked"),
        or_empty(F.col("rule")).alias("block_rule"),
        reject.alias("reject_reason"),
        F.when(reject.isNotNull(), F.coalesce(page, entry)).alias("raw_text"),
    )


def log_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).select(*LOG_COLUMNS)


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull())
