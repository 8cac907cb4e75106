"""Pages of long lists, by exact rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.session import write_and_read


def ranked(entries: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add `rank`, from 0, of every row in its group.

    Rows are dealt out by ranges of (group, order), so a group of any length is spread over many
    tasks. A row's rank is its place in its range plus the rows its group has in earlier ranges;
    only those numbers are added up across ranges. The ranges are written to the shared folder,
    so that places and numbers come from the same ones. Rows that tie in `order` are ranked by a
    hash of the whole row.
    """
    group = list(group)
    keys = [f"_order{k}" for k in range(len(order) + 1)]
    whole = F.xxhash64(*entries.columns)
    keyed = entries.withColumns(dict(zip(keys, [*order, whole])))
    dealt = keyed.repartitionByRange(*[F.col(name) for name in (*group, *keys)])
    placed = write_and_read(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy(*group, "_range").agg(F.count("*").alias("_rows")).select(
        *group, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*keys))
    return (
        placed.withColumn("_place", place)
        .join(before, [*group, "_range"])
        .withColumn("rank", (F.col("_before") + F.col("_place") - 1).cast("bigint"))
        .select(*entries.columns, "rank")
    )


def paginate(
    entries: DataFrame, group: Sequence[str], order: Sequence[Column], page_size: int
) -> DataFrame:
    """Add `rank` and `page`: the first `page_size` rows of each group are page 0, and so on."""
    return ranked(entries, group, order).withColumn(
        "page", F.floor(F.col("rank") / F.lit(page_size)).cast("bigint")
    )
