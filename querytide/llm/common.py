"""Small helpers the operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold, so that a batch of long texts stays small.
BATCH_ROWS = 1000

_sent: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Ready the session for Python tasks: small Arrow batches, and this package on every worker.

    The rows per Arrow batch are lowered to BATCH_ROWS if they are more. The package is sent to
    the executors as a zip, once for each Spark application, so they need no copy of their own.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _sent:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="querytide-")) / "querytide.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _sent.add(context.applicationId)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores put before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(values: pa.Array) -> list[str]:
    """Text values with null as the empty text."""
    return [v or "" for v in values.to_pylist()]


def text_bytes(values: pa.Array) -> list[bytes]:
    """UTF-8 of text values with null as the empty text."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def slices(items: list, sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive runs of `items` of about `most` in size each; a larger item is its own run."""
    start, total = 0, 0
    for i in range(len(items)):
        if i > start and total + sizes[i] > most:
            yield slice(start, i)
            start, total = i, 0
        total += sizes[i]
    if start < len(items):
        yield slice(start, len(items))


def one_row_each(docs: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`, all columns kept.

    Spark trims each map task's rows to one a key before the shuffle, so a key that many rows
    share never meets in one task.
    """
    rank = fresh(docs, "rank")
    window = Window.partitionBy(*keys).orderBy(*order)
    return docs.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)
