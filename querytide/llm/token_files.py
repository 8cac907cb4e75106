"""Token ids of documents in ORC files, in the order of document ids.

Documents are dealt out by ranges of their id and sorted within each, then encoded and written, so
the files' names and rows follow the ids. ORC run-length encodes the integers of a stripe; row
indexes and Bloom filters on `doc_id` let a reader pass over stripes and row groups that cannot
hold the ids it looks for, and stripes are read in parallel. Only ids and sizes are shuffled
after that: `starts` adds up sizes file by file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querytide.llm.common import BATCH_ROWS, prepare, text_bytes
from querytide.llm.packing import Vocabulary, text_encoder
from querytide.session import scratch_path, write_and_read

#: `place` and `before` are the documents and ids ahead of this one in its file.
FILE_SCHEMA = "doc_id long, place long, before long, ids array<int>"


@dataclass(frozen=True)
class TokenFileParams:
    """Layout of the files."""

    end_id: int = 2
    stripe_bytes: int = 64 << 20
    #: Rows after which the writer looks whether the stripe is full; documents may be long.
    check_rows: int = 250
    #: Rows between two entries of the row index, each with its own Bloom filter.
    index_rows: int = 1000
    bloom_false_positives: float = 0.01
    compression: str = "zstd"


def write(
    docs: DataFrame, path: str, params: TokenFileParams = TokenFileParams(), vocabulary: Vocabulary | None = None
) -> None:
    """Write the ids of every document to ORC files in a new folder, in ascending order of `doc_id`.

    A document's ids are those of its whole text and then `end_id`, so a null or empty text is one
    id. Null ids of documents come first. Rows with the same id stay apart, in the order of the
    table's files; repeated rows are all written. An empty table gives files without rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = vocabulary or Vocabulary()
    end = np.array([params.end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocabulary)
        place, before = 0, 0
        for batch in batches:
            encoded = [encoder(text.decode()) + end for text in text_bytes(batch.column("text"))]
            sizes = np.array([len(data) // 4 for data in encoded], "i8")
            ends = np.cumsum(sizes, dtype="i8")
            places = place + np.arange(len(encoded), dtype="i8")
            ids = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(places),
                    pa.array(before + ends - sizes),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), ids),
                ],
                ["doc_id", "place", "before", "ids"],
            )
            place, before = place + len(encoded), before + int(sizes.sum())

    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The row number of the scan keeps rows of one id apart, so that a frequent id is dealt out too.
    ordered = (
        whole.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(F.col("doc_id"), F.col("row"))
        .sortWithinPartitions("doc_id", "row")
    )
    (
        ordered.select("doc_id", "text")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", params.compression)
        .option("orc.stripe.size", params.stripe_bytes)
        .option("orc.rows.between.memory.checks", params.check_rows)
        .option("orc.row.index.stride", params.index_rows)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", params.bloom_false_positives)
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id`, `ids` and the place in the files: `file` in the order of ids, then `place`.

    Spark gives a file's stripes to as many tasks as their size calls for. The session's rows per
    batch of an ORC reader are lowered to BATCH_ROWS if they are more, for long documents.
    """
    key = "spark.sql.orc.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows.select("doc_id", "ids", _file_number().alias("file"), "place", "before")


def _file_number() -> Column:
    """The number in the names of the files, which Spark counts up with the ranges."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")


def lookup(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """`doc_id` and `ids` of some documents; ids that are not there give no row.

    The filter reaches the files: stripes and row groups whose statistics or Bloom filters rule
    the ids out are not read.
    """
    wanted = sorted(set(doc_ids))
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows.filter(F.col("doc_id").isin(wanted)).select("doc_id", "ids")


def starts(rows: DataFrame, group: int = 1024) -> DataFrame:
    """Add `start` to rows with `file` and `before`, `size`: all ids in the files before them.

    The last row of a file tells the file's size. Files are added up in groups of consecutive
    numbers, and the groups among themselves, so no task sees the files of more than one group.
    """
    part = F.floor(F.col("file") / F.lit(group)).cast("long")
    files = write_and_read(
        rows.groupBy("file").agg(F.max(F.col("before") + F.col("size")).alias("total")).withColumn("part", part),
        "file-sizes",
    )
    earlier_files = W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("total").alias("total"))
    earlier_parts = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = parts.select("part", F.coalesce(F.sum("total").over(earlier_parts), F.lit(0)).alias("of_parts"))
    base = (
        files.withColumn("of_files", F.coalesce(F.sum("total").over(earlier_files), F.lit(0)))
        .join(ahead, "part")
        .select("file", (F.col("of_files") + F.col("of_parts")).alias("base"))
    )
    return rows.join(base, "file").withColumn("start", F.col("base") + F.col("before")).drop("base")


def digests(rows: DataFrame) -> DataFrame:
    """The columns of `read` with `size` and `ids_crc32` (little-endian unsigned) in place of the ids."""
    prepare(rows.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            data = memoryview(np.asarray(lists.values).astype("<u4")).cast("B")
            at = lists.offsets.to_pylist()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            sizes = [b - a for a, b in zip(at, at[1:])]
            kept = [batch.column(name) for name in ("doc_id", "file", "place", "before")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "file", "place", "before", "size", "ids_crc32"],
            )

    schema = "doc_id long, file long, place long, before long, size long, ids_crc32 long"
    return rows.select("doc_id", "ids", "file", "place", "before").mapInArrow(digest, schema)


def written_digests(docs: DataFrame, path: str | None = None, params: TokenFileParams = TokenFileParams()) -> DataFrame:
    """Write the files and read them back: `doc_id`, `start`, `n_tokens`, `ids_crc32`.

    Without `path` the files go to the shared folder.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write(docs, path, params)
    sized = write_and_read(digests(read(spark, path)), "token-digests")
    return starts(sized).select("doc_id", "start", F.col("size").alias("n_tokens"), "ids_crc32")
