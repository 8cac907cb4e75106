"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame, SparkSession

SF_DIR = "/root/testdata/sf0.001"

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "counts string, hash string, rank int, digest string, key int, found string"
)

ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n\r\v\f "),
    (4, "one"),
    (5, "one two"),
    (6, "One TWO three\nOne TWO three\n\nfour"),
    (6, "One TWO three\nOne TWO three\n\nfour"),
    (None, "a row without an id, but with some words in it"),
    (None, None),
    (7, "Überraschung\u00a0naïve ſtraße \U0001f600 x\x1cy\x85z   end  "),
    (8, "a" * 30_000),
    (9, " " * 20_000 + "x" + "\n" * 5_000),
    (10, "word and another word " * 3_000),
    (11, "12345 67890 !!! ??? ### $$$ <|endoftext|> it's we'll"),
]


def odd_docs(spark: SparkSession) -> DataFrame:
    rows = [(i, t, "en", "s", len(t or ""), "c", "h", 1, "d", 2, "f") for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def table(name: str, columns: str, sf_dir: str = SF_DIR) -> list[tuple]:
    return duckdb.connect().execute(f"SELECT {columns} FROM '{sf_dir}/{name}.parquet'").fetchall()


def by_text(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=repr)
