"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.llm import (
    bpe,
    conversations,
    language,
    licenses,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash,
    token_files,
    url_filter,
    whitening,
)
from querytide.llm.common import read_table
from querytide.llm.exact_dedup import DigestIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"))


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, max_bits=2)


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DigestIndex.scratch(spark).assign(read_table(spark, sf_dir, "documents"))


ORACLES["op7_exact_dedup"] = r"""
    WITH digests AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
    FROM digests WINDOW same AS (PARTITION BY text_sha256)
"""


def _held_out() -> Column:
    """True for the fifth of documents that models are judged on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, read_table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(docs, rules).select(*columns)


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    trees = quality_classifier.learn(docs, labels.filter(~_held_out()))
    return quality_classifier.score(docs, trees).withColumn("held_out", _held_out())


@query
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(read_table(spark, sf_dir, "documents"))


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        url_filter.Rule("org", "/", True),
        url_filter.Rule("example.org", "/es/", False),
        url_filter.Rule("example.org", "/en/1", False),
        url_filter.Rule("com", "/fr/", True),
        url_filter.Rule("com", "/de/", False),
    ]
    return url_filter.judge(read_table(spark, sf_dir, "pages"), rules)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(~_held_out()))
    return language.predict(docs, model).withColumn("held_out", _held_out())


@query
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs, path)


@query
def license_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of the pieces of text between a page's tags, which are files below host and path.

    A piece that is a license notice speaks for its page and for the pages below it. A page without
    a host has no path and passes nothing on; a page without html has no rows.
    """
    pages = read_table(spark, sf_dir, "pages")
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1)
    labels = F.array_join(F.reverse(F.split(F.lower(host), "[.]")), "/")
    folder = F.concat_ws("/", labels, F.nullif(F.btrim(path, F.lit("/")), F.lit("")))
    pieces = F.filter(F.split("html", "<[^>]*>"), lambda piece: piece.rlike(r"[^\x20\x09-\x0D]"))
    files = pages.select(
        F.col("page_id").alias("doc_id"), labels.alias("labels"), folder.alias("folder"), F.posexplode(pieces).alias("piece", "text")
    )
    place = F.when(F.col("labels") != "", F.concat_ws("/", "folder", "piece"))
    return licenses.scan(files, place).withColumnRenamed("doc_id", "page_id")


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_digests(read_table(spark, sf_dir, "documents"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut off, repeated or given to the user, by a checksum of their place."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    kept = rows.select("conv_id", "turn", role, text, kind).filter("kind <> 0")
    return kept.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return conversations.repair_digests(_damaged(rows), rows)


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))
