from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from cases import ODD_TEXTS, SF_DIR, no_docs, odd_docs, table
from pyspark.sql import functions as F
from querytide.llm import queries, token_files
from querytide.llm.token_files import TokenFileParams
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def expected(tokenizer, docs):
    start = 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = ids_of(tokenizer, text)
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query_equals_the_tokenizer(spark, tokenizer):
    rows = queries.op13_token_files(spark, SF_DIR).collect()
    assert sorted(tuple(r) for r in rows) == sorted(expected(tokenizer, table("documents", "doc_id, text")))


def test_odd_rows(spark, tokenizer):
    found = [tuple(r) for r in token_files.written_digests(odd_docs(spark)).collect()]
    assert sorted(found, key=repr) == sorted(expected(tokenizer, ODD_TEXTS), key=repr)
    assert token_files.written_digests(no_docs(spark)).count() == 0


def test_a_frequent_id_is_dealt_out(spark, tokenizer, workdir):
    docs = [(7, f"text {k % 3}") for k in range(2000)] + [(k, "other") for k in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(frame, workdir + "/files")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = token_files.read(spark, workdir + "/files")
    assert found.filter("doc_id = 7").select("file").distinct().count() > 1
    rows = token_files.starts(token_files.digests(found), group=2).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(d for d, _ in docs)
    at = 0
    for row in rows:
        assert row["start"] == at
        at += row["size"]


def test_files_keep_stripes_indexes_and_filters(spark, tokenizer, workdir):
    """Even ids only: odd ones lie within every range of ids, so only Bloom filters can rule them out."""
    draw = random.Random(3)
    docs = [(2 * k, " ".join(draw.choice("abcdefgh") for _ in range(300))) for k in range(6000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    path = workdir + "/files"
    token_files.write(frame.coalesce(1), path, TokenFileParams(stripe_bytes=1 << 18))
    files = [orc.ORCFile(name) for name in glob.glob(path + "/*.orc")]
    assert sum(f.nstripes for f in files) > len([f for f in files if f.nrows]) * 2

    def read_rows(ids):
        frame = token_files.lookup(spark, path, ids)
        found = {r["doc_id"]: list(r["ids"]) for r in frame.collect()}
        plan = frame._jdf.queryExecution().executedPlan()
        frame._jdf.collectToPython()
        scan = plan.collectLeaves().head()
        return found, scan.metrics().apply("numOutputRows").value()

    found, read = read_rows([4000, 4001])
    assert found == {4000: ids_of(tokenizer, docs[2000][1])} and 0 < read <= 2000
    assert read_rows([4001, 7777]) == ({}, 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 18)
    try:
        whole = token_files.read(spark, path)
        assert whole.rdd.getNumPartitions() > len(files)
        assert whole.count() == 6000
        assert whole.agg(F.sum(F.size("ids"))).first()[0] == sum(len(ids_of(tokenizer, t)) for _, t in docs)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
