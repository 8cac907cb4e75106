from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import ODD_TEXTS, SF_DIR, no_docs, odd_docs, table
from pyspark.sql import functions as F
from querytide.llm import packing, queries
from querytide.llm.packing import Island, PackingParams
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected_pieces(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)]
    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
        yield doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def check_gapless(rows, capacity=1024):
    bins = defaultdict(list)
    for row in rows:
        bins[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query_packs_every_piece_tightly(spark, tokenizer):
    rows = queries.op1_best_fit_packing(spark, SF_DIR).collect()
    expected = [p for i, t in table("documents", "doc_id, text") for p in expected_pieces(tokenizer, i, t)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert check_gapless(rows) <= least * 1.01 + 1


def test_odd_rows(spark, tokenizer):
    rows = packing.pack_documents(odd_docs(spark)).collect()
    expected = [p for i, t in ODD_TEXTS for p in expected_pieces(tokenizer, i, t)]
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    check_gapless(rows)
    assert packing.pack_documents(no_docs(spark)).count() == 0


def test_no_pieces_no_sequences(spark):
    packed = packing.pack_documents(no_docs(spark), with_ids=True)
    assert packing.sequences(packed).count() == 0


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, "more " * 3000)], "doc_id long, text string")
    packed = packing.pack_documents(docs, with_ids=True)
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    rows = packing.sequences(packed).join(sizes, "sequence_id").collect()
    assert all(len(r["ids"]) == r["n"] for r in rows)
    total = sorted(i for r in rows for i in r["ids"])
    assert total == sorted(i for t in ("some words here", "", "more " * 3000) for i in [*tokenizer.encode(t).ids, 2])


@pytest.mark.parametrize("rounds", [2, 3, 4, 6])
def test_blocks_rounds_and_islands_lose_nothing(spark, rounds):
    draw = random.Random(4)
    lengths = [1024 if k % 2 and rounds > 2 else draw.randint(1, 1024) for k in range(3000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
    params = PackingParams(block_items=200, islands=3, rounds=rounds)
    packed = packing.pack(pieces, params).join(pieces, "key")
    rows = packed.collect()
    assert sorted(r["key"] for r in rows) == list(range(3000))
    assert check_gapless(rows) <= -(-sum(r["length"] for r in rows) // 1024) * 1.02 + 1


def test_crossover_keeps_each_item_once():
    draw = random.Random(5)
    lengths = [draw.randint(1, 1000) for _ in range(400)]
    island = Island(lengths, PackingParams(), 1)
    one, other = island.fresh(0.3), island.fresh(0.6)
    for child in (island.crossover(one, other), island.mutate(one), *island.evolve([one, other])):
        assert sorted(i for b in child for i in b) == list(range(400))
        assert all(0 < sum(lengths[i] for i in b) <= 1024 for b in child)
    assert island.fitness(island.evolve([one, other])[0]) >= max(island.fitness(one), island.fitness(other))
    injected = [set(b) for b in other if sum(lengths[i] for i in b) >= 0.985 * 1024]
    child = [set(b) for b in island.crossover(one, other)]
    assert sum(any(b <= c for c in child) for b in injected) >= (len(injected) + 1) // 2
