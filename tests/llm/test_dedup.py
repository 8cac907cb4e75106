from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from cases import ODD_TEXTS, SF_DIR, by_text, no_docs, odd_docs, table
from compare import connect, spark_rows, sql_rows
from pyspark.sql import functions as F
from querytide.llm import queries, simhash
from querytide.llm.components import components
from querytide.llm.exact_dedup import DigestIndex
from querytide.session import scratch_path


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_query_equals_sql(spark):
    name = "op7_exact_dedup"
    assert spark_rows(queries.QUERIES[name](spark, SF_DIR)) == sql_rows(connect(SF_DIR), queries.ORACLES[name])


def test_exact_odd_rows(spark):
    rows = DigestIndex.scratch(spark).assign(odd_docs(spark)).collect()
    groups = defaultdict(list)
    for i, text in ODD_TEXTS:
        groups[normal(text)].append(i)
    digests = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == len(ODD_TEXTS)
    for digest, ids in digests.items():
        own = [r for r in rows if r["text_sha256"] == digest]
        assert by_text([r["doc_id"] for r in own]) == by_text(ids)
        assert {r["group_size"] for r in own} == {len(ids)}
        assert {r["keep_id"] for r in own} == {min((i for i in ids if i is not None), default=None)}
        assert sum(r["kept"] for r in own) == 1
    kept = DigestIndex.scratch(spark).keep_new(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(groups)
    assert DigestIndex.scratch(spark).assign(no_docs(spark)).count() == 0
    assert DigestIndex.scratch(spark).keep_new(no_docs(spark)).count() == 0


def test_index_persists_over_loads(spark):
    folder = scratch_path(spark, "index")
    index = DigestIndex(spark, "index_of_loads", folder, 4)
    schema = "doc_id long, text string"
    one = spark.createDataFrame([(5, "a b"), (6, "a  b"), (7, "c")], schema)
    two = spark.createDataFrame([(1, "a\nb"), (2, "d"), (3, "d")], schema)
    assert {r["doc_id"] for r in index.keep_new(one).collect()} == {5, 7}
    again = DigestIndex(spark, "index_of_loads", folder, 4)
    assert {r["doc_id"] for r in again.keep_new(two).collect()} == {2}
    assert {r["doc_id"] for r in again.keep_new(one).collect()} == {5, 7}  # a repeated load
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.assign(two).collect()}
    assert found == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert index.read().count() == 3
    plan = again.read().hint("merge").groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE index_of_loads")


def slow_print(text, width=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_components(prints, most):
    """Position to the root position, over all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                root[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def expected_rows(docs):
    prints = [slow_print(t) for _, t in docs]
    roots = slow_components(prints, 2)
    smallest = {}
    for root, (i, _) in zip(roots, docs):
        smallest[root] = min((x for x in (smallest.get(root), i) if x is not None), default=None)
    return [(i, f"{p:016x}", smallest[r]) for (i, _), p, r in zip(docs, prints, roots)]


def test_simhash_query_equals_brute_force(spark):
    rows = [tuple(r) for r in queries.op5_simhash_near_dedup(spark, SF_DIR).collect()]
    assert sorted(rows) == sorted(expected_rows(table("documents", "doc_id, text")))


def test_simhash_odd_rows(spark):
    rows = [tuple(r) for r in simhash.near_duplicates(odd_docs(spark)).collect()]
    assert by_text(rows) == by_text(expected_rows(ODD_TEXTS))
    kept = simhash.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert kept.count() == len(set(slow_components([slow_print(t) for _, t in ODD_TEXTS], 2)))
    assert simhash.near_duplicates(no_docs(spark)).count() == simhash.keep_one(no_docs(spark)).count() == 0


def signed(value):
    return value - 2**64 if value >= 2**63 else value


@pytest.mark.parametrize(("most", "crowded"), [(1, 64), (2, 64), (2, 2), (3, 3), (5, 64)])
def test_links_equal_brute_force(spark, monkeypatch, most, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    draw = random.Random(most)
    centres = [draw.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    prints = set(centres)
    for centre in centres:
        for _ in range(40):
            flips = draw.sample(range(64), draw.randint(1, 4))
            prints.add(centre ^ sum(1 << b for b in flips))
    prints = sorted(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(frame, most).collect()}
    expected = {
        tuple(sorted((signed(a), signed(b))))
        for k, a in enumerate(prints)
        for b in prints[:k]
        if (a ^ b).bit_count() <= most
    }
    assert found == expected and expected


def test_components(spark):
    draw = random.Random(8)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 100), (7, 3)]
    pairs += [(draw.randint(200, 300), draw.randint(200, 300)) for _ in range(60)]
    roots = {n: n for p in pairs for n in p}
    for _ in roots:
        for a, b in pairs:
            roots[a] = roots[b] = min(roots[a], roots[b])
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in rows) == sorted((n, roots[n]) for n in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_takes_the_smallest(spark):
    text = " ".join(f"word{k}" for k in range(400))
    rows = [(3, text), (2, text.upper()), (None, text), (2, text), (9, "something else entirely"), (9, "something else entirely")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9]
    assert kept.filter(F.col("doc_id") == 9).count() == 1


@pytest.mark.parametrize("most", [1, 2])
def test_exploded_keys_are_never_broadcast(spark, most):
    draw = random.Random(most)
    prints = [draw.getrandbits(64) for _ in range(300)]
    frame = spark.createDataFrame([(signed(p),) for p in [*prints, *(p ^ 1 << 5 for p in prints)]], "fp long")
    met = simhash.links(frame, most)
    assert {frozenset(r) for r in met.collect()} == {frozenset((signed(p), signed(p ^ 1 << 5))) for p in prints}
    plan = met._jdf.queryExecution().executedPlan().toString()  # the one that ran, after no key was crowded
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.partition("== Initial Plan ==")[0]
