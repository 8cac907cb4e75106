from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from cases import ODD_TEXTS, by_text, no_docs, odd_docs, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from querytide.llm import quality_classifier, quality_rules, queries, text_stats
from querytide.llm.quality_rules import base_failed, learn, verdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    duplicate = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>") if words else 0
    return len(words), sum(map(len, words)), symbols, duplicate, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é\u00a0", max_size=60))
def test_counts(text):
    assert text_stats.counts(text.encode())[:5] == slow_counts(text)


def test_rules_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op4_quality_rules(spark, sf_dir).collect()}
    docs = dict(table("documents", "doc_id, text", sf_dir))
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        counted = slow_counts(text)
        row = rows[i]
        assert tuple(row[1:6]) == counted
        assert row["base_failed"] == (counted[0] < 50 or 100 * counted[4] > 50 * counted[0])
        assert not (row["base_failed"] and row["kept"])
    quality = dict(table("labels", "doc_id, quality", sf_dir))
    good = [rows[i]["kept"] for i, q in quality.items() if q == 1 and not rows[i]["base_failed"]]
    bad = [rows[i]["kept"] for i, q in quality.items() if q == 0]
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.2


def test_rules_hold_in_spark_as_in_numpy(spark):
    draw = np.random.default_rng(3)
    x = draw.random((3000, len(text_stats.FEATURES)))
    bad = (x[:, 0] > 0.8) | ((x[:, 3] > 0.6) & (x[:, 4] <= 0.3))
    rules = learn(x, bad)
    assert 1 <= len(rules) <= 12
    caught = np.zeros(len(x), bool)
    for rule in rules:
        caught |= quality_rules._holds(x, rule)
    assert bad[caught].mean() > 0.95 and caught[bad].mean() > 0.8
    bottoms = {c: 10_000 for _, _, c in text_stats.RATIOS}
    rows = [{**bottoms, **{top: int(v * bottoms[b]) for (_, top, b), v in zip(text_stats.RATIOS, row)}} for row in x[:200]]
    rows = [{"n_words": 0, **{c: r.get(c, 0) for c in text_stats.COUNTS}} for r in rows]
    shares = np.array([[r[t] / r[b] if r[b] else 0.0 for _, t, b in text_stats.RATIOS] for r in rows])
    schema = "counts struct<" + ", ".join(f"{c}: long" for c in text_stats.COUNTS) + ">"
    frame = spark.createDataFrame([(tuple(r[c] for c in text_stats.COUNTS),) for r in rows], schema)
    expected = np.ones(len(rows), bool)
    for rule in rules:
        expected &= ~quality_rules._holds(shares, rule)
    assert [r[0] for r in frame.select(verdict(rules)).collect()] == expected.tolist()


def test_nothing_to_learn():
    x = np.zeros((10, len(text_stats.FEATURES)))
    assert learn(x, np.zeros(10, bool)) == learn(x, np.ones(10, bool)) == learn(x[:0], np.zeros(0, bool)) == []


def test_odd_rows(spark):
    rules = [(("symbol_share", True, 0.2),)]
    rows = quality_rules.judge(odd_docs(spark), rules).collect()
    assert by_text([(r["doc_id"], *r[1:6]) for r in rows]) == by_text([(i, *slow_counts(t)) for i, t in ODD_TEXTS])
    kept = quality_rules.keep_good(odd_docs(spark), rules)
    assert kept.columns == odd_docs(spark).columns
    assert quality_rules.judge(no_docs(spark), rules).count() == quality_rules.keep_good(no_docs(spark), rules).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 0), (6, 0), (6, 1), (99, 1)], "doc_id long, quality int")
    assert quality_rules.learn_rules(odd_docs(spark), labels) == []
    assert base_failed() is not None


def test_trees_query(spark):
    rows = {r["doc_id"]: r for r in queries.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    quality = dict(table("labels", "doc_id, quality", "/root/testdata/sf0.01"))
    for i, row in rows.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.3)
    good = [rows[i]["score"] for i, q in quality.items() if q == 1 and rows[i]["held_out"]]
    bad = [rows[i]["score"] for i, q in quality.items() if q == 0 and rows[i]["held_out"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_trees_equal_a_walk():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(800, len(text_stats.FEATURES)))
    label = ((x[:, 1] > 0) ^ (x[:, 2] > 0.5)).astype("i8")
    trees = quality_classifier.train(x, label)
    scores = trees.score(x)
    assert ((scores > 0.5) == label).mean() > 0.97
    for row, score in zip(x[:20], scores):
        total = trees.prior
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += value[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_trees_odd_rows(spark):
    labels = spark.createDataFrame([(4, 0), (10, 1), (None, 1), (5, None)], "doc_id long, quality int")
    trees = quality_classifier.learn(odd_docs(spark), labels)
    rows = quality_classifier.score(odd_docs(spark), trees).collect()
    assert by_text([r["doc_id"] for r in rows]) == by_text([i for i, _ in ODD_TEXTS])
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = quality_classifier.learn(no_docs(spark), labels.limit(0))
    assert quality_classifier.score(no_docs(spark), empty).count() == 0
    assert quality_classifier.score(odd_docs(spark), empty).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
