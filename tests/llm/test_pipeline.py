from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
import corpus_pipeline
from cases import SF_DIR, no_docs, odd_docs
from pyspark.sql import functions as F
from querytide.llm import quality_rules
from querytide.llm.common import read_table
from querytide.session import write_and_read
from test_dedup import normal, slow_components, slow_print
from test_scans import base

ROOT = Path(__file__).resolve().parents[2]


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF_DIR, "documents")
    rules = quality_rules.learn_rules(docs, read_table(spark, SF_DIR, "labels"))
    kept = {r["doc_id"] for r in quality_rules.judge(docs, rules).filter("kept").collect()}
    expected = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def after(name):
        nonlocal docs
        docs = write_and_read(stages[name](spark, docs, SF_DIR), "stage")
        return sorted((r["doc_id"], r["text"]) for r in docs.collect())

    assert after("quality rules") == expected
    first = {}
    for i, text in expected:
        first.setdefault(normal(text), (i, text))
    expected = sorted(first.values())
    assert after("exact dedup") == expected
    roots = slow_components([slow_print(t) for _, t in expected], 2)
    smallest = {}
    for root, row in zip(roots, expected):
        smallest[root] = min(smallest.get(root, row), row)
    expected = sorted(smallest.values())
    assert after("SimHash near-dedup") == expected
    cleaned = after("secret scans")
    assert docs.columns == columns
    for (i, text), (j, clean) in zip(expected, cleaned):
        assert i == j
        assert (clean == text) == (not base(text))
        assert not base(clean)
    packed = stages["best-fit packing"](spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in cleaned}


def test_run_is_registered(spark):
    rows = contract.queries()["pipeline"](spark, SF_DIR)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            if name != "best-fit packing":
                assert out.columns == docs.columns, name
            out.agg(F.count("*")).collect()


def test_all_operators_are_registered():
    numbers = [int(m[1]) for q in contract.queries() if (m := re.match(r"op(\d+)_", q))]
    assert sorted(numbers) == list(range(1, 14))
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_nothing_else_imports_the_operators():
    said = subprocess.run(
        [sys.executable, "-c", "import querytide.plans.catalog, querytide.__main__, sys; print([m for m in sys.modules if 'llm' in m])"],
        cwd=ROOT, capture_output=True, text=True, check=True,
    )
    assert said.stdout.strip() == "[]"
