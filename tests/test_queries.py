"""Every registered query against its SQL on the smallest test tables."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
import pytest
from compare import connect, spark_rows, sql_rows
from querytide.plans.catalog import QUERIES
from querytide.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_oracles_belong_to_queries():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_columns, expected = sql_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("without", [["querytide/llm"], ["querytide/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_text_operators(tmp_path, without):
    """A copy without the text operators still has every report query."""
    top = Path(contract.__file__).resolve().parent
    shutil.copytree(top / "querytide", tmp_path / "querytide")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(top / name, tmp_path / name)
    for name in without:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink()
    say = "import __spark_entry__ as e; print(*e.queries())"
    run = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True, check=True)
    names = set(run.stdout.split())
    assert set(QUERIES) <= names
    assert any(n.startswith("op") for n in names) == ("querytide/llm" not in without)
    assert "pipeline" not in names
