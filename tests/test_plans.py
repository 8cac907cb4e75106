"""Properties of the plans that matter at scale."""

from __future__ import annotations

import re

import pytest

from querytide.plans.catalog import QUERIES
from querytide.session import scratch_path, shared_dir

SF_DIR = "/root/testdata/sf0.001"
BATCH = [
    "summary", "top_domains", "blocked_domains", "per_client", "client_top_domains",
    "off_hours_domains", "novel_domains", "new_domains", "new_domains_earliest", "volume_baseline",
    "volume_anomalies", "counter_delta", "packet_sections", "bulk_new_domains",
]


def physical_plan(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan =="):]


def _sorting(plan):
    return [line for line in plan.splitlines() if "SortAggregate" in line]


@pytest.fixture(scope="module")
def plans(spark):
    return {name: physical_plan(QUERIES[name](spark, SF_DIR)) for name in BATCH}


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_single_partition(plans, name):
    assert "CartesianProduct" not in plans[name]
    assert "BroadcastNestedLoopJoin" not in plans[name]
    assert "Exchange SinglePartition" not in plans[name]
    assert "Python" not in plans[name] and "Pandas" not in plans[name]


@pytest.mark.parametrize("name", ["top_domains", "blocked_domains", "client_top_domains", "off_hours_domains"])
def test_top_lists_are_trimmed_before_the_shuffle(plans, name):
    assert re.search(r"WindowGroupLimit .* Partial", plans[name])


@pytest.mark.parametrize("name", ["top_domains", "per_client", "off_hours_domains", "novel_domains", "volume_baseline", "volume_anomalies"])
def test_log_rows_go_through_hash_aggregates(plans, name):
    assert "partial_" in plans[name] or name == "novel_domains"
    assert not _sorting(plans[name])


def test_no_row_is_multiplied(plans):
    for name in ("summary", "packet_sections"):
        assert "Expand" not in plans[name]


def test_first_client_hashes_log_rows_before_it_sorts(plans):
    lines = plans["new_domains"].splitlines()
    deepest = lines.index(_sorting(plans["new_domains"])[-1])
    assert any("HashAggregate" in line for line in lines[deepest + 1:])


def test_scans_read_only_what_is_needed(plans):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plans["volume_baseline"]).group(1)
    assert schema == "ts:timestamp_ntz,user_id:bigint"


def test_time_filter_reaches_the_scan(spark):
    plan = physical_plan(QUERIES["trailing_window"](spark, SF_DIR))
    assert "GreaterThanOrEqual(ts" in plan


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
