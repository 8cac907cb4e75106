"""Tables that several runs replace in part."""

from __future__ import annotations

import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from querytide.sources import day_tables
from querytide.sources.day_tables import clean_days, current_slots, read_days, replace_days, stage_days

SCHEMA = "network_id STRING, value STRING, report_date DATE"
FIRST = date(2026, 2, 1)


def rows_of(spark, rows):
    return spark.createDataFrame([(n, v, FIRST + timedelta(days=d)) for n, v, d in rows], SCHEMA)


def held(spark, path, **dates):
    found = read_days(spark, path, SCHEMA, **dates).collect()
    return sorted((r.network_id, r.value, (r.report_date - FIRST).days) for r in found)


def test_runs_from_the_same_state_both_survive(spark, workdir):
    """All networks share folders, so each run writes the other one's rows anew."""
    old = [(f"n{k}", "old", d) for k in range(40) for d in range(2)]
    replace_days(rows_of(spark, old), workdir, SCHEMA)
    even = [(f"n{k}", "even", 0) for k in range(0, 40, 2)]
    odd = [(f"n{k}", "odd", d) for k in range(1, 40, 2) for d in range(2)]
    one, other = (stage_days(rows_of(spark, r), workdir, SCHEMA) for r in (even, odd))
    stage_days(rows_of(spark, [("n0", "never", 0)]), workdir, SCHEMA)
    other.publish()
    one.publish()
    kept = [(f"n{k}", "old", 1) for k in range(0, 40, 2)]
    assert held(spark, workdir) == sorted(even + odd + kept)
    assert current_slots(spark, workdir)[0] == 3


def test_a_run_on_other_dates_is_not_merged_again(spark, workdir, monkeypatch):
    one = stage_days(rows_of(spark, [("a", "x", 0)]), workdir, SCHEMA)
    other = stage_days(rows_of(spark, [("a", "y", 1)]), workdir, SCHEMA)
    other.publish()
    monkeypatch.setattr(day_tables.DayChange, "_stage", lambda self: pytest.fail("merged again"))
    one.publish()
    assert held(spark, workdir) == [("a", "x", 0), ("a", "y", 1)]


def test_a_run_that_fails_changes_nothing(spark, workdir, monkeypatch):
    replace_days(rows_of(spark, [("a", "x", 0), ("b", "x", 0)]), workdir, SCHEMA)
    broken = rows_of(spark, [("a", "y", 0)]).withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        replace_days(broken, workdir, SCHEMA)

    def fail(*_):
        raise OSError("no space")

    monkeypatch.setattr(day_tables, "publish_file", fail)
    with pytest.raises(OSError):
        replace_days(rows_of(spark, [("a", "y", 0)]), workdir, SCHEMA)
    assert held(spark, workdir) == [("a", "x", 0), ("b", "x", 0)]


def test_a_report_without_rows_has_none_any_more(spark, workdir):
    replace_days(rows_of(spark, [("a", "x", 0), ("b", "x", 0), ("a", "x", 1)]), workdir, SCHEMA)
    none = rows_of(spark, [("a", "", 0), ("a", "", 1)])
    replace_days(none.limit(0), workdir, SCHEMA, none)
    assert held(spark, workdir) == [("b", "x", 0)]
    replace_days(none.limit(0), workdir, SCHEMA)
    assert held(spark, workdir) == [("b", "x", 0)]


def test_dates_are_read_alone(spark, workdir):
    replace_days(rows_of(spark, [("a", str(d), d) for d in range(5)]), workdir, SCHEMA)
    some = read_days(spark, workdir, SCHEMA, since=FIRST + timedelta(days=1), before=FIRST + timedelta(days=3))
    assert sorted(r.value for r in some.collect()) == ["1", "2"]
    assert len(some.inputFiles()) == 2
    assert read_days(spark, workdir, SCHEMA, before=FIRST).count() == 0


def test_cleaning_keeps_the_newest_states(spark, workdir):
    for value in "uvwxyz":
        replace_days(rows_of(spark, [("a", value, 0), ("b", value, 1)]), workdir, SCHEMA)
    stage_days(rows_of(spark, [("a", "never", 0)]), workdir, SCHEMA)
    clean_days(spark, workdir, keep=2)
    assert len(list(Path(workdir).glob("commit=*"))) == 2
    assert held(spark, workdir) == [("a", "z", 0), ("b", "z", 1)]
    replace_days(rows_of(spark, [("b", "new", 1)]), workdir, SCHEMA)
    assert held(spark, workdir) == [("a", "z", 0), ("b", "new", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_publishing(spark, workdir, seed):
    """Reports hold what the last run to publish them wrote, whatever state the runs began with."""
    draw = random.Random(seed)
    wanted, staged = {}, []
    for number in range(6):
        reports = {(f"n{draw.randint(0, 5)}", draw.randint(0, 1)) for _ in range(3)}
        rows = [(n, f"run{number}", d) for n, d in reports]
        staged.append((rows, stage_days(rows_of(spark, rows), workdir, SCHEMA)))
        draw.shuffle(staged)
        if draw.random() < 0.5 or number == 5:
            for done, change in staged:
                change.publish()
                wanted.update({(n, d): v for n, v, d in done})
            staged = []
    assert held(spark, workdir) == sorted((n, v, d) for (n, d), v in wanted.items())


def test_days_that_hold_nothing_are_not_copied(spark, workdir, monkeypatch):
    """New rows are written once more only to join those of other reports in their folders."""
    schema = "network_id STRING, report_date DATE, n INT"
    written = []
    write = day_tables.write_and_read
    monkeypatch.setattr(day_tables, "write_and_read", lambda df, label: written.append(label) or write(df, label))
    rows = [("a", date(2026, 1, 1), 1), ("b", date(2026, 1, 2), 2)]
    day_tables.replace_days(spark.createDataFrame(rows, schema), f"{workdir}/t", schema)
    assert "kept-days" not in written
    day_tables.replace_days(spark.createDataFrame([("a", date(2026, 1, 1), 3)], schema), f"{workdir}/t", schema)
    assert "kept-days" in written
    found = day_tables.read_days(spark, f"{workdir}/t", schema).select("network_id", "report_date", "n")
    assert sorted(map(tuple, found.collect())) == [("a", date(2026, 1, 1), 3), rows[1]]
