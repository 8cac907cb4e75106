from __future__ import annotations

import json
import time
from datetime import datetime, timedelta, timezone

import fixture_day
import pytest
from pyspark.sql import functions as F

from querytide.operators.report_days import assign_report_days, trailing_window
from querytide.params import ReportParams
from querytide.sources.pages import log_rows, parse_entries, read_pages, rejected_rows


def entry(time, client="10.0.0.1", domain="a.example", reason="NotFilteredNotFound", **more):
    return {
        "time": time, "client": client, "question": {"name": domain, "type": "A", "class": "IN"},
        "reason": reason, "rules": [], "rule": "", **more,
    }


def write_page(folder, name, entries, **more):
    (folder / name).write_text(json.dumps({"data": entries, **more}, indent=2))


def read(spark, folder, **options):
    return parse_entries(read_pages(spark, str(folder), F.lit("home")), **options)


def test_pages_are_joined(spark, tmp_path):
    write_page(tmp_path, "1.json", [entry("2026-05-08T14:00:00Z"), entry("2026-05-08T13:00:00Z")])
    write_page(tmp_path, "2.json", [entry("2026-05-08T12:00:00Z")], oldest="2026-05-08T12:00:00Z")
    write_page(tmp_path, "3.json", [])
    rows = log_rows(read(spark, tmp_path)).orderBy("seq").collect()
    assert [r.time.hour for r in rows] == [14, 13, 12]


def test_arrival_order_over_pages(spark, tmp_path):
    """Equal times in two pages: the page that reaches further back arrived later."""
    same = "2026-05-08T13:00:00Z"
    write_page(tmp_path, "a.json", [entry(same, client="third"), entry("2026-05-08T11:00:00Z", client="last")])
    write_page(tmp_path, "b.json", [entry(same, client="first"), entry(same, client="second")], oldest=same)
    rows = log_rows(read(spark, tmp_path)).orderBy("seq").collect()
    assert [r.client for r in rows] == ["first", "second", "third", "last"]


@pytest.mark.parametrize("layout", ["documents", "lines"])
def test_pages_that_end_at_one_moment(spark, tmp_path, layout):
    """Equal times over twelve numbered pages, of which one has 3,000 entries."""
    same, names = "2026-05-08T13:00:00Z", []
    for number in range(1, 13):
        clients = [f"{number}.{k}" for k in range(3000 if number == 3 else 4)]
        page = {"data": [entry(same, client=c) for c in clients], "oldest": same}
        if layout == "documents":
            (tmp_path / f"page-{number}.json").write_text(json.dumps(page, indent=2))
        else:
            with open(tmp_path / f"part-{(number + 5) // 6}.json", "a") as out:
                out.write(json.dumps(page) + "\n")
        names += clients
    first = "2026-05-08T13:00:01Z"
    begins = {"data": [entry(first, client="newest"), entry(same, client="first")], "oldest": same}
    (tmp_path / "page-99.json").write_text(json.dumps(begins))
    rows = log_rows(parse_entries(read_pages(spark, str(tmp_path), F.lit("home"), layout=layout)))
    rows = rows.orderBy("seq").collect()
    assert [r.client for r in rows] == ["newest", "first", *names]
    assert len({r.seq for r in rows}) == len(rows)


def test_pages_far_from_now(spark, tmp_path):
    """The first and the last years that can be written do not run over; timeless pages stand."""
    times = ["9999-12-31T23:59:59Z", "2026-05-08T13:00:00Z", "0001-01-01T00:00:00Z"]
    for k, time_text in enumerate(times):
        write_page(tmp_path, f"{k}.json", [entry(time_text, client=str(k))])
    write_page(tmp_path, "8.json", [entry("never", client="8")] * 2)
    (tmp_path / "9.json").write_text("no page")
    parsed = read(spark, tmp_path)
    assert [r.client for r in log_rows(parsed).orderBy("seq").collect()] == ["0", "1", "2"]
    assert rejected_rows(parsed).count() == 3


def test_partitioned_folders(spark, tmp_path):
    for network in ("n1", "n2"):
        (tmp_path / f"network_id={network}").mkdir()
        write_page(tmp_path / f"network_id={network}", "p.json", [entry("2026-05-08T14:00:00Z")])
    rows = log_rows(parse_entries(read_pages(spark, str(tmp_path)))).collect()
    assert {r.network_id for r in rows} == {"n1", "n2"}


def test_time_forms(spark, tmp_path):
    forms = [
        "2026-05-08T07:00:00Z", "2026-05-08T07:00:00.000000000Z", "2026-05-08T07:00:00.123456789Z",
        "2026-05-08T09:00:00+02:00", "2026-05-08T00:00:00-07:00",
    ]
    write_page(tmp_path, "p.json", [entry(t) for t in forms])
    times = [r.time for r in log_rows(read(spark, tmp_path)).orderBy("seq").collect()]
    base = datetime(2026, 5, 8, 7)
    assert times == [base, base, base.replace(microsecond=123456), base, base]


def test_defaults_and_blocked_codes(spark, tmp_path):
    reasons = [
        "FilteredBlackList", "FilteredSafeSearch", "FilteredParental", "FilteredCustom",
        "NotFilteredWhiteList", "Rewrite", "",
    ]
    bare = {"time": "2026-05-08T07:00:00Z", "question": {"name": "x.example", "type": "A"}}
    write_page(
        tmp_path, "p.json",
        [entry("2026-05-08T07:00:00Z", reason=r, rule="||r^") for r in reasons] + [bare],
    )
    rows = log_rows(read(spark, tmp_path)).orderBy("seq").collect()
    assert [r.blocked for r in rows] == [True] * 4 + [False] * 4
    assert rows[0].block_rule == "||r^"
    assert (rows[-1].client, rows[-1].reason, rows[-1].block_rule) == ("", "", "")


def test_rejects(spark, tmp_path):
    good = entry("2026-05-08T07:00:00Z")
    write_page(
        tmp_path, "p.json",
        [
            good, entry("yesterday"), {**good, "time": None}, {**good, "question": {"type": "A"}},
            {**good, "question": {"name": "x.example"}}, {**good, "question": None},
        ],
    )
    (tmp_path / "q.json").write_text("this is not a page")
    parsed = read(spark, tmp_path)
    assert log_rows(parsed).count() == 1
    rows = rejected_rows(parsed).collect()
    texts = {r.reject_reason: r.raw_text for r in rows}
    assert texts["unreadable page"] == "this is not a page"
    assert json.loads(texts["bad time"])["time"] == "yesterday"
    assert sorted(r.reject_reason for r in rows) == [
        "bad time", "missing question name", "missing question name", "missing question type",
        "missing time", "unreadable page",
    ]


def test_strict_ends_the_job(spark, tmp_path):
    write_page(tmp_path, "p.json", [entry("2026-05-08T07:00:00Z"), entry("never")])
    with pytest.raises(Exception, match="bad log entry"):
        log_rows(read(spark, tmp_path, strict=True)).collect()


def test_domains_are_kept_as_logged_unless_asked(spark, tmp_path):
    write_page(tmp_path, "p.json", [entry("2026-05-08T07:00:00Z", domain=" WwW.Example. ")])
    assert log_rows(read(spark, tmp_path)).collect()[0].domain == " WwW.Example. "
    assert log_rows(read(spark, tmp_path, normalize=True)).collect()[0].domain == "www.example"


def test_lines_layout(spark, tmp_path):
    lines = [json.dumps({"data": [entry("2026-05-08T07:00:00Z")] * 2}) for _ in range(3)]
    (tmp_path / "pages.json").write_text("\n".join(lines))
    raw = read_pages(spark, str(tmp_path), F.lit("home"), layout="lines")
    assert log_rows(parse_entries(raw)).count() == 6
    with pytest.raises(ValueError):
        read_pages(spark, str(tmp_path), F.lit("home"), layout="words")


def test_trailing_window_bounds(spark):
    log = spark.sql(
        "SELECT explode(array(timestamp_ntz'2026-05-07 14:59:59', timestamp_ntz'2026-05-07 15:00:00',"
        "timestamp_ntz'2026-05-08 15:00:00', timestamp_ntz'2026-05-08 15:00:01')) AS time"
    )
    assert trailing_window(log, datetime(2026, 5, 8, 15), 24).count() == 3


def test_run_time_does_not_depend_on_the_machine(spark, monkeypatch):
    log = spark.sql(
        "SELECT explode(array(timestamp_ntz'2026-05-07 14:59:59', timestamp_ntz'2026-05-07 15:00:00'))"
        " AS time"
    )
    east = timezone(timedelta(hours=9))
    try:
        for zone in ("America/New_York", "Asia/Tokyo"):
            monkeypatch.setenv("TZ", zone)
            time.tzset()
            for now in (datetime(2026, 5, 8, 15), datetime(2026, 5, 9, 0, tzinfo=east)):
                assert trailing_window(log, now, 24).count() == 1
    finally:
        monkeypatch.undo()
        time.tzset()


def test_report_days(spark):
    log = spark.sql(
        "SELECT explode(array(timestamp_ntz'2026-05-07 14:59:59', timestamp_ntz'2026-05-07 15:00:00',"
        "timestamp_ntz'2026-05-08 14:59:59')) AS time"
    )

    def days(**options):
        rows = assign_report_days(log, ReportParams(**options)).collect()
        return sorted((r.time.day, r.time.hour, r.report_date.day) for r in rows)

    assert days() == [(7, 14, 7), (7, 15, 8), (8, 14, 8)]
    assert days(window_hours=48) == [
        (7, 14, 7), (7, 14, 8), (7, 15, 8), (7, 15, 9), (8, 14, 8), (8, 14, 9),
    ]
    assert days(window_hours=36) == [
        (7, 14, 7), (7, 14, 8), (7, 15, 8), (8, 14, 8), (8, 14, 9),
    ]
    assert days(window_hours=6) == [(7, 14, 7), (8, 14, 8)]
    # A run that closes late in the UTC day is already the next date further east.
    assert days(close_hour_utc=20, timezone="Asia/Tokyo") == [(7, 14, 8), (7, 15, 8), (8, 14, 9)]


def test_fixture_pages(spark):
    assert fixture_day.log(spark).count() == fixture_day.TOTAL
