from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from cases import SF_DIR
from querytide.llm import queries, url_filter
from querytide.llm.url_filter import ModelParams, Models, Rule

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lowered, re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def slow_scores(training, urls, params):
    """The models by dictionaries, contexts and characters in the slots of the operator."""
    contexts = defaultdict(int)
    joints = defaultdict(int)

    def walk(url):
        data = np.frombuffer(url, "u1")
        return list(url_filter._slots(data, np.zeros(len(data), "i8"), params.order, params.slots))

    for url, kind in training:
        for length, (own, joint) in enumerate(walk(url)):
            for a, b in zip(own, joint):
                contexts[kind, length, a] += 1
                joints[kind, length, b] += 1
    for url in urls:
        total = 0.0
        levels = walk(url)
        for k in range(len(url)):
            p = [1 / 256, 1 / 256]
            for length, (own, joint) in enumerate(levels):
                for kind in (0, 1):
                    n = contexts[kind, length, own[k]]
                    p[kind] = (min(joints[kind, length, joint[k]], n) + params.lean * p[kind]) / (n + params.lean)
            total += np.log(p[1]) - np.log(p[0])
        yield total / max(1, len(url))


def test_query_follows_rules_and_models(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op3_url_filters(spark, SF_DIR).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for row in rows:
        assert (row["host"], row["path"]) == parts(pages[row["page_id"]])
        name, verdict = rule_of(row["host"], row["path"])
        assert row["rule"] == name
        assert row["verdict"] == (verdict or row["verdict"]) and row["verdict"] in ("allow", "block")
        assert (row["score"] is None) == (name is not None)


def test_models_equal_brute_force(spark):
    params = ModelParams(order=3, slots=512)
    training = [(b"a.org/en/1", 1), (b"b.org/en/22", 1), (b"a.com/de/x", 0), (b"c.com/de/yy", 0), (b"c.com/de/yy", 0)]
    rows = spark.createDataFrame([(u.decode(), bool(k)) for u, k in training], "url string, allowed boolean")
    models = Models(*url_filter._counted(rows, params), params)
    urls = [b"b.org/en/5", b"", b"z.net/de/yy", b"q"]
    assert np.allclose(models.score(urls), list(slow_scores(training, urls, params)))
    assert models.score(urls)[0] > 0 > models.score(urls)[2] and models.score(urls)[1] == 0


def test_unseen_urls_follow_the_likelier_class(spark):
    rows = [(n, f"https://h{n % 7}.{'org/en/' if n % 2 else 'com/de/'}{n}") for n in range(400)]
    rows += [(1000, "https://x.net/en/5"), (1001, "https://x.net/de/5")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = url_filter.judge(pages, [Rule("org", "/", True), Rule("com", "/de/", False)])
    verdicts = {r["page_id"]: r["verdict"] for r in found.filter("page_id >= 1000").collect()}
    assert verdicts == {1000: "allow", 1001: "block"}


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "HTTP://EXAMPLE.ORG", "x://A.ORG/es/?q#f", "a://b.org//x", "://", "x://ÄB.org/ü", "u://e.com/fr/" + "y" * 50_000, "u://h?://z.org/"]
    rows = [(k if k else None, u, "html", 1.0, "r") for k, u in enumerate([*urls, urls[4]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score double, rule string")
    rules = [Rule(h, p, v == "allow") for h, p, v in RULES]
    found = sorted(((r["host"], r["path"], r["rule"]) for r in url_filter.judge(pages, rules).collect()), key=repr)
    expected = [(*parts(u), rule_of(*parts(u))[0]) for u in [*urls, urls[4]]]
    assert found == sorted(expected, key=repr)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}
