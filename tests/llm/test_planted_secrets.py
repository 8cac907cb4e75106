"""Credentials planted in documents: how many are found, and what is left alone."""

from __future__ import annotations

import random
import string

from cases import table
from querytide.llm import secret_scan

LETTERS = string.ascii_letters + string.digits


def word(draw, low, high, letters=LETTERS):
    return "".join(draw.choice(letters) for _ in range(draw.randint(low, high)))


def random_key(draw, length=40):
    return "aB3" + word(draw, length, length, LETTERS + "+/")


FORMS = {
    "cloud keys": lambda d: f"aws_access_key_id = AKIA{word(d, 16, 16, string.ascii_uppercase + string.digits)}\naws_key = {random_key(d)}",
    "client": lambda d: f"client_id: {word(d, 6, 12)}\nclient value {random_key(d, 28)}",
    "account": lambda d: f'"account_id": "{word(d, 8, 12)}", "host": "https://api.{word(d, 4, 8, string.ascii_lowercase)}.example.com/v1", "value": "{random_key(d, 24)}"',
    "connection": lambda d: f"DATABASE_URL=postgres://{word(d, 4, 9, string.ascii_lowercase)}:{word(d, 5, 12)}@db.{word(d, 3, 9, string.ascii_lowercase)}.com:5432/x",
    "mail": lambda d: f"smtp://{word(d, 4, 9, string.ascii_lowercase)}:{word(d, 5, 12, LETTERS + '!$*')}@mail.example.org",
    "section": lambda d: f"[prod]\nuser_name={word(d, 5, 9)}\nretries=3\nnote=x\nvalue={random_key(d, 30)}",
}


def spans(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(frame).collect()}


def test_connection_strings_are_their_own_complement(spark):
    text = "DATABASE_URL=postgres://admin:hunter2@db.example.com:5432/x and mailto:a@b.example"
    parts = [(k, text[a:b]) for k, a, b in secret_scan.weak_spans(text, [])]
    assert ("identifier", "admin") in parts and ("secret", "hunter2") in parts
    found = spans(spark, [text, "see https://example.com:8080/path@x", "no://user@host:22 here", "://:@", "a://b!:c$@d"])
    assert [(k, text[a:b]) for k, a, b in found[0]] == [("endpoint", "postgres://admin:hunter2@db.example.com:5432/x")]
    assert found[1] == found[2] == found[3] == []
    assert found[4] == [("endpoint", 0, 11)]


def test_planted_credentials_are_found(spark):
    """At least nine in ten of every form, and nothing more in the same texts without them."""
    draw = random.Random(17)
    prose = [t for (t,) in table("documents", "text", "/root/testdata/sf0.01") if t and len(t) < 4000][:300]
    clean = spans(spark, prose)
    names = list(FORMS)
    planted, where = [], []
    for k, text in enumerate(prose):
        secret = FORMS[names[k % len(names)]](draw)
        at = text.find(" ", draw.randint(0, len(text))) + 1
        planted.append(text[:at] + "\n" + secret + "\n" + text[at:])
        where.append((at + 1, at + 1 + len(secret)))
    found = spans(spark, planted)
    caught = dict.fromkeys(names, 0)
    for k, (low, high) in enumerate(where):
        caught[names[k % len(names)]] += any(a < high and b > low for _, a, b in found[k])
    assert min(caught.values()) >= 0.9 * len(prose) / len(names), caught
    linked = [k for k, own in clean.items() if any(kind in ("identifier", "secret", "endpoint") for kind, _, _ in own)]
    assert len(linked) <= 0.01 * len(prose)
