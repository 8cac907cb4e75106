from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from cases import SF_DIR, table
from querytide.llm import conversations, queries
from querytide.llm.conversations import NEVER, STATES, Lattice, RepairParams

BLANKS = " \t\n\v\f\r"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def digest(text):
    return hashlib.sha256(text.encode()).digest()[:16]


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def cheapest(rows):
    """The least (cost, edits) by trying every edit at every row, with the roles it leads to."""
    best = {"": (0, "", ())}

    def offer(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def with_inserts(states):
        for _ in range(4):
            for state, (cost, audit, out) in list(states.items()):
                role = "assistant" if state == "u" else "user"
                offer(states, role[0], (cost + 5, audit + "I", (*out, (role, ""))))
        return states

    seen = set()
    for _, _, role, text in rows:
        states = with_inserts(best)
        best = {}
        stripped = text.strip(BLANKS)
        must = not stripped or (role, text) in seen
        seen.add((role, text))
        for state, (cost, audit, out) in states.items():
            offer(best, state, (cost + 2, audit + "D", out))
            if must:
                continue
            extra = 0 if stripped[-1] in ".!?" else 5
            for to, edit, more in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                after = AFTER.get((state, to[:1]))
                if after:
                    offer(best, after, (cost + more + extra, audit + edit, (*out, (to, text))))
    ends = with_inserts(best)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda e: e[:2])


def expected(original, damaged):
    groups = defaultdict(list)
    for row in damaged:
        groups[row[0]].append(row)
    for conv in {row[0] for row in original}:
        rows = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[3])))
        turns = [r[1] for r in rows if r[1] is not None]
        blank = duplicate = truncated = 0
        seen = set()
        for _, _, role, text in rows:
            if not text.strip(BLANKS):
                blank += 1
            elif (role, text) in seen:
                duplicate += 1
            elif text.rstrip(BLANKS)[-1] not in ".!?":
                truncated += 1
            seen.add((role, text))
        pairs = [(a[2][:1], b[2][:1]) for a, b in zip(rows, rows[1:])]
        illegal = sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in pairs)
        cost, audit, out = cheapest(rows)
        text = "\n".join(f"{role}:{text}" for role, text in out)
        yield (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, illegal,
            cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, place int, letters string, number int"


def by_text(rows):
    return sorted(rows, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA)


def odd_conversations():
    draw = random.Random(11)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "System", None])
            text = draw.choice(["Yes.", "No", "Why?", " ", "", None, "Well.\n", "yes. \t", " ", "x" * 5000, f"{turn}!"])
            rows.append((conv, draw.choice([turn, turn, turn // 2, None]), role, text))
            if draw.random() < 0.1:
                rows.extend([rows[-1]] * draw.randint(1, 4))
    return rows


def test_query_equals_brute_force(spark):
    found = queries.op11_conversation_repair(spark, SF_DIR).select(*COLUMNS).collect()
    rows = table("conversations", "conv_id, turn, role, text")
    assert by_text(map(tuple, found)) == by_text(expected(rows, damage(rows)))
    assert len({r["cost"] for r in found}) > 3


@pytest.mark.parametrize("params", [RepairParams(), RepairParams(segment=2, matrices=2), RepairParams(segment=3, matrices=4)])
def test_odd_rows_and_cuts(spark, params):
    rows = odd_conversations()
    given = frame(spark, rows)
    found = conversations.repair_digests(given, given, params).select(*COLUMNS).collect()
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert by_text(map(tuple, found)) == by_text(expected(rows, clean))


def test_damage_equals_brute_force(spark):
    rows = odd_conversations()
    found = queries._damaged(frame(spark, rows)).collect()
    assert by_text(map(tuple, found)) == by_text(damage(rows))


def test_long_conversation_over_many_segments(spark):
    draw = random.Random(12)
    rows = [(1, t, draw.choice(["user", "assistant", "system"]), draw.choice([f"{t}.", f"{t}", "same.", ""])) for t in range(700)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", "same." if t > 5 else f"{t}.") for t in range(300)]
    given = frame(spark, rows)
    found = conversations.repair_digests(given, given, RepairParams(segment=16, matrices=3)).select(*COLUMNS).collect()
    assert by_text(map(tuple, found)) == by_text(expected(rows, rows))


def test_no_rows(spark):
    none = frame(spark, [])
    assert conversations.repair_digests(none, none).count() == 0
    (row,) = conversations.repair_digests(none, frame(spark, [(5, 0, "user", "x")])).collect()
    assert (row["conv_id"], row["audit"], row["cost"], row["gaps"]) == (5, "", 0, 0)


def test_prices_are_least_costs_and_all_tight_paths_are_cheapest():
    draw = random.Random(13)
    for _ in range(200):
        rows = "".join(draw.choice("dsuaxSUAX") for _ in range(draw.randint(0, 6)))
        lattice = Lattice(rows, RepairParams())
        ends = tuple(draw.choice([0, 3, 7, NEVER]) for _ in range(STATES))
        least = [[ends[s] if p == len(rows) else NEVER for s in range(STATES)] for p in range(len(rows) + 1)]
        for _ in range(len(rows) * 3 + 4):
            for p in range(len(rows) + 1):
                for s in range(STATES):
                    for _, to, state, cost in lattice.arcs(p, s):
                        least[p][s] = min(least[p][s], cost + least[to][state])
        assert lattice.prices(ends) == least
