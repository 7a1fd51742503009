"""Repair of conversations against all cheapest edits, found place by place in plain Python."""

import hashlib
import random
import re
import time
import zlib
from itertools import groupby

import pytest

from gritline.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(initials, faults):
    """Least (cost, audit): for each last initial, the best way to get there."""

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for last, (cost, audit) in list(ways.items()):
                step = cost + 3, audit + "I"
                ways[NEXT[last]] = min(ways.get(NEXT[last], step), step)
        return ways

    ways = {"": (0, "")}
    for initial, fault in zip(initials, faults):
        steps = []
        for last, (cost, audit) in inserted(ways).items():
            steps.append((last, (cost + 4, audit + "D")))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if initial == NEXT[last] or (initial == "s" and last == ""):
                    steps.append((initial, (cost + more, audit + "K")))
                steps.append((NEXT[last], (cost + 3 + more, audit + "R")))
        ways = {last: min(w for k, w in steps if k == last) for last, _ in steps}
    return min(w for last, w in inserted(ways).items() if last in ("", "a"))


def plain(rows):
    """One tuple for each conversation, as the query gives it."""
    out = []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for conv, group in groupby(rows, key=lambda r: r[0]):
        made = []
        for _, turn, role, text in group:
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            pick = zlib.crc32(name.encode()) % 20
            text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
            made += [(turn, "user" if pick == 4 else role, text)] * (0 if pick == 0 else 2 if pick == 3 else 1)
        made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in made:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(
                "blank" if not visible else "duplicate" if (role, text) in seen
                else "truncated" if visible[-1] not in ".!?" else ""
            )
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in made]
        cost, audit = cheapest(initials, faults)
        lines, last, rest = [], "", iter(made)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rest)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = {"u": "user", "a": "assistant"}[NEXT[last]]
            last = role[:1]
            lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in made if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def answer(df):
    damaged = C.damage(df)
    return sorted((tuple(r) for r in C.digests(damaged, C.audits(damaged)).collect()), key=repr)


def made(seed, convs=150):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "no end", "", "  \n", "é 漢?", "\x0b\x0c.", "Why?\t ", None, ":", "a\nb.", "\xa0"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "us"]
    rows = []
    for conv in range(convs):
        for turn in range(pick.randint(1, 12)):
            turn = None if pick.random() < 0.05 else turn * pick.choice([1, 1, 1, 2])
            rows.append((conv, turn, pick.choice(roles), pick.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rows = made(seed) + [(None, 1, "user", "Hi."), (None, None, None, None), (None, 1, "user", "Hi.")]
    rows += [(1000 + k, 0, "user", "Only.") for k in range(60)]  # some of them lose their only row
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS kind", "'x' AS plan", "2 AS copy", "true AS gone", "3 AS digest")
    assert answer(df) == plain(rows)


def test_conversations_without_rows(spark):
    got = [r for r in answer(spark.createDataFrame([(k, 0, "user", "Only.") for k in range(60)], SCHEMA)) if not r[7]]
    assert got and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert answer(none) == []
    assert C.repaired(none, C.audits(none)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "tool", "x"), (1, 4, "user", "Bye.")]
    df = spark.createDataFrame(rows, SCHEMA)
    plans = C.audits(df)
    assert [tuple(r) for r in plans.collect()] == [(1, 0, 0, 1, 1, 4, 14, "KIKDDKI")]
    got = [(r["place"], r["edit"], r["role"], r["text"]) for r in C.repaired(df, plans).orderBy("place").collect()]
    assert got == [(0, "K", "system", "Be kind."), (1, "I", "user", ""), (2, "K", "assistant", "Hello."), (3, "K", "user", "Bye."), (4, "I", "assistant", "")]


def test_plans_are_the_cheapest():
    pick, names = random.Random(3), ["", "truncated", "blank", "duplicate"]
    for _ in range(3000):
        n = pick.randint(0, 12)
        initials = [pick.choice("uuuaaas t") for _ in range(n)]
        faults = [pick.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert C.plan(initials, faults) == cheapest(initials, [names[f] for f in faults])


def test_bounds_rise_where_the_estimate_is_too_low():
    """Only system rows: the estimate lets them end there."""
    assert C.estimates(["s"], [0])[0][C.START] == 0
    assert C.plan(["s"], [0]) == cheapest(["s"], [""]) == (4, "D")


@pytest.mark.parametrize("letters", ["uuaas", "s", "u", "t"])
def test_very_long_conversations_end(letters):
    pick = random.Random(5)
    initials = [pick.choice(letters) for _ in range(50_000)]
    faults = [pick.choice([0, 0, 0, 1, 2, 3]) for _ in range(50_000)]
    started = time.perf_counter()
    cost, audit = C.plan(initials, faults)
    assert time.perf_counter() - started < 30
    kept = zip([e for e in audit if e != "I"], faults)
    assert cost == 3 * audit.count("I") + sum({"D": 4, "K": 0, "R": 3}[e] + 3 * (f == 1 and e != "D") for e, f in kept)
