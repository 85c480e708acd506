"""Conversation repair against a plain forward search over all edit strings."""

import hashlib
import random

from cliploom.llm import repair

SCHEMA = "turn long, text string, copy string, role string, conv_id long, present string"


def nothing(ws):
    return ws.strip("\x20\t\n\x0b\x0c\r") == ""


def plain(rows):
    """Report of rows (turn, role, text) that are in order: best (cost, audit, lines) of each state, row by row."""
    step = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}

    def insert(best):
        for _ in range(3):
            for role, letter in (("user", "u"), ("assistant", "a")):
                for q, to in step[letter].items():
                    if q in best:
                        c, a, lines = best[q]
                        new = (c + 5, a + "I", (*lines, role + ":"))
                        best[to] = min(best.get(to, new), new)
        return best

    best, seen, faults, illegal, previous = {0: (0, "", ())}, set(), [], 0, None
    for _, role, text in rows:
        last = text.strip("\x20\t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if previous is not None:
            illegal += previous + role[:1] not in ("su", "ua", "au")
        previous = role[:1]
        new = {}
        for q, (c, a, lines) in insert(best).items():
            options = [(q, (c + 2, a + "D", lines))]
            if fault not in ("blank", "duplicate"):
                stays = 5 * (fault == "truncated")
                if q in step.get(role[:1], {}):
                    options.append((step[role[:1]][q], (c + stays, a + "K", (*lines, f"{role}:{text}"))))
                for name in ("user", "assistant"):
                    if q in step[name[0]]:
                        options.append((step[name[0]][q], (c + stays + 1, a + "R", (*lines, f"{name}:{text}"))))
            for to, value in options:
                new[to] = min(new.get(to, value), value)
        best = new
    cost, audit, lines = min(v for q, v in insert(best).items() if q in (0, 3))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(n=60, seed=3):
    make = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(make.choice([1, 2, 3, 5, 9, 30])):
            turn = make.choice([None, *range(12)])
            role = make.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "ünder"])
            text = make.choice(["", " \n\t", "Yes.", "no", "Ünd \U0001f600!", "a b c. ", "Why?\x0b", " x", f"t{make.random()}", "nbsp\xa0"])
            rows.append((turn, text, "c", role, conv, "z"))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))


def reports(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_repairs_equal_a_plain_search(spark):
    rows = made()
    filled = repair.filled(spark.createDataFrame(rows, SCHEMA))
    want = {}
    for conv in {r[4] for r in rows}:
        want[conv] = plain(in_order([(t, role, x) for t, x, _, role, c, _ in rows if c == conv]))
    assert reports(repair.report(repair.edited(filled))) == want
    cut = repair.edited(filled, large_bytes=600, block_bytes=500)
    assert reports(repair.report(cut)) == want
    assert reports(repair.report(repair.edited(filled, large_bytes=0, block_bytes=2000))) == want
    turns = {}
    for r in sorted(repair.repaired(cut).collect(), key=lambda r: (str(r.conv_id), r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, w in want.items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == w[-1]


def test_one_conversation_over_many_blocks(spark):
    make = random.Random(5)
    rows = [(t, make.choice(["Yes.", "no", "", f"Line {t}."]), "", make.choice(["user", "assistant", "system", "user"]), 4, "") for t in range(3000)]
    filled = repair.filled(spark.createDataFrame(rows, SCHEMA))
    small, large = (reports(repair.report(repair.edited(filled, n, 20_000))) for n in (1 << 30, 0))
    assert small == large == {4: plain([(t, role, x) for t, x, _, role, _, _ in rows])}


def test_many_copies_of_one_row(spark):
    rows = [(1, "Hello there.", "", "user", 9, "")] * 500 + [(2, "Yes.", "", "assistant", 9, "")]
    filled = repair.filled(spark.createDataFrame(rows, SCHEMA))
    want = {9: plain([(t, role, x) for t, x, _, role, _, _ in rows])}
    assert reports(repair.report(repair.edited(filled, 0, 2000))) == want == reports(repair.report(repair.edited(filled)))


def test_nulls_absent_rows_and_empty_tables(spark):
    rows = [(None, None, None, None, 1, None), (0, None, None, "user", None, None), (3, "Long. " * 200_000, None, "user", 2, None)]
    filled = repair.filled(spark.createDataFrame(rows, SCHEMA))
    empty = hashlib.sha256(b"").hexdigest()
    want = {1: (0, 1, 0, 0, 0, 2, "D", empty), None: (0, 1, 0, 0, 0, 2, "D", empty), 2: plain([(3, "user", rows[2][1])])}
    assert reports(repair.report(repair.edited(filled))) == want
    assert reports(repair.report(repair.edited(filled, 100_000))) == want
    assert repair.report(repair.edited(filled.limit(0))).count() == 0
    absent = filled.withColumn("present", filled.conv_id.isNull())
    zeros = (0, 0, 0, 0, 0, 0, "", empty)
    for limit in (0, 1 << 30):
        assert reports(repair.report(repair.edited(absent, limit))) == {1: zeros, 2: zeros, None: want[None]}
