"""Conversation repair against a search through all edits, over odd rows and very long conversations."""

import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest

from civicpulse.llm import conversations
from civicpulse.llm.common import start

SCHEMA = "conv_id long, turn long, role string, text string, case int, copy int, present_ string, name string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """(must go, truncated) per row and the counts of faults."""
    marks, seen, counts = [], set(), [0, 0, 0]
    for _, role, text in rows:
        last = (BLANK.findall(text) or [""])[-1]
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        marks.append((fault in (0, 1), fault == 2))
    return marks, counts


def cheapest(rows, marks):
    """Every script of edits with at most two inserts in a place, by brute force."""
    best = None
    for gaps in product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
        options = []
        for (_, role, _), (must_go, truncated) in zip(rows, marks):
            own = [("D", 2, None)]
            if not must_go:
                own.append(("K", 5 * truncated, role))
                own += [("R", 1 + 5 * truncated, r) for r in ("user", "assistant")]
            options.append(own)
        for script in product(*options):
            out, audit, cost = [], "", 0
            for gap, step, row in zip(gaps, [*script, None], [*rows, None]):
                for x in gap:
                    out.append(("user" if x == "u" else "assistant", ""))
                    audit, cost = audit + "I", cost + 5
                if step:
                    audit, cost = audit + step[0], cost + step[1]
                    if step[2] is not None:
                        out.append((step[2], row[2]))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            if all(role for role, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in out)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def table_by_state(rows, marks):
    """The same by a plain table over what was read last; for long conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def better(states, key, value):
        if key not in states or value < states[key]:
            states[key] = value

    def with_inserts(states):
        for _ in range(2):
            for state, (cost, audit, out) in list(states.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    if (state, x) in step:
                        better(states, step[state, x], (cost + 5, audit + "I", [*out, f"{role}:"]))
        return states

    states = {"": (0, "", [])}
    for (_, role, text), (must_go, truncated) in zip(rows, marks):
        now = {}
        for state, (cost, audit, out) in with_inserts(states).items():
            better(now, state, (cost + 2, audit + "D", out))
            for to, act, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                if not must_go and (state, to[:1]) in step:
                    better(now, step[state, to[:1]], (cost + price + 5 * truncated, audit + act, [*out, f"{to}:{text}"]))
        states = now
    cost, audit, out = min(v for k, v in with_inserts(states).items() if k in ("", "a"))
    return cost, audit, "\n".join(out)


def plain(rows, search):
    """The whole row of a conversation from its (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marks, counts = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, text = search(rows, marks)
    return gaps, *counts, illegal, cost, audit, sha256(text.encode()).hexdigest()


def found(spark, conversations_by_id):
    rows = [(c, *row, 1, 2, "x", "y") for c, own in conversations_by_id.items() for row in own]
    random.Random(3).shuffle(rows)
    return {r.conv_id: tuple(r)[1:] for r in conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    start(spark)


def made(random_, size):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    texts = ["Yes.", "No!", "cut off", " \t", "", "Why?  \n", "Yes."]
    return [(i if random_.random() < 0.8 else random_.choice([None, i + 3, i - 1]), random_.choice(roles), random_.choice(texts) + (str(i) + "." if random_.random() < 0.6 else "")) for i in range(size)]


def test_repair_is_the_cheapest_of_all_edits(spark):
    random_ = random.Random(11)
    by_id = {i: made(random_, i % 4) for i in range(60)}
    by_id = {i: rows for i, rows in by_id.items() if rows}
    assert found(spark, by_id) == {i: plain(rows, cheapest) for i, rows in by_id.items()}


@pytest.mark.parametrize("settle", [3, 512])
def test_long_conversations_as_streams(spark, monkeypatch, settle):
    monkeypatch.setattr(conversations, "SETTLE", settle)
    random_ = random.Random(5)
    cases = {i: made(random_, 60 + 7 * i) for i in range(12)}
    cases[100] = [(i, "user", f"same role {i}.") for i in range(1501)]
    cases[101] = [(i, "system", f"s {i}.") for i in range(40)]
    cases[102] = [(i, "user" if i % 2 else "assistant", f"cut {i}") for i in range(600)]
    for name, rows in cases.items():
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        repair = conversations.Repair()
        for row, (must_go, truncated) in zip(ordered, faults(ordered)[0]):
            repair.feed(row[1], row[2], must_go, truncated)
        cost, audit, text = table_by_state(ordered, faults(ordered)[0])
        assert repair.result() == (cost, audit, sha256(text.encode()).hexdigest()), name
    assert found(spark, cases) == {i: plain(rows, table_by_state) for i, rows in cases.items()}


def test_a_hot_conversation_and_many_small_ones(spark):
    cases = {7: [(i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(9000)]}
    cases |= {i: [(0, "user", "Hi."), (1, "assistant", "Hello.")] for i in range(100, 1300)}
    rows = found(spark, cases)
    assert rows[7][:7] == (0, 0, 0, 0, 0, 0, "K" * 9000)
    assert len(rows) == 1201 and {r[:7] for i, r in rows.items() if i != 7} == {(0, 0, 0, 0, 0, 0, "KK")}


def damaged(rows):
    """Rows after damage by conversation, from (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def test_damage_and_repair_of_odd_rows(spark):
    random_ = random.Random(2)
    rows = [(c, *row) for c in range(150) for row in made(random_, 1 + c % 9)]
    rows += [(None, t, r, x) for t in (None, 0, 1) for r in (None, "user") for x in (None, "Fine.", "a. b! c?")]
    rows += [(500, 1, "user", "Hi.")] * 3 + [(501, 1, "user", "w " * 200_000 + "."), (501, 2, "assistant", "é ")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    table = spark.createDataFrame([(*row, 1, 2, "x", "y") for row in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damage(table)).collect()}
    assert got == {c: plain(own, table_by_state) for c, own in damaged(rows).items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damage(empty)).collect() == []
