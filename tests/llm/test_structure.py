"""Structure repair against a search over every cheap edit script, and long conversations in short runs."""

import hashlib
import random
import re
import zlib

import pytest

from stripweave.llm.structure import damage, edits, repair_report, summarize
from tests.llm.nasty import CLASH

LAWFUL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"`{c}` string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA)


def faults(rows):
    """Ordered rows (turn, role, text) with their first faults."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    out, seen = [], set()
    for t, r, x in rows:
        bare = x.strip(" \t\n\x0b\x0c\r")
        out.append((t, r, x, "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((r, x))
    return out


def cheapest(rows):
    """Least (cost, audit, lines) over all edit scripts, by cost, without any dynamic programme over grammar states."""
    import heapq

    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and LAWFUL.match(roles):
            return cost, audit, "\n".join(lines)
        if not any(LAWFUL.match(roles + tail) for tail in ("", "ua", "a")):
            continue
        steps = [("I", 2, at, w[0], f"{w}:") for w in ("user", "assistant")]
        if at < len(rows):
            _, role, text, fault = rows[at]
            steps.append(("D", 3, at + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = int(fault is not None)
                steps += [("R", 2 + more, at + 1, w[0], f"{w}:{text}") for w in ("user", "assistant")]
                steps.append(("K", more, at + 1, role[:1] or "?", f"{role}:{text}"))
        for letter, own, to, initial, line in steps:
            heapq.heappush(heap, (cost + own, audit + letter, to, roles + initial, lines if line is None else (*lines, line)))


def brute(conv, rows):
    own = faults(rows)
    cost, audit, text = cheapest(own)
    turns = [t for t, *_ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [sum(f == k for *_, f in own) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    return (conv, gaps, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations(seed, count, most):
    rng = random.Random(seed)
    for conv in range(count):
        for turn in range(rng.randint(1, most)):
            yield (conv, rng.choice([turn, turn, turn, turn + 3, 0, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]),
                   rng.choice(["a.", "b?", "c", "d!  \n", "", " \t", None, f"own {turn}.", f"own {turn}", "é…"]))


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_cheapest_edits(spark, bits):
    rows = list(conversations(3, 120, 5)) + [(None, 1, "user", "no id."), (None, 2, "user", "no id.")]
    got = {tuple(r) for r in summarize(edits(table(spark, rows), bits)).collect()}
    by: dict = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(row)
    assert got == {brute(conv, own) for conv, own in by.items()}


def test_runs_of_any_length_agree(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["x.", f"{t}.", f"{t}"])) for c in range(3) for t in range(300)]
    rows += [(7, None, "user", "same.")] * 500 + [(7, 1, "assistant", "z" * 100_000 + ".")]
    own = [sorted(tuple(r) for r in summarize(edits(table(spark, rows), bits)).collect()) for bits in (2, 5, 12)]
    assert own[0] == own[1] == own[2] and len(own[0]) == 4
    assert own[0][3][7] == "K" + "D" * 499 + "K"


def test_edit_rows(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "user", "hello"), (1, 2, "user", "are you there?"), (1, 3, "assistant", "")]
    got = [(r["edit"], r["new_role"], r["text"], r["fault"], r["cost"]) for r in edits(table(spark, rows)).collect()]
    assert got == [("K", "system", "be kind.", None, 0), ("K", "user", "hello", "truncated", 1), ("R", "assistant", "are you there?", None, 2), ("D", None, "", "blank", 3)]


def test_damage(spark, data):
    rows = [(c, t, "assistant", "One. Two!") for c in (None, 1, 2) for t in (None, *range(40))]
    want = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        new = (c, t, "user" if fate == 4 else role, "" if fate == 1 else "One Two" if fate == 2 else text)
        want += [new] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in damage(table(spark, rows)).collect())


def test_nothing_left_and_empty(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = repair_report(table(spark, [(5, turn, "user", "x")])).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair_report(table(spark, [])).count() == 0
