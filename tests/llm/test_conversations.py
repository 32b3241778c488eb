"""Conversation repair against plain enumeration, and its parts against each other."""

import hashlib
import random
import re
import zlib

import pytest

from ledgerlens.llm import conversations as C

SAID = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, key string, audit string, segment string, n string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_repair(rows):
    """rows of one conversation in order: the contract's figures by a plain search over (cost, audit) from the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = SAID.findall(text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)
    memo = {}

    def best(i, q):
        """(cost, audit, lines) from row i and state q: '' nothing yet, or the last initial."""
        if (i, q) in memo:
            return memo[i, q]
        memo[i, q] = (float("inf"), "", ())
        found = [(0, "", ())] if i == n and q in ("", "a") else []
        need = "a" if q == "u" else "u"
        name = {"a": "assistant", "u": "user"}[need]
        if i < n:
            _, role, text = rows[i]
            c, a, lines = best(i + 1, q)
            found.append((c + 3, "D" + a, lines))
            if faults[i] in ("", "truncated"):
                more = 1 if faults[i] else 0
                if role[:1] == need or (role[:1] == "s" and q == ""):
                    c, a, lines = best(i + 1, role[:1])
                    found.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best(i + 1, need)
                found.append((c + more + 2, "R" + a, (f"{name}:{text}", *lines)))
        # insertions: at most two in a row can help
        for path in ((need,), (need, "u" if need == "a" else "a")):
            if i < n or path[-1] == "a":
                c, a, lines = base(i, path[-1])
                names = tuple(f"{'assistant' if x == 'a' else 'user'}:" for x in path)
                found.append((c + 2 * len(path), "I" * len(path) + a, (*names, *lines)))
        memo[i, q] = min(found)
        return memo[i, q]

    def base(i, q):
        """as best, without a leading insertion"""
        if i == n:
            return (0, "", ()) if q in ("", "a") else (float("inf"), "", ())
        _, role, text = rows[i]
        need = "a" if q == "u" else "u"
        found = [(best(i + 1, q)[0] + 3, "D" + best(i + 1, q)[1], best(i + 1, q)[2])]
        if faults[i] in ("", "truncated"):
            more = 1 if faults[i] else 0
            name = {"a": "assistant", "u": "user"}[need]
            if role[:1] == need or (role[:1] == "s" and q == ""):
                c, a, lines = best(i + 1, role[:1])
                found.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
            c, a, lines = best(i + 1, need)
            found.append((c + more + 2, "R" + a, (f"{name}:{text}", *lines)))
        return min(found)

    cost, audit, lines = best(0, "")
    initials = [role[:1] if role[:1] in ("s", "u", "a") else "o" for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def plain_report(rows):
    out = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in plain_damage(rows):
        out[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {conv: plain_repair(sorted(x, key=order)) for conv, x in out.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], SCHEMA).repartition(3)
    got = C.repair_report(df).collect()
    want = plain_report(rows)
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r.conv_id]} == want[r.conv_id], r


def random_rows(n_conv, seed, longest=9):
    r = random.Random(seed)
    rows = []
    for conv in range(n_conv):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "usher"])
            text = r.choice(["Hello.", "What?", "no end", "", " \t\n", None, "Same.", "Yes! ", "a.b", f"t{r.randrange(9)}."])
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None, 1]), role, text))
    return rows


def test_random_conversations(spark):
    check(spark, random_rows(250, 1))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "No id."), (None, 2, "assistant", "Yes."), (5, None, None, None), (6, 3, "user", "x" * 100_000 + "."), (6, 3, "user", "x" * 100_000 + "."),
            (7, -4, "system", "é中🙂。"), (7, -2, "assistant", "line\nline."), (8, 0, "user", "Hi.")]
    check(spark, rows)
    assert C.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_row_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = C.repair_report(spark.createDataFrame([(conv, 0, "user", "Hi.", *"abcd")], SCHEMA)).first()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (0, 0, 0, 0, 0, 0, "")
    assert r.repaired_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("segment", [1, 4, 7, 64])
def test_conversations_of_many_segments(spark, monkeypatch, segment):
    """One conversation holds most rows; segments of a few rows give the same audit as one segment."""
    monkeypatch.setattr(C, "SEGMENT", segment)
    r = random.Random(segment)
    rows = [(1, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["Hello.", "cut", "", f"{t}."])) for t in range(300)] + random_rows(20, 3)
    check(spark, rows)


def test_blocks_agree_with_single_steps():
    t = C.tables()
    r = random.Random(2)
    for _ in range(200):
        symbols = "".join(r.choice(C.LETTERS) for _ in range(r.randrange(0, 40)))
        right, state = r.randrange(len(t.vectors)), r.randrange(4)
        left, exits = t.map_segment(symbols)
        v = right
        for s in reversed(symbols):
            v = t.back[v][t.classes[C.LETTERS.index(s)]]
        audit, after = t.trace(symbols, right, state)
        assert left[right] == v and exits[right, state] == after
        assert sum(x != "I" for x in audit) == len(symbols)


def test_vectors_are_closed_and_bounded():
    t = C.tables()
    assert len(t.vectors) < 40 and all(min(v) == 0 and max(v) <= 7 for v in t.vectors)
    assert t.block_back.shape == (len(t.vectors), 9 ** C.BLOCK)
