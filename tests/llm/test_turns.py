"""Conversation repair against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from metaloom.llm import turns

CONV = "conv_id long, turn long, role string, text string, place string, block long, kind string"
FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def slow_repair(rows):
    """gaps to digest of one conversation's rows in order, by the cheapest audits as strings."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        real = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else "")
        seen.add((role, text))
    turn = [r[1] for r in rows if r[1] is not None]
    gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {"": (0, "", [])}  # roles' initials of the output, shortened to what matters -> (cost, audit, lines)

    def grow(at, row, cost, code, role, text):
        out = {}
        for have, (c, audit, lines) in at.items():
            initial = role[:1]
            if initial == "s" and have == "" or initial == ("u" if have in ("", "s", "a") else "a"):
                found = (c + cost, audit + code, [*lines, f"{role}:{text}"])
                if initial not in out or found[:2] < out[initial][:2]:
                    out[initial] = found
        return out

    def merge(*several):
        out = {}
        for one in several:
            for k, v in one.items():
                if k not in out or v[:2] < out[k][:2]:
                    out[k] = v
        return out

    def inserted(at):
        for _ in range(3):
            at = merge(at, *(grow(at, None, 2, "I", r, "") for r in ("user", "assistant")))
        return at

    for (_, _, role, text), kind in zip(rows, kinds):
        best = inserted(best)
        gone = {k: (c + 3, a + "D", lines) for k, (c, a, lines) in best.items()}
        if kind in ("blank", "duplicate"):
            best = gone
            continue
        extra = kind == "truncated"
        kept = grow(best, None, extra, "K", role, text) if role[:1] in ("s", "u", "a") else {}
        best = merge(gone, kept, *(grow(best, None, 2 + extra, "R", r, text) for r in ("user", "assistant")))
    best = inserted(best)
    cost, audit, lines = min((v for k, v in best.items() if k in ("", "a")), key=lambda v: v[:2])
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow_report(rows):
    left = {c: [] for c, *_ in rows}
    for r in slow_damage(rows):
        left[r[0]].append(r)
    by_turn = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    return {c: slow_repair(sorted(rs, key=by_turn)) for c, rs in left.items()}


def made(rng, convs, most):
    rows = []
    for c in convs:
        n = rng.randrange(1, most)
        for t in range(n):
            if rng.random() < 0.85:
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursula", "auto", "s"])
                text = rng.choice(["Yes.", "No", "hm?", "", " \n", None, "a b!\t", "end ", "say. ", f"t{t}.", f"t{t}", "x y z.", "ok!"])
                rows += [(c, rng.choice([t, t, t, None, t + 3]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def distinct_places(rows):
    """At most one text and role for a turn, as the order of others is ours to choose."""
    seen = {}
    return [r for r in rows if seen.setdefault(r[:2], r) == r]


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_repair_equals_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = distinct_places(made(rng, [*range(60), None, -5], 14))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], CONV)
    got = turns.repair_report(df).collect()
    assert got[0].__fields__ == FIELDS
    want = slow_report(rows)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_a_long_conversation_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK_BITS", 4)
    monkeypatch.setattr(turns, "FAN_BITS", 1)
    rng = random.Random(7)
    rows = [(5, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice([f"t{t}.", f"t{t}", "again.", ""])) for t in range(900)]
    rows += [(6, 1, "user", "x."), (4, 0, "user", "y")]
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == slow_report(rows)


def test_equal_rows_by_the_thousand(spark):
    rows = [(1, 3, "user", "same.")] * 3000 + [(1, 1, "user", "first."), (2, 0, "user", "q?"), (2, 1, "assistant", "a.")]
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == slow_report(rows)


def test_empty_and_all_dropped(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    assert turns.repair_report(spark.createDataFrame([], schema)).count() == 0
    assert tuple(turns.repair_report(spark.createDataFrame([(dropped, 0, "user", "x")], schema)).first()) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_codes_are_prefix_free_and_in_order():
    assert list(turns.CODES) == sorted(turns.CODES)
    assert not any(a != b and b.startswith(a) for a in turns.CODES for b in turns.CODES)
