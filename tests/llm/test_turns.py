"""The repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from touchstone.llm import turns
from touchstone.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least cost and smallest audit of (initial, must go, breaks off), by states of the grammar."""
    never = (10**9, "")
    after = {s: (0, "") if s in ("start", "user") else never for s in ("start", "user", "assistant", "system")}
    for k in range(len(rows), -1, -1):
        now = dict(after) if k == len(rows) else {}
        for state in after if k < len(rows) else ():
            initial, must_go, broken = rows[k]
            cost, audit = after[state]
            options = [(cost + 2, "D" + audit)]
            if not must_go:
                wanted, then = ("a", "user") if state == "assistant" else ("u", "assistant")
                cost, audit = after[then]
                options.append((cost + 5 * broken + (initial != wanted), ("K" if initial == wanted else "R") + audit))
                if state == "start" and initial == "s":
                    cost, audit = after["system"]
                    options.append((cost + 5 * broken, "K" + audit))
            now[state] = min(options)
        for _ in range(4):
            for state in now:
                cost, audit = now["user" if state == "assistant" else "assistant"]
                now[state] = min(now[state], (cost + 5, "I" + audit))
        after = now
    return after["start"]


def applied(rows: list[tuple[str, str]], audit: str) -> list[str]:
    """The repaired turns that an audit stands for."""
    out, at, place = [], 0, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K" and not out and role[:1] == "s":
            out.append(f"{role}:{text}")
            continue
        out.append(f"{role if edit == 'K' else ('user', 'assistant')[place % 2]}:{text}")
        place += 1
    return out


def expected(rows: list[tuple]) -> dict:
    """The contract, row by row, for a whole table."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = groups[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {}
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen, states = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in kept:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            states.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        pairs = [a[0] + b[0] for a, b in zip(states, states[1:])]
        places = {t for t, _, _ in kept if t is not None}
        cost, audit = cheapest(states)
        text = "\n".join(applied([(r, t) for _, r, t in kept], audit))
        found[conv] = {
            "conv_id": conv, "gaps": max(places) - min(places) + 1 - len(places) if places else 0, **counts,
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }
    return found


def results(df) -> dict:
    return {row["conv_id"]: row.asDict() for row in df.collect()}


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_alignment_against_all_edits(cells, monkeypatch):
    monkeypatch.setattr(turns, "CELLS", cells)
    chance = random.Random(5)
    for _ in range(2000):
        rows = [(chance.choice("suauax"), chance.random() < 0.15, chance.random() < 0.2) for _ in range(chance.randint(0, 12))]
        rows = [(a, gone, broken and not gone) for a, gone, broken in rows]
        talk = turns.Conversation(1)
        talk.forced = bytearray(gone for _, gone, _ in rows)
        talk.stay = [(a, "t", broken) for a, gone, broken in rows if not gone]
        found = talk.repaired()
        assert (found["cost"], found["audit"]) == cheapest(rows)


def test_long_conversation_keeps_few_rows(monkeypatch):
    monkeypatch.setattr(turns, "CELLS", 1 << 14)
    n = 3000
    initials = np.where(np.arange(n) % 2 == 0, ord("u"), ord("a"))
    initials[::17] = ord("u")
    found = turns.Alignment(initials, np.zeros(n, bool))
    assert found.step > 1 and len(found.kept) < n / 40
    cost, audit = found.trace()
    assert (cost, audit.decode()) == cheapest([(chr(c), False, False) for c in initials])


def test_query_against_brute_force(spark, folder):
    found = results(QUERIES["op13_turn_repair"](spark, folder))
    rows = [tuple(r) for r in spark.read.schema(SCHEMA).parquet(f"{folder}/conversations.parquet").collect()]
    assert found == expected(rows)


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, ids past 2^53 beside a null, long texts, other columns."""
    chance = random.Random(3)
    ids = [None, 2**53 + 1, 2**53 + 3, -5, 7]
    texts = [None, "", " \n", "Yes.", "Yes. ", "no", "what?", "x" * 300_000 + ".", "é ça. "]
    rows = [
        (chance.choice(ids), chance.choice([None, -(2**63), 2**63 - 1, 0, 1, 2, 3, 4]),
         chance.choice([None, "", "user", "assistant", "system", "tool"]), chance.choice(texts))
        for _ in range(60)
    ]
    rows = [r for r in rows + rows[:10] if not (r[0] == 7 and zlib.crc32(f"7:{r[1]}".encode()) % 20)]
    gone = [(9, t, "user", "Hello.") for t in range(200) if zlib.crc32(f"9:{t}".encode()) % 20 == 0]
    rows += gone
    wide = spark.createDataFrame([r + ("z", 1) for r in rows], SCHEMA + ", audit STRING, one INT")
    found, wanted = results(turns.report(wide)), expected(rows)
    for row in wanted.values():
        row["gaps"] = min(row["gaps"], 2**63 - 1)
    assert found == wanted
    assert found[9]["audit"] == "" and found[9]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert turns.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_with_a_third_of_the_rows(spark):
    rows = [(None, t % 50, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(600)]
    rows += [(c, t, ("user", "assistant")[t % 2], "Well.") for c in range(300) for t in range(4)]
    found = results(turns.report(spark.createDataFrame(rows, SCHEMA)))
    assert found == expected(rows)
