"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from rowkeeper.llm import repair
from rowkeeper.llm.queries import QUERIES

TRAILING = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """Faults, edits and repaired text of the rows ``(turn, role, text)`` of one conversation, by search over suffixes."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(TRAILING)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    initials = [r[1][:1] for r in rows]
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 4:
            role = follows[state][-1]
            cost, edits, out = best(i, role, inserts + 1)
            found.append((cost + 2, "I" + edits, ((role, None, ""), *out)))
        if i < len(rows):
            cost, edits, out = best(i + 1, state, 0)
            found.append((cost + 3, "D" + edits, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if initials[i] and initials[i] in follows[state]:
                    cost, edits, out = best(i + 1, initials[i], 0)
                    found.append((cost + extra, "K" + edits, ((initials[i], rows[i][1], rows[i][2]), *out)))
                role = follows[state][-1]
                cost, edits, out = best(i + 1, role, 0)
                found.append((cost + 2 + extra, "R" + edits, ((role, None, rows[i][2]), *out)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "~", ())

    cost, audit, out = best(0, "", 0)
    names = {"u": "user", "a": "assistant"}
    lines = [f"{role or names[initial]}:{text}" for initial, role, text in out]
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a + b for a, b in zip(initials, initials[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def streamed(rows):
    conversation = repair.Conversation(repair.Steps())
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
        conversation.row(turn, role, text)
    return dict(zip(repair.RESULT, conversation.result()))


def random_rows(rng, n):
    texts = ["Yes.", "No!", "and so", "  ", "", "Why? ", "é"]
    roles = ["user", "assistant", "system", "tool", " ", "", "user", "assistant"]
    return [(rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", " a.", " b"])) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 3, 1_024])
def test_streamed_edits_are_the_cheapest(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    monkeypatch.setattr(repair, "READ_STEPS", 2)
    monkeypatch.setattr(repair, "SPILL_BYTES", 4)
    monkeypatch.setattr(repair, "RUN_DIGESTS", 2)
    rng = random.Random(block)
    for _ in range(400):
        rows = random_rows(rng, rng.randrange(11))
        assert streamed(rows) == plain_repair(rows), rows


def test_long_conversation_takes_few_steps():
    rng = random.Random(5)
    steps = repair.Steps()
    conversation = repair.Conversation(steps)
    for i in range(60_000):
        conversation.row(i, rng.choice(["user", "assistant", "system", "x"]), f"{i}" + rng.choice([".", ""]))
        assert len(conversation.block) < repair.BLOCK_ROWS
    found = dict(zip(repair.RESULT, conversation.result()))
    edits = found["audit"]
    assert len(re.findall("[DKR]", edits)) == 60_000
    assert len(steps.ways) < 5_000
    assert found["truncated"] > 0 and found["gaps"] == 0


def damaged_plainly(rows):
    """The rows left of each conversation; ``rows`` are (conv_id, turn, role, text)."""
    left = {}
    for conv, turn, role, text in rows:
        kept = left.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return left


def compare(spark, rows, found):
    expected = {conv: plain_repair(kept) for conv, kept in damaged_plainly(rows).items()}
    got = {r.conv_id: {c: r[c] for c in repair.RESULT} for r in found.collect()}
    assert got == expected


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    compare(spark, [tuple(r) for r in rows], QUERIES["op13_conversation_repair"](spark, folder))


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, an empty and a long text, repeated rows, ties, large ids and extra columns."""
    big = 2**53 + 1
    rows = [(None, None, None, None), (1, None, None, None), (1, 2, "user", "x" * 200_000), (1, 2, "user", "x" * 200_000),
            (1, 2, "user", "a."), (1, 2, "assistant", "a."), (big, 0, "user", "Hi."), (big + 1, 0, "user", "Hi."), (None, 3, "user", "")]
    rows += [(7, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(30)]
    rows += [(c, t, None, "?") for c in range(20, 40) for t in (0, 1)]
    table = spark.createDataFrame(
        [(*r, 5, "y") for r in rows], "conv_id long, turn long, role string, text string, _conv long, audit string"
    )
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, rows, QUERIES["op13_conversation_repair"](spark, str(tmp_path)))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    assert found.columns == ["conv_id", *repair.RESULT] and found.count() == 0
