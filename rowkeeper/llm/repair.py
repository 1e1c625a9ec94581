"""Conversation structure repair: the cheapest edits that give each conversation a regular sequence of roles.

A conversation is regular when its role initials read ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of
user and assistant. Rows are dealt by conversation and sorted by turn in the shuffle, and one pass over the sorted stream
carries the state of a dynamic program from one Arrow batch to the next, so no conversation is ever held whole.

The program has four states, named by the last role initial: none, ``s``, ``u``, ``a``. Of each state it keeps the cost of the
cheapest edits that lead there and their place in ASCII order among the other states' edits. Costs are taken relative to the
cheapest state, and a state more than ``APART`` above it can never win again; so only a few hundred situations exist, each met
row leads from one to the next by a remembered step, and two bytes per row (the step's number) are all that the way back needs.
A conversation of more than ``BLOCK_ROWS`` rows gives up its texts block by block: each state carries the hash of its own
repaired text instead. Numbers of steps and digests of earlier rows beyond a bounded size go to unnamed scratch files of the
task, as in a sort that spills; they vanish with the task, and a task that starts anew writes them again.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\v\f\r"
BLOCK_ROWS = 1_024  # rows of a conversation whose texts are held
BLOCK_CHARS = 4_000_000  # likewise, characters
SPILL_BYTES = 8_000_000  # of step numbers that stay in memory
RUN_DIGESTS = 500_000  # digests of earlier rows that stay in memory
READ_STEPS = 1_000_000  # read at once on the way back

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2  # what an edit costs
TRUNCATED = 1  # what a truncated row costs unless it is deleted
APART = 5  # from any state, any other one's edits can be followed for at most this much more
LIMIT = 2**63 - 1

STATES = ("", "s", "u", "a")  # by the last role initial
NEXT = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
ROLE = {"u": "user", "a": "assistant"}
COMPLETION = {"": "", "s": "II", "u": "I", "a": ""}  # the inserts that make it regular

START = ((0, 0), None, None, None)  # (cost above the cheapest, place in ASCII order) of each state


def inserted(state: str, n: int) -> str | None:
    """The state after ``n`` inserted rows; only user and assistant can be inserted."""
    for _ in range(n):
        state = next(r for r in NEXT[state] if r in ROLE)
    return state


def segments(state: str, initial: str, must_delete: bool, truncated: bool) -> Iterator[tuple[str, int, str]]:
    """Ways to pass one row from a state: inserts and then one edit of the row. Gives edits, cost and the new state."""
    for n in range(3):
        here = inserted(state, n)
        before, cost = "I" * n, INSERT * n
        yield before + "D", cost + DELETE, here
        if must_delete:
            continue
        extra = TRUNCATED if truncated else 0
        if initial in NEXT[here]:
            yield before + "K", cost + KEEP + extra, initial
        role = next(r for r in NEXT[here] if r in ROLE)
        yield before + "R", cost + REROLE + extra, role


class Steps:
    """The steps of the dynamic program, each found once.

    ``after(situation, kind)`` gives the number of the step and the next situation; ``ways[number]`` tells for each
    state, as its position in STATES, where its best edits come from: the earlier state and the edits.
    """

    def __init__(self):
        self.ways: list[tuple] = []
        self.known: dict[tuple, tuple[int, tuple, int]] = {}

    def after(self, situation: tuple, kind: tuple) -> tuple[int, tuple, int]:
        """Number, next situation, and by how much the cheapest cost rises."""
        key = (situation, kind)
        if key not in self.known:
            self.known[key] = self._find(situation, kind)
        return self.known[key]

    def _find(self, situation: tuple, kind: tuple) -> tuple[int, tuple, int]:
        # Edits of different states are never a beginning of one another (each ends with the same row's edit), so the
        # place of the earlier state decides, and then the new edits.
        best: dict[str, tuple] = {}
        for i, held in enumerate(situation):
            if held is None:
                continue
            for edits, cost, state in segments(STATES[i], *kind):
                way = (held[0] + cost, held[1], edits, i)
                if state not in best or way < best[state]:
                    best[state] = way
        least = min(way[0] for way in best.values())
        kept = {s: way for s, way in best.items() if way[0] - least <= APART}
        places = {s: at for at, s in enumerate(sorted(kept, key=lambda s: kept[s][1:3]))}
        self.ways.append(tuple((kept[s][3], kept[s][2]) if s in kept else None for s in STATES))
        after = tuple((kept[s][0] - least, places[s]) if s in kept else None for s in STATES)
        return len(self.ways) - 1, after, least


def last_state(situation: tuple) -> tuple[int, int]:
    """Position of the state that ends best, and what ending costs above the cheapest state."""
    ends = [
        (held[0] + INSERT * len(COMPLETION[STATES[i]]), held[1], i) for i, held in enumerate(situation) if held is not None
    ]
    cost, _, at = min(ends)
    return at, cost


class Seen:
    """Digests of the rows met so far; sorted runs of them go to a scratch file when they are many."""

    def __init__(self):
        self.recent: set[bytes] = set()
        self.file, self.runs = None, []

    def add(self, digest: bytes) -> bool:
        """Whether the digest is new."""
        if digest in self.recent or any(self._in_run(run, digest) for run in self.runs):
            return False
        self.recent.add(digest)
        if len(self.recent) >= RUN_DIGESTS:
            self._spill()
        return True

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        start = self.file.seek(0, 2)
        self.file.write(b"".join(sorted(self.recent)))
        self.file.flush()
        run = np.memmap(self.file, np.uint8, "r", start, (len(self.recent), 16))
        self.runs.append(run)
        self.recent = set()

    @staticmethod
    def _in_run(run: np.ndarray, digest: bytes) -> bool:
        low, high = 0, len(run)
        while low < high:
            middle = (low + high) // 2
            if run[middle].tobytes() < digest:
                low = middle + 1
            else:
                high = middle
        return low < len(run) and run[low].tobytes() == digest

    def close(self) -> None:
        self.runs = []
        if self.file is not None:
            self.file.close()


class Conversation:
    """One conversation on its way through the stream."""

    def __init__(self, steps: Steps):
        self.steps = steps
        self.situation, self.cost = START, 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least_turn = self.most_turn = None
        self.n_turns, self.n_rows, self.chars = 0, 0, 0
        self.before: str | None = None
        self.seen = Seen()
        self.block: list[tuple[int, str, str]] = []  # step, role, text
        self.numbers = tempfile.SpooledTemporaryFile(max_size=SPILL_BYTES)
        # Per state: hash of its repaired text up to the block, and whether that has a row.
        self.hashes: list = [(hashlib.sha256(), False), None, None, None]

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if turn != self.most_turn:
                self.n_turns += 1
            self.least_turn = turn if self.least_turn is None else self.least_turn
            self.most_turn = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        bare = text.strip(SPACE)
        blank = not bare
        message = role.encode("utf-8", "surrogatepass")
        digest = hashlib.blake2b(b"%d:%b%b" % (len(message), message, text.encode("utf-8", "surrogatepass")), digest_size=16).digest()
        duplicate = not self.seen.add(digest) and not blank
        truncated = not blank and not duplicate and bare[-1] not in ".!?"
        for fault, found in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.counts[fault] += found
        kind = (initial if initial in ("s", "u", "a") else "", blank or duplicate, truncated)
        number, self.situation, rise = self.steps.after(self.situation, kind)
        self.cost += rise
        self.n_rows += 1
        self.chars += len(text)
        self.block.append((number, role, text))
        if len(self.block) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            self._give_up_texts()

    def _hash_of(self, state: int):
        """Hash of the repaired text of the edits that lead to a state now."""
        way = []
        for number, role, text in reversed(self.block):
            state, edits = self.steps.ways[number][state]
            way.append((state, edits, role, text))
        held, some = self.hashes[state]
        found = held.copy()
        for state, edits, role, text in reversed(way):
            now = STATES[state]
            lines = []
            for edit in edits:
                if edit == "D":
                    continue
                if edit == "K":
                    lines.append(f"{role}:{text}")
                    continue
                now = inserted(now, 1)
                lines.append(f"{ROLE[now]}:" + (text if edit == "R" else ""))
            for line in lines:
                found.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
                some = True
        return found, some

    def _give_up_texts(self) -> None:
        self.hashes = [None if held is None else self._hash_of(i) for i, held in enumerate(self.situation)]
        self.numbers.write(np.array([number for number, _, _ in self.block], np.uint16).tobytes())
        self.block, self.chars = [], 0

    def _edits(self, state: int) -> str:
        """All edits that lead to a state, found from the last row to the first."""
        found = []
        for number, _, _ in reversed(self.block):
            state, edits = self.steps.ways[number][state]
            found.append(edits[::-1])
        at = self.numbers.tell()
        parts = ["".join(found)]
        while at > 0:
            size = min(at, 2 * READ_STEPS)
            at -= size
            self.numbers.seek(at)
            found = []
            for number in np.frombuffer(self.numbers.read(size), np.uint16)[::-1].tolist():
                state, edits = self.steps.ways[number][state]
                found.append(edits[::-1])
            parts.append("".join(found))
        return "".join(parts)[::-1]

    def result(self) -> tuple:
        state, more = last_state(self.situation)
        found, some = self._hash_of(state)
        now = STATES[state]
        for _ in COMPLETION[now]:
            now = inserted(now, 1)
            found.update((("\n" if some else "") + f"{ROLE[now]}:").encode())
            some = True
        gaps = 0 if self.least_turn is None else min(self.most_turn - self.least_turn + 1 - self.n_turns, LIMIT)
        audit = self._edits(state) + COMPLETION[STATES[state]]
        self.numbers.close()
        self.seen.close()
        return gaps, *self.counts.values(), self.cost + more, audit, found.hexdigest()


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS_OUT = 4_096


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations of one partition, whose rows come together and in order."""
    steps = Steps()
    out: list[tuple] = []
    held, conversation = None, None

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["conv_id", *RESULT])
        made["conv_id"] = pd.array([row[0] for row in out], dtype="Int64")
        return made

    for batch in batches:
        ids = [None if none else int(c) for c, none in zip(batch["_conv"], batch["_no_conv"])]
        turns = [None if none else int(t) for t, none in zip(batch["_turn"], batch["_no_turn"])]
        for conv, turn, live, role, text in zip(ids, turns, batch["_live"], batch["_role"], batch["_text"]):
            if conversation is None or conv != held:
                if conversation is not None:
                    out.append((held, *conversation.result()))
                    if len(out) >= ROWS_OUT:
                        yield frame()
                        out.clear()
                held, conversation = conv, Conversation(steps)
            if live:
                conversation.row(turn, role, text)
    if conversation is not None:
        out.append((held, *conversation.result()))
    if out:
        yield frame()


def repair_conversations(rows: DataFrame, live=None) -> DataFrame:
    """Faults and the cheapest edits of each conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``).

    Rows for which ``live`` is false only name their conversation. A conversation without live rows has zeros, an empty audit and
    the hash of an empty text. Null roles and texts count as one space. Rows are taken by turn, nulls first; rows of one
    turn by role and text, so rows that are the same stand next to each other. A null ``conv_id`` is a conversation of its own. An
    empty table gives no rows; columns other than the four are not read. ``cost`` is the least total of the edits, ``audit`` their
    initials (Keep, Rerole, Delete, Insert), least in ASCII order among the cheapest.

    One shuffle by conversation, sorted by turn; memory is bounded whatever the length of a conversation, but for its audit.
    """
    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    here = F.lit(True) if live is None else live
    slim = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_conv"), F.col("conv_id").isNull().alias("_no_conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("_turn"), F.col("turn").isNull().alias("_no_turn"), here.alias("_live"),
        F.when(here, text("role")).alias("_role"), F.when(here, text("text")).alias("_text"),
    )
    dealt = slim.repartition("_conv").sortWithinPartitions("_conv", "_no_conv", F.desc("_no_turn"), "_turn", "_role", "_text")
    return dealt.mapInPandas(_repair, SCHEMA)


def damaged(conversations: DataFrame) -> tuple[DataFrame, object]:
    """The rows after the contract's damage, and the condition that they are still there.

    By crc32 of ``conv_id:turn`` modulo 20 (nulls are one space): 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3
    repeats it, 4 makes it a user's.
    """
    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    marked = conversations.select(
        "conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_damage")
    )
    changed = marked.withColumns({
        "text": F.when(F.col("_damage") == 1, "").when(F.col("_damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("_damage") == 4, "user").otherwise(F.col("role")),
        "_copy": F.explode(F.when(F.col("_damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return changed, F.col("_damage") != 0
