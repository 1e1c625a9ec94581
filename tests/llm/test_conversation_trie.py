"""The trie of conversations against a plain dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rowkeeper.llm import trie
from rowkeeper.llm.queries import QUERIES


def plain_trie(rows):
    """Nodes as tuples in the order of COLUMNS, from rows (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(found, key=lambda t: t[:3])] for c, found in turns.items()}
    members = defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        whole = own.get(base, [])[:h] + own[conv][h:]
        for depth in range(len(whole) + 1):
            members[tuple(whole[:depth])].append((conv, depth == len(whole)))
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, found in members.items():
        chars = (len(found) - 1) * len(path[-1][1]) if path else 0
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += children[path] == 0
            saved[path[:depth]] += chars
    return sorted(
        (min(found)[0], len(path), min(members[path[:-1]])[0] if path else -1, len(found), children[path], leaves[path], saved[path],
         hashlib.sha256(",".join(str(c) for c, last in sorted(found) if last).encode()).hexdigest())
        for path, found in members.items()
    )


def rows_of(nodes):
    return sorted(tuple(-1 if v is None else v for v in row) for row in nodes.select(*trie.COLUMNS).collect())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("turns", [1, 4, 30, 1_000])
def test_containers_of_any_size(spark, turns):
    """Few different turns, so that many conversations share long beginnings or are copies."""
    rng = random.Random(turns)
    rows = [
        (conv, turn, rng.choice(["user", "user", "assistant"]), rng.choice(["a", "a", "a", "bé", ""]))
        for conv in [*range(80), *range(200, 240), *range(-30, 0)] for turn in range(rng.choice([0, 1, 3, 5, 12]))
    ]
    rows += [(conv, turn, "user", "same") for conv in range(300, 340) for turn in range(9)]
    found = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), turns)
    assert rows_of(found) == plain_trie(rows)


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_conversation_trie"](spark, folder)) == plain_trie(rows)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, conversations left without turns, clashing columns."""
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, None, None, None), (1, 0, "user", "y" * 300_000), (2, 0, "user", None)]
    rows += [(3, 4, "user", "same")] * 3 + [(4, 1, "b", "t"), (4, 1, "a", "t"), (500, 0, "user", ""), (501, 0, None, "")]
    rows += [(c, 0, "user", "only") for c in range(900, 960)]
    table = spark.createDataFrame([(*r, 1, b"z") for r in rows], SCHEMA + ", depth int, seq binary")
    table.repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(QUERIES["op12_conversation_trie"](spark, str(tmp_path))) == plain_trie(rows)


def test_all_conversations_without_turns(spark):
    """Of conversations that lose all their turns only the root is left, and it is a leaf."""
    lost = [c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 0]
    rows = [(c, 0, "user", "gone") for c in lost]
    (node,) = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (node.conv_id, node.depth, node.n_convs, node.n_children, node.n_leaves) == (min(lost), 0, len(lost), 0, 1)
    assert [tuple(-1 if v is None else v for v in node)] == plain_trie(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op12_conversation_trie"](spark, str(tmp_path))
    assert found.columns == trie.COLUMNS and found.count() == 0
