"""What travels in the similarity join: rows of lists that may match, and whole sets of likely pairs only."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rowkeeper.llm import jaccard
from rowkeeper.llm.common import word_hashes


def rows(seed: int) -> pa.RecordBatch:
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 400))
    token, n = rng.integers(0, rng.integers(2, 200), k), rng.integers(1, 60, k)
    pos = (rng.random(k) * [jaccard.prefix_length(int(x), 80) for x in n]).astype(int)
    order = np.lexsort((n, token))
    columns = token[order], np.arange(k), n[order].astype(np.int32), pos[order].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "gid", "n", "pos"])


@pytest.mark.parametrize("at_once, longest", [(50, 8), (7, 100), (1, 3), (1_000, 20)])
def test_only_rows_that_may_match_stay_in_lists(monkeypatch, at_once, longest):
    monkeypatch.setattr(jaccard, "LIST_ROWS_AT_ONCE", at_once)
    monkeypatch.setattr(jaccard, "LONGEST_TRIED", longest)
    for seed in range(10):
        batch = rows(seed)
        token, _, n, pos = (c.to_numpy() for c in batch.columns)
        batches = [batch.slice(start, 13) for start in range(0, len(token), 13)]
        batches.insert(1, batch.slice(0, 0))
        found = [g for b in jaccard.partnered_rows(80)(iter(batches)) for g in b.column(1).to_pylist()]
        matched = {
            i for i in range(len(token)) for j in range(len(token))
            if i != j and token[i] == token[j] and jaccard.may_match(n[i : i + 1], pos[i : i + 1], n[j : j + 1], pos[j : j + 1], 80)[0]
        }
        long = {i for i in range(len(token)) if (token == token[i]).sum() > longest}
        assert found == sorted(set(found)) and matched <= set(found) <= matched | long


def test_lists_without_rows():
    assert list(jaccard.partnered_rows(80)(iter([]))) == []
    assert list(jaccard.partnered_rows(80)(iter([rows(1).slice(0, 0)]))) == []


def test_whole_sets_are_filtered_where_they_are_read(spark):
    """Also when the ids are above the size that Spark sends by itself: a shuffle of all sets grows with the input at once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [(i, " ".join(f"w{j}" for j in range(40)) + f" end{i}") for i in range(6)]
        docs = spark.createDataFrame(texts, "id bigint, text string")
        pairs = spark.createDataFrame([(i, i + 1) for i in range(5)], "a bigint, b bigint")
        found = jaccard.verified(pairs, jaccard.sets_of(docs, pairs, 4), 85)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == [(i, i + 1) for i in range(5)]
        assert plan.count("Join LeftSemi") == plan.count("rightHint=(strategy=broadcast)") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_are_hashed_without_a_cache():
    words = [b"a", b"hello", b"x" * 100, "grün".encode()]
    assert word_hashes(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert word_hashes([]).dtype == np.uint64 and len(word_hashes([])) == 0


def test_documents_do_not_travel_to_lose_their_copies(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = " ".join(f"w{i}" for i in range(60))
        rows = [(1, text), (2, text + " x"), (3, "alone"), (None, text), (4, None), (5, "p q"), (5, "p q"), (6, "one"), (6, "two three")]
        found = jaccard.one_of_each_component(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r[0] for r in found.collect()), key=str) == [1, 3, 4, 5, 6, None]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
