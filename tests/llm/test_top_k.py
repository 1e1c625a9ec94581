"""The bounds of the top-k search: they never lose a best vector, and they leave few pairs to score."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowkeeper.llm import topk
from rowkeeper.llm.queries import QUERIES


def plain(ids, vectors, queries, k):
    """Best (score, id) of the other vectors for each query, in whole numbers."""
    whole = [[int(x) for x in v] for v in vectors]
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in zip(ids.tolist(), whole) if i != ids[q])
        out.append([(-s, i) for s, i in scored[:k]])
    return out


def search(ids, vectors, queries, k, sample, block=256):
    drawn = np.random.default_rng(5).permutation(len(ids))[:sample]
    start = topk.Start(ids[drawn], vectors[drawn], topk.turn_of(vectors[drawn]))
    found = topk.Search(ids[queries], vectors[queries], k, start.turn, start.least(ids[queries], vectors[queries], k))
    for a in range(0, len(ids), block):
        found.add(ids[a : a + block], vectors[a : a + block])
    return found


def best_of(found):
    return [list(zip(scores, ids)) for scores, ids in found.best]


def clustered(rows, dim, groups, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dim))
    return np.floor(1024 * (centres[draw.integers(0, groups, rows)] + 0.3 * draw.normal(size=(rows, dim))))


def test_bounds_leave_few_pairs_of_clustered_vectors():
    vectors = clustered(6_000, 64, 40)
    ids, queries = np.arange(6_000) * 7 + 1, np.arange(0, 6_000, 300)
    found = search(ids, vectors, queries, 10, sample=1_024)
    assert best_of(found) == plain(ids, vectors, queries, 10)
    shares = [n / found.pairs for n in found.survived]
    assert found.pairs == 20 * 6_000 and shares == sorted(shares, reverse=True)
    assert shares[0] < 0.9 and shares[2] < 0.1 and shares[-1] < 0.02


def test_bounds_leave_a_part_of_vectors_without_any_structure():
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(6_000, 64))
    vectors = np.floor(1024 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    ids, queries = np.arange(6_000), np.arange(0, 6_000, 300)
    found = search(ids, vectors, queries, 10, sample=2_048)
    assert best_of(found) == plain(ids, vectors, queries, 10)
    assert found.survived[-1] < 0.1 * found.pairs


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 33, 50, 100])
@pytest.mark.parametrize("kind", ["ties", "zeros", "mixed sizes", "beyond doubles"])
def test_any_vectors(dim, kind):
    draw = np.random.default_rng(dim)
    if kind == "ties":
        vectors = draw.integers(-2, 3, (300, dim)).astype(float)
    elif kind == "zeros":
        vectors = np.zeros((300, dim))
    elif kind == "mixed sizes":
        vectors = np.floor(draw.normal(size=(300, dim)) * 10.0 ** draw.integers(-2, 6, (300, 1)))
    else:
        # Scores are beyond what a double holds, and within a long.
        vectors = np.floor(draw.normal(size=(300, dim)) * 2.0**26)
    ids, queries = draw.permutation(300), np.arange(0, 300, 25)
    found = search(ids, vectors, queries, 7, sample=50, block=64)
    assert best_of(found) == plain(ids, vectors, queries, 7)


def test_many_components_are_ordered_by_size():
    vectors = np.zeros((40, 600))
    vectors[:, 17], vectors[:, 599] = 3.0, np.arange(40)
    turn = topk.turn_of(vectors)
    assert (np.abs(turn).sum(axis=0) == 1).all() and turn[599, 0] == 1 and turn[17, 1] == 1


@pytest.mark.parametrize("sample", [1, 16, 4_096])
def test_query_with_small_blocks_ties_and_repeated_ids(spark, tmp_path, monkeypatch, sample):
    """Rows that share an id are one item with its best score; columns may bear any name; dimensions do not mix."""
    monkeypatch.setattr(topk, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK_ROWS", 8)
    draw = np.random.default_rng(8)
    rows = [(int(i), draw.integers(-2, 3, 6) / 8) for i in draw.permutation(1_200)]
    rows += [(int(i), draw.integers(-2, 3, 6) / 8) for i in range(0, 1_200, 50)]
    rows += [(i, draw.integers(-2, 3, 3) / 8) for i in range(5_000, 5_200)]
    table = pa.table({
        "vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v.tolist() for _, v in rows], pa.list_(pa.float32())),
    })
    for name in ("id", "v", "dim", "block", "ids", "numbers", "least", "cell", "queries", "query_id", "score", "rank"):
        table = table.append_column(name, pa.array(["clash"] * len(rows)))
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    want = set()
    for query_id in {i for i, _ in rows if i % 100 == 0}:
        best: dict[int, float] = {}
        for mine in [v for i, v in rows if i == query_id]:
            for i, v in rows:
                if i != query_id and len(v) == len(mine):
                    best[i] = max(best.get(i, -math.inf), float(np.floor(1024 * mine) @ np.floor(1024 * v)))
        ranked = sorted((-s, i) for i, s in best.items())[:10]
        want |= {(query_id, at, i, int(-s)) for at, (s, i) in enumerate(ranked, 1)}
    found = QUERIES["op1_top_k_search"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_fewer_vectors_than_k_and_reruns(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=10, scale=2.0).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 2), (0, 2, 2, 0)]
