"""Exact top-k search by inner product, with distances bounded from segment statistics.

A vector is cut into segments; each segment has its length l, mean m and deviation s. For two vectors, the sum over the segments of
``l * ((m - m')**2 + (s - s')**2)`` never exceeds their squared distance, and more segments bound it closer. Since
``2 * score = |q|**2 + |x|**2 - distance**2``, a pair whose least distance is above what the k-th best score
allows cannot be among the best. Pairs are tested coarse to fine, and survivors get their exact score.

Two things make the bounds decide. A bounded sample of the vectors gives an orthogonal turn that brings most of the length into the
first components; distances stay as they are, and the first segments, which are the finer ones, tell most. The same sample is scored
with every query first, so each query starts in every cell with the k-th best score of the sample to beat.

Queries and vectors are packed into blocks and meet in cells (query block, vector group). A cell holds a bounded
number of vectors, whatever the size of the table, and returns at most k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 4, 16, 32, 48)  # segments; a level that gives a vector no more segments than the one before is passed over
SAMPLE_ROWS = 4_096  # vectors that fit the turn and give the first threshold; the k-th best of any set is a bound
SAMPLE_NUMBERS = 2**18  # numbers in the sample at most, but for a few vectors of very many components
MOST_TURNED = 512  # with more components they are put in order of their size instead of turned
PAIRWISE = 16  # one survivor in so many pairs: from there on pairs are compared one by one, not as a matrix
PAIRS_AT_ONCE = 65_536
BLOCK_ROWS = 2_048  # vectors of a packed block
CELL_ROWS = 65_536  # vectors that meet a query block in one cell
QUERY_BLOCK_ROWS = 2_048
SLACK = 1e-9  # relative, for rounding in the bounds
EXACT = 2.0**53
LONG = 2**63

PACKED = "dim int, block bigint, ids binary, numbers binary, least binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(vector: str) -> Column:
    """Vectors with at least one component, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite


def packed(vectors: DataFrame, scale: float, rows: int, least: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks of vectors of one dimension; components are ``floor(scale * x)``, which a double holds exactly.

    ``least`` gives a number for each vector of a block, to travel with it.
    """

    def pack(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ends = np.cumsum(dims)
            out = []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                values = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                for a in range(0, len(at), rows):
                    block = task * 2**32 + made
                    mine, numbers = ids[at[a : a + rows]], values[a : a + rows]
                    told = least(mine, numbers).tobytes() if least else b""
                    out.append((int(dim), block, mine.tobytes(), numbers.tobytes(), told))
                    made += 1
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "block", "ids", "numbers", "least"]
            )

    return vectors.mapInArrow(pack, PACKED)


def segment_edges(dim: int, segments: int) -> np.ndarray:
    """Starts and end of the segments: in halves as even as can be, and the first ones cut up further when there are more."""
    whole = 1 << (min(segments, dim).bit_length() - 1)  # segments of about equal length
    edges = np.linspace(0, dim, whole + 1).astype(int)
    extra = min(segments, dim) - whole
    halves = [(a + b) // 2 for a, b in zip(edges, edges[1:]) if b - a > 1][:extra]
    return np.unique(np.concatenate([edges, np.array(halves, int)]))


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations weighted so that a product of two rows is the sum of l * (m * m' + s * s')."""
    edges = segment_edges(vectors.shape[1], segments)
    lengths = np.diff(edges)
    means = np.add.reduceat(vectors, edges[:-1], axis=1) / lengths
    # A segment of one component has no deviation.
    long = lengths > 1
    spread = vectors - np.repeat(means, lengths, axis=1)
    deviations = np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1) / lengths)[:, long]
    return np.concatenate([means * np.sqrt(lengths), deviations * np.sqrt(lengths[long])], axis=1)


def turn_of(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose first columns are the directions that hold most of the sample's length."""
    dim = sample.shape[1]
    most = np.abs(sample).max(initial=0)
    if not most:
        return np.eye(dim)
    scaled = sample / most
    if dim > MOST_TURNED:
        return np.eye(dim)[:, np.argsort(-(scaled * scaled).sum(axis=0), kind="stable")]
    return np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1]


def products_of(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (left[i], right[j])."""
    out = np.empty(len(i))
    for a in range(0, len(i), PAIRS_AT_ONCE):
        b = a + PAIRS_AT_ONCE
        out[a:b] = np.einsum("ij,ij->i", left[i[a:b]], right[j[a:b]])
    return out


def exact_scores(queries: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs; beyond what a double holds exactly, by whole numbers, cut to the range of a long."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if most < EXACT:
        return products_of(queries, vectors, i, j)
    asked = {a: [int(x) for x in queries[a]] for a in set(i.tolist())}
    found = {b: [int(x) for x in vectors[b]] for b in set(j.tolist())}
    scores = [sum(x * y for x, y in zip(asked[a], found[b])) for a, b in zip(i.tolist(), j.tolist())]
    return np.array([min(max(s, -LONG), LONG - 1) for s in scores], object)


class Search:
    """The best k of a stream of vectors for each query of a block.

    ``turn`` is an orthogonal matrix for the bounds, ``least`` a score that at least k other vectors of the table reach.
    ``pairs`` counts the pairs met, ``survived`` those left after each level.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, turn: np.ndarray | None = None, least: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.turn = np.eye(queries.shape[1]) if turn is None else turn
        self.norms = np.einsum("ij,ij->i", queries, queries)
        levels, edges = [], 0
        for n in LEVELS:
            found = len(segment_edges(queries.shape[1], n))
            if found > edges:
                levels.append(n)
            edges = found
        turned = queries @ self.turn
        self.features = [(n, segment_features(turned, n)) for n in levels]
        self.best = [([], []) for _ in ids]  # scores and vector ids, best first
        self.least = np.full(len(ids), -math.inf) if least is None else least.astype(np.float64)
        self.pairs, self.survived = 0, [0] * len(levels)

    def _reach(self, rows: np.ndarray, columns: np.ndarray, norms: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Which pairs may reach the k-th best; what no number can tell stays."""
        sums, least = self.norms[rows] + norms[columns], self.least[rows]
        size = np.where(np.isfinite(least), np.abs(least), 0)
        return ~(sums - 2 * products > sums - 2 * least + SLACK * (sums + size))

    def survivors(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector numbers of the pairs that all levels leave."""
        norms = np.einsum("ij,ij->i", vectors, vectors)
        turned = vectors @ self.turn
        rows, columns = np.arange(len(self.ids)), np.arange(len(vectors))
        alive = np.ones((len(rows), len(columns)), bool)
        pair = None  # the surviving pairs, once they are few
        self.pairs += alive.size
        for at, (segments, mine) in enumerate(self.features):
            if pair is None:
                theirs = segment_features(turned[columns], segments)
                alive &= self._reach(rows[:, None], columns[None, :], norms, mine[rows] @ theirs.T)
                keep_rows, keep_columns = alive.any(axis=1), alive.any(axis=0)
                rows, columns, alive = rows[keep_rows], columns[keep_columns], alive[keep_rows][:, keep_columns]
                left = int(alive.sum())
                if left * PAIRWISE <= len(self.ids) * len(vectors):
                    i, j = np.nonzero(alive)
                    pair = rows[i], columns[j]
            else:
                needed, place = np.unique(pair[1], return_inverse=True)
                theirs = segment_features(turned[needed], segments) if len(needed) else np.zeros((0, mine.shape[1]))
                stay = self._reach(*pair, norms, products_of(mine, theirs, pair[0], place))
                pair = pair[0][stay], pair[1][stay]
                left = len(pair[0])
            self.survived[at] += left
        if pair is None:
            i, j = np.nonzero(alive)
            pair = rows[i], columns[j]
        return pair

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        of, at = self.survivors(vectors)
        own = ids[at] == self.ids[of]
        of, at = of[~own], at[~own]
        scores = exact_scores(self.queries, vectors, of, at)
        ends = np.searchsorted(of, np.arange(len(self.ids) + 1))
        for row in np.unique(of):
            mine = slice(ends[row], ends[row + 1])
            chosen = scores[mine] >= self.least[row]
            if chosen.any():
                self._keep(row, scores[mine][chosen], ids[at[mine]][chosen])

    def _keep(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k and scores.dtype != object:
            # All that reach the k-th best of these, ties included.
            reach = scores >= np.partition(scores, -self.k)[-self.k]
            if len(np.unique(ids[reach])) >= self.k:
                scores, ids = scores[reach], ids[reach]
        old_scores, old_ids = self.best[row]
        merged = sorted(zip([-int(s) for s in scores] + [-s for s in old_scores], [*ids.tolist(), *old_ids]))
        seen, new_scores, new_ids = set(), [], []
        for negative, vec_id in merged:
            if vec_id not in seen:
                seen.add(vec_id)
                new_scores.append(-negative)
                new_ids.append(vec_id)
                if len(new_ids) == self.k:
                    break
        self.best[row] = new_scores, new_ids
        if len(new_ids) == self.k:
            reached = float(new_scores[-1])
            # A large whole number may have been rounded up.
            self.least[row] = max(self.least[row], reached if abs(reached) < EXACT else np.nextafter(reached, -math.inf))


@dataclass
class Start:
    """What a bounded sample tells beforehand, for one dimension."""

    ids: np.ndarray
    vectors: np.ndarray
    turn: np.ndarray

    def least(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query in the sample, minus infinity where it holds fewer others."""
        found = Search(ids, queries, k, self.turn)
        found.add(self.ids, self.vectors)
        return found.least


def least_of(starts: Broadcast, k: int):
    """The threshold that each query starts with."""

    def least(ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        start = starts.value.get(queries.shape[1])
        return start.least(ids, queries, k) if start else np.full(len(ids), -math.inf)

    return least


def starts_of(kept: DataFrame, scale: float, dim: int) -> dict[int, Start]:
    """Sampled vectors by dimension: those with the lowest hashes of their ids, so that reruns agree.

    At most SAMPLE_ROWS vectors reach the driver, and no more than about SAMPLE_NUMBERS numbers when vectors are long.
    """
    rows = max(16, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, dim)))
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    by_dim: dict[int, dict[int, list[float]]] = {}
    for row in sample:
        by_dim.setdefault(len(row.v), {})[row.id] = row.v
    starts = {}
    for size, found in by_dim.items():
        vectors = np.floor(np.array(list(found.values()), np.float64) * scale)
        starts[size] = Start(np.array(list(found), np.int64), vectors, turn_of(vectors))
    return starts


def search_cell(k: int, starts: Broadcast):
    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(vectors):
            dim = int(vectors["dim"].iloc[0])
            start = starts.value.get(dim)
            least = np.concatenate([np.frombuffer(b, np.float64) for b in queries["least"]])
            ids = np.concatenate([np.frombuffer(b, np.int64) for b in queries["ids"]])
            numbers = np.concatenate([np.frombuffer(b, np.float64) for b in queries["numbers"]]).reshape(-1, dim)
            for a in range(0, len(ids), QUERY_BLOCK_ROWS):
                b = a + QUERY_BLOCK_ROWS
                found = Search(ids[a:b], numbers[a:b], k, start.turn if start else None, least[a:b])
                for block in vectors.sort_values("block").itertuples():
                    found.add(np.frombuffer(block.ids, np.int64), np.frombuffer(block.numbers, np.float64).reshape(-1, dim))
                for query_id, (scores, vec_ids) in zip(found.ids.tolist(), found.best):
                    rows += [(query_id, v, s) for s, v in zip(scores, vec_ids)]
        out = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])
        return out.astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return search


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """For each row that ``is_query`` selects, the ``k`` other vectors with the highest integer inner product.

    Components become ``floor(scale * x)``. Ties go to the smaller id; fewer than ``k`` vectors give fewer rows. Vectors that
    are null, empty or hold null or non-finite components take no part, nor do rows without an id. Only vectors of equal
    dimension are compared. A repeated id counts as one item with the best of its scores, and is never its
    own result. Scores outside the range of a long become its end. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col))
    narrow = [F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    total, queried, dim = kept.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size(vector_col))).first()
    starts = spark.sparkContext.broadcast(starts_of(kept.select(*narrow), scale, dim or 1))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / CELL_ROWS))
    query_groups = max(1, math.ceil(queried / QUERY_BLOCK_ROWS))

    blocks = packed(kept.select(*narrow), scale, BLOCK_ROWS).select(
        "*", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))).alias("queries"),
    )
    # Small pieces of queries, so that the query groups are about equal.
    asked = packed(kept.filter(is_query).select(*narrow), scale, QUERY_BLOCK_ROWS // 8, least_of(starts, k)).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell"),
        F.pmod(F.xxhash64("block"), F.lit(query_groups)).cast("int").alias("queries"),
    )
    key = ["dim", "queries", "cell"]
    partial = asked.groupBy(*[F.col(c) if c != "cell" else F.col(c).cast("bigint") for c in key]).cogroup(
        blocks.groupBy(*[F.col(c) if c != "cell" else F.col(c).cast("bigint") for c in key])
    ).applyInPandas(search_cell(k, starts), FOUND)
    by_query = partial.repartition(F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = by_query.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
