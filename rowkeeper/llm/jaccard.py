"""Similarity join of documents on word shingles: a grouped prefix join.

Two sets whose Jaccard similarity reaches the threshold share an element among the first few of each, in any order of the
elements that both follow. Rare elements come first here, so few documents share one. Documents with equal sets are one set;
sets with the same prefix and size are one group, and only groups meet in the lists of an element. Group pairs
are tested by size and position, then their members are compared in full.

A set also has a parity bitmap: each element flips one of 512 bits. Two bitmaps differ in at most as many bits as
the sets in elements, so too many different bits exclude a pair before its sets are read.

Only components are asked for, so a list need not give all its pairs. Round one compares each group with the likeliest of the
groups before it in the list, by their bitmaps, and with the first of its size class: a number of pairs in proportion to the
list. The likeliest pair of each group is read first; of the others only those are read that the links found so far do not connect. Round two takes the lists that still hold several components and compares every pair of different components that no
earlier test excludes. A long list is cut into blocks there, by size and by a hash, and a task compares two blocks at a time; rows
of one large component are blocks of their own, which are not compared with each other. What round two skips is connected already; so no component is missed, and a large group of copies gives
no square of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowkeeper.llm.common import rows_of, window_hashes, word_hashes
from rowkeeper.llm.components import connected
from rowkeeper.session import written

WIDTH = 4  # words of a shingle
PERCENT = 85
FREQUENT = 100_000  # shingles that are put last; a bound on the list, which only decides the order
COUNTED_AT_ONCE = 2_000_000  # shingles that a task counts together
LEAST_REPEATS = 3  # in those, to be reported as frequent
NEIGHBOURS = 3  # likely partners that round one tries for each row of a list
BLOCK_ROWS = 4096  # rows of a list that one task compares in round two; longer lists are cut into blocks
REACH = 256  # rows before it in the list, among which they are found
BITS = 512  # of a parity bitmap
CLASSES_PER_DOUBLING = 4  # size classes, whose first member all others in the list are compared with
PAIRS_AT_ONCE = 500_000
LIST_ROWS_AT_ONCE = 65_536  # rows of lists that a task looks through together for rows without a partner
LONGEST_TRIED = 512  # rows of a list in which partners are looked for; longer lists keep all their rows
MOST_SENT = 2_000_000  # pairs or ids that may be sent to all executors; larger tables are left to Spark's own size check

DESCRIBED = "id bigint, n int, set_id binary, prefix binary, prefix_key binary, bits binary"
LISTED = "token bigint, gid bigint, n int, pos int"


def least_overlap(total, percent: int):
    """Common elements that two sets with ``total`` elements together need."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Shingler:
    """Sorted hashes of the distinct shingles of a text, A-Z in lower case."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, text: str | None) -> np.ndarray:
        if text is None:
            return np.zeros(0, np.uint64)
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
        if not words:
            return np.zeros(0, np.uint64)
        width = min(self.width, len(words))
        found = np.sort(window_hashes(word_hashes(words), width))
        # A short sequence differs from every full shingle.
        return found[np.append(True, found[1:] != found[:-1])] if width == self.width else found ^ np.uint64(width)


class Order:
    """The order of elements: those that are not frequent by hash, then the frequent ones from rare to common."""

    def __init__(self, frequent: np.ndarray):
        by_hash = np.argsort(frequent)
        self.hashes, self.rank = frequent[by_hash], len(frequent) - by_hash

    def prefix(self, found: np.ndarray, length: int) -> np.ndarray:
        if not len(self.hashes):
            return found[:length]
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        frequent = self.hashes[at] == found
        rare = found[~frequent]
        if len(rare) >= length:
            return rare[:length]
        common = found[frequent][np.argsort(self.rank[at[frequent]])]
        return np.concatenate([rare, common])[:length]


def frequent_shingles(docs: DataFrame, width: int, most: int) -> np.ndarray:
    """Frequent shingles, the most frequent first: the ``most`` highest counts among those that repeat within a task."""

    def count(batches):
        shingles, held, waiting = Shingler(width), [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LEAST_REPEATS
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "n"]
            )

        for (texts,) in rows_of(batches, "text"):
            for text in texts:
                held.append(shingles(text))
                waiting += len(held[-1])
            if waiting >= COUNTED_AT_ONCE:
                yield flush()
                held, waiting = [], 0
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    # At most ``most`` numbers.
    rows = counted.orderBy(F.desc("n"), "token").limit(most).select("token").toPandas()
    return rows["token"].to_numpy(np.int64).view(np.uint64)


def parity_bits(found: np.ndarray) -> bytes:
    """A bitmap in which each element has flipped one bit."""
    return np.packbits(np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def described(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """Per row: id, number of shingles, hash of the set, the prefix with a hash of it, and the bitmap."""

    def describe(batches):
        shingles, order = Shingler(width), Order(frequent.value)
        for ids, texts in rows_of(batches, "id", "text"):
            sizes, sets, prefixes, keys, bits = [], [], [], [], []
            for text in texts:
                found = shingles(text)
                n = len(found)
                prefix = order.prefix(found, prefix_length(n, percent)) if n else found
                sizes.append(n)
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                prefixes.append(prefix.tobytes())
                keys.append(xxhash.xxh3_128_digest(prefix.tobytes()))
                bits.append(parity_bits(found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary()),
                    pa.array(prefixes, pa.binary()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary()),
                ],
                ["id", "n", "set_id", "prefix", "prefix_key", "bits"],
            )

    return docs.mapInArrow(describe, DESCRIBED)


def listed(groups: DataFrame) -> DataFrame:
    """A row per group and element of its prefix."""

    def spread(batches):
        for ids, sizes, prefixes in rows_of(batches, "gid", "n", "prefix"):
            tokens = [np.frombuffer(p, np.int64) for p in prefixes]
            lengths = [len(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)),
                    pa.array(np.repeat(np.array(ids, np.int64), lengths)),
                    pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths] or [np.zeros(0, np.int32)])),
                ],
                ["token", "gid", "n", "pos"],
            )

    return groups.select("gid", "n", "prefix").mapInArrow(spread, LISTED)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1)) * CLASSES_PER_DOUBLING).astype(np.int64)


def may_match(a_n, a_pos, b_n, b_pos, percent: int):
    """Sizes are close enough, and what follows a first common element at these places is enough to match."""
    small, large = np.minimum(a_n, b_n).astype(np.int64), np.maximum(a_n, b_n).astype(np.int64)
    rest = np.minimum(a_n - a_pos, b_n - b_pos)
    return (100 * small >= percent * large) & (rest >= least_overlap(small + large, percent))


def with_partner(token, n, pos, percent: int) -> np.ndarray:
    """Which rows may match another row of their list, by size and position; rows come sorted by token and size."""
    found = np.zeros(len(token), bool)
    at = np.arange(len(token))
    for step in range(1, len(token)):
        at = at[at >= step]
        # What is too small for a row is so for all larger rows before it.
        at = at[(token[at] == token[at - step]) & (100 * n[at - step].astype(np.int64) >= percent * n[at].astype(np.int64))]
        if not len(at):
            break
        both = at[may_match(n[at], pos[at], n[at - step], pos[at - step], percent)]
        found[both] = found[both - step] = True
    return found


def partnered_rows(percent: int):
    """Rows, sorted by token and size, that may match another row of their list; all rows of lists above ``LONGEST_TRIED`` rows."""

    def kept(rows: pa.Table):
        token, n, pos = (rows.column(c).to_numpy() for c in ("token", "n", "pos"))
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        lengths = np.diff(np.append(starts, len(token)))
        long = np.repeat(lengths > LONGEST_TRIED, lengths)
        short = np.flatnonzero(~long & np.repeat(lengths > 1, lengths))
        long[short] = with_partner(token[short], n[short], pos[short], percent)
        yield from rows.filter(pa.array(long)).combine_chunks().to_batches()

    def pairs_in_reach(batches):
        held, size, passing = [], 0, None  # rows that wait, and the token of a long list whose rows pass as they come
        for batch in batches:
            if passing is not None and batch.num_rows:
                end = int(np.searchsorted(batch.column(0).to_numpy() != passing, True))
                yield batch.slice(0, end)
                passing, batch = passing if end == batch.num_rows else None, batch.slice(end)
            held.append(batch)
            size += batch.num_rows
            if size < LIST_ROWS_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            token = rows.column("token").to_numpy()
            last = len(token) - int(np.searchsorted(token[::-1] != token[-1], True))  # where the open list starts
            if len(token) - last > LONGEST_TRIED:
                last, passing = len(token), token[-1]
            yield from kept(rows.slice(0, last)) if last else ()
            held = rows.slice(last).to_batches()
            size = len(token) - last
        if size:
            yield from kept(pa.Table.from_batches(held).combine_chunks())

    return pairs_in_reach


def bitmaps_of(column: pa.Array) -> np.ndarray:
    """A row of 64-bit numbers per bitmap."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps differ: no more than the sets in elements."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def most_different(a_n, b_n, percent: int):
    """Elements that one of two similar sets may have without the other."""
    return a_n + b_n - 2 * least_overlap(a_n + b_n, percent)


def pair_batch(a: np.ndarray, b: np.ndarray, apart: np.ndarray | None = None) -> pa.RecordBatch:
    """Each pair once, smaller id first; with ``apart`` also the least number of bits between them."""
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b), np.zeros_like(a) if apart is None else apart], axis=1)
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    pairs = pairs[np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)])] if len(pairs) else pairs
    names = ["a", "b"] if apart is None else ["a", "b", "apart"]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in range(len(names))], names)


def neighbour_pairs(percent: int):
    """Pairs of each row with the likeliest of the REACH rows before it and with the first row of its size class in its list.

    Rows come sorted by token, size and a hash; a few rows are carried from batch to batch.
    """

    def pairs(batches):
        carried = None  # rows of the list that is still open: the head of its class and its latest rows
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            fresh = len(now)
            if not fresh:
                continue
            bits = bitmaps_of(batch.column(4))
            if carried is not None:
                now, bits = np.concatenate([carried[0], now]), np.concatenate([carried[1], bits])
            old = len(now) - fresh
            token, gid, n, pos = now.T

            def distance(a, b):
                """Bits between the rows, out of reach where the pair is excluded."""
                apart = differing(bits[a], bits[b])
                ok = may_match(n[a], pos[a], n[b], pos[b], percent) & (apart <= most_different(n[a], n[b], percent))
                return np.where(ok & (gid[a] != gid[b]), apart, BITS + 1)

            best = np.full((len(now), NEIGHBOURS), BITS + 1)
            partner = np.zeros((len(now), NEIGHBOURS), np.int64)
            at = np.arange(old, len(now))
            for step in range(1, REACH + 1):
                at = at[at >= step]
                at = at[token[at] == token[at - step]]
                if not len(at):
                    break
                apart = distance(at - step, at)
                worst = best[at].argmax(axis=1)
                closer = apart < best[at, worst]
                best[at[closer], worst[closer]], partner[at[closer], worst[closer]] = apart[closer], at[closer] - step
            second, column = np.nonzero(best <= BITS)
            first = partner[second, column]
            classes = size_class(n)
            opens = np.concatenate([[True], (token[1:] != token[:-1]) | (classes[1:] != classes[:-1])])
            head = np.maximum.accumulate(np.where(opens, np.arange(len(now)), 0))
            at = np.arange(old, len(now))
            at = at[head[at] < at]
            at = at[distance(head[at], at) <= BITS]
            bits_apart = np.concatenate([best[second, column], distance(head[at], at)])
            yield pair_batch(gid[np.concatenate([first, head[at]])], gid[np.concatenate([second, at])], bits_apart)
            keep = sorted({int(head[-1]), *range(max(0, len(now) - REACH), len(now))})
            carried = now[keep], bits[keep]

    return pairs


def partners(row, row_bits, others, bits, percent: int) -> np.ndarray:
    """Which of the other rows (token, rep, n, pos, component) are of another component and may match the row."""
    ok = (others[:, 4] != row[4]) & may_match(others[:, 2], others[:, 3], row[2], row[3], percent)
    left = np.flatnonzero(ok)
    apart = differing(bits[left], row_bits)
    return left[apart <= most_different(others[left, 2], row[2], percent)]


def crossing_pairs(percent: int):
    """All pairs of one list in different components that may match; rows come sorted by token and size."""

    def pairs(batches):
        held, held_bits = None, None  # rows of the list that is still open
        first, second, waiting = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            bits = bitmaps_of(batch.column(5))
            before = 0
            if held is not None and held[0, 0] == rows[0, 0]:
                rows, bits, before = np.concatenate([held, rows]), np.concatenate([held_bits, bits]), len(held)
            token, rep, n, pos, component = rows.T.copy()
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            # Rows of one component have nothing to find among each other.
            mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
            at = np.flatnonzero(np.repeat(mixed, np.diff(np.append(starts, len(token)))))
            at = at[at >= before]
            for step in range(1, len(token)):
                at = at[at >= step]
                at = at[(token[at] == token[at - step]) & (100 * n[at - step] >= percent * n[at])]
                if not len(at):
                    break
                y = at[component[at] != component[at - step]]
                y = y[may_match(n[y], pos[y], n[y - step], pos[y - step], percent)]
                y = y[differing(bits[y], bits[y - step]) <= most_different(n[y], n[y - step], percent)]
                first.append(rep[y - step])
                second.append(rep[y])
                waiting += len(y)
                if waiting >= PAIRS_AT_ONCE:
                    yield pair_batch(np.concatenate(first), np.concatenate(second))
                    first, second, waiting = [], [], 0
            # Smaller rows than these cannot match what follows in the list.
            rest = starts[-1] + np.searchsorted(n[starts[-1] :], -(-percent * n[-1] // 100))
            held, held_bits = rows[rest:], bits[rest:]
        if waiting:
            yield pair_batch(np.concatenate(first), np.concatenate(second))

    return pairs


def cells(rows: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """The rows of long lists once per pair of blocks ``x``, ``y`` that they have to be compared in, as ``side`` 0 or 1.

    A block holds about ``block_rows`` rows of a list and of one size class at most. Components with more than that in a class
    have blocks to themselves, the others share theirs. A block is paired with itself and with each other block of its list once,
    unless their sizes exclude a match or both are of one component.
    """
    own = ["token", "class", "big", "owner", "part"]
    sized = rows.withColumn("class", F.floor(F.log2("n") * CLASSES_PER_DOUBLING).cast("int"))
    counts = sized.groupBy("token", "class", "component").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.ceil(F.sum("rows") / block_rows)
    large = counts.filter(F.col("rows") > block_rows).groupBy("token", "class", "component").agg(parts.alias("large_parts"))
    small = counts.filter(F.col("rows") <= block_rows).groupBy("token", "class").agg(parts.alias("small_parts"))
    blocked = sized.join(large, ["token", "class", "component"], "left").join(small, ["token", "class"], "left")
    is_large = F.col("large_parts").isNotNull()
    blocked = written(
        blocked.select(
            "token", "class", is_large.alias("big"), F.when(is_large, F.col("component")).otherwise(0).alias("owner"),
            F.expr("pmod(xxhash64(rep, token), coalesce(large_parts, small_parts))").alias("part"),
            "rep", "n", "pos", "component", "bits",
        ), "blocked",
    )
    blocks = written(
        blocked.groupBy(*own).agg(F.min("n").alias("low"), F.max("n").alias("high"))
        .withColumn("block", F.monotonically_increasing_id()), "blocks",
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    met = x.join(
        y, F.expr(
            "x.token = y.token AND x.block <= y.block AND NOT (x.big AND y.big AND x.owner = y.owner) "
            f"AND 100L * x.high >= {percent}L * y.low AND 100L * y.high >= {percent}L * x.low"
        ),
    )
    first = met.select("x.token", *[f"x.{c}" for c in own[1:]], F.col("x.block").alias("x"), F.col("y.block").alias("y"), F.lit(0).alias("side"))
    second = met.filter("x.block < y.block").select(
        "y.token", *[f"y.{c}" for c in own[1:]], F.col("x.block").alias("x"), F.col("y.block").alias("y"), F.lit(1).alias("side")
    )
    return blocked.join(first.unionByName(second), own).select("x", "y", "side", "rep", "n", "pos", "component", "bits")


def cell_pairs(percent: int):
    """The pairs of ``crossing_pairs`` in cells; rows come sorted by cell, side and size, and one cell is in memory at a time."""

    def compared(rows, bits):
        # Columns x, y, side, rep, n, pos, component; ``partners`` reads the last five.
        if rows[0, 0] == rows[0, 1]:
            a, a_bits, b, b_bits = rows, bits, rows, bits
        else:
            a, a_bits, b, b_bits = rows[rows[:, 2] == 0], bits[rows[:, 2] == 0], rows[rows[:, 2] == 1], bits[rows[:, 2] == 1]
        alone = rows[0, 0] == rows[0, 1]
        first, second, waiting = [], [], 0
        for at in range(len(a)):
            n = a[at, 4]
            low = max(np.searchsorted(b[:, 4], -(-percent * n // 100)), at + 1 if alone else 0)
            high = np.searchsorted(b[:, 4], 100 * n // percent, side="right")
            left = partners(a[at, 2:], a_bits[at], b[low:high, 2:], b_bits[low:high], percent)
            if len(left):
                first.append(b[low:high][left, 3])
                second.append(np.full(len(left), a[at, 3]))
                waiting += len(left)
            if waiting >= PAIRS_AT_ONCE:
                yield pair_batch(np.concatenate(first), np.concatenate(second))
                first, second, waiting = [], [], 0
        if first:
            yield pair_batch(np.concatenate(first), np.concatenate(second))

    def pairs(batches):
        held, held_bits = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)], axis=1)
            bits = bitmaps_of(batch.column(7))
            starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            for start, end in zip(starts, [*starts[1:], len(rows)]):
                if held and (held[-1][-1, :2] != rows[start, :2]).any():
                    yield from compared(np.concatenate(held), np.concatenate(held_bits))
                    held, held_bits = [], []
                held.append(rows[start:end])
                held_bits.append(bits[start:end])
        if held:
            yield from compared(np.concatenate(held), np.concatenate(held_bits))

    return pairs


def sketch(found: np.ndarray) -> bytes:
    """A parity bitmap with twice as many bits as elements at least, so it tells sets of any size apart."""
    bits = max(BITS, 1 << (2 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def sketches_differ(x: bytes, y: bytes) -> int:
    """In how many bits the sketches differ; the longer one is folded, which gives the bitmap with fewer bits of the same set."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    short = min(len(a), len(b))
    folded = [np.bitwise_xor.reduce(v.reshape(-1, short), axis=0) for v in (a, b)]
    return int(np.bitwise_count(folded[0] ^ folded[1]).sum())


def sent(rows: DataFrame, id_col: str) -> DataFrame:
    """The distinct ids of a written table, sent to all executors unless the table has more than ``MOST_SENT`` rows."""
    ids = rows.select(id_col).distinct()
    return F.broadcast(ids) if rows.count() <= MOST_SENT else ids


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole sets reach the threshold.

    Sketches, a thirty-second of the sets in size, meet first; only pairs that they do not exclude meet with their whole sets.
    """
    def likely(batches):
        for batch in batches:
            keep = [
                sketches_differ(x, y) <= most_different(a_n, b_n, percent)
                for x, y, a_n, b_n in zip(*[batch.column(i).to_pylist() for i in range(2, 6)])
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def test(batches):
        for batch in batches:
            keep = []
            for first, second in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(first.as_buffer(), np.uint64), np.frombuffer(second.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("rep").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("a_n"))
    second = sets.select(F.col("rep").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("b_n"))
    met = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y", "a_n", "b_n")
    left = written(met.mapInArrow(likely, "a bigint, b bigint"), "likely")
    # Whole sets are filtered where they are read, and do not travel for it.
    first = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")).join(sent(left, "a"), "a", "left_semi")
    second = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")).join(sent(left, "b"), "b", "left_semi")
    return left.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(test, "a bigint, b bigint")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``rep``, the number of shingles, their sorted hashes and the sketch of the wanted documents."""

    def build(batches):
        shingles = Shingler(width)
        for ids, texts in rows_of(batches, "id", "text"):
            found = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([f.tobytes() for f in found], pa.binary()),
                    pa.array(map(sketch, found), pa.binary()),
                ],
                ["rep", "n", "shingles", "sketch"],
            )

    chosen = docs.join(sent(wanted, "id"), "id", "left_semi")
    return chosen.mapInArrow(build, "rep bigint, n bigint, shingles binary, sketch binary")


def sets_of(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """``whole_sets`` of the documents that occur in pairs, which are few beside all that share an element."""
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    return written(whole_sets(docs, ids, width), "sets")


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ids are in different components, with these as ``top_a`` and ``top_b``."""
    tops = found.select(F.col("id").alias("a"), F.col("component").alias("top_a"))
    others = found.select(F.col("id").alias("b"), F.col("component").alias("top_b"))
    joined = pairs.join(tops, "a", "left").join(others, "b", "left")
    return joined.withColumns({"top_a": F.coalesce("top_a", "a"), "top_b": F.coalesce("top_b", "b")}).filter("top_a <> top_b")


def joined_further(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links. What was connected before is one node here, so little is left to connect."""
    bridges = written(across(links, found).select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).distinct(), "bridges")
    if bridges.isEmpty():
        return found
    tops = written(connected(bridges), "tops")
    renamed = tops.select(F.col("id").alias("old"), F.col("component").alias("new"))
    below = found.join(renamed, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component"))
    # Ids that were alone before were their own component.
    alone = tops.join(found.select("id"), "id", "left_anti")
    return written(below.unionByName(alone), "components")


def similarity_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    frequent: int = FREQUENT, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable over links, for each row.

    Two documents are linked when ``100 * common >= percent * union`` for their sets of distinct shingles of ``width``
    words, A-Z in lower case; fewer words are one shingle. A document without words (or with a null text) has an empty set and
    is linked with nothing. Rows with the same id count as one document with all its texts. A null id takes part
    in nothing and has a null component. An empty table gives no rows; other columns are ignored.

    Tables that several steps read are written to the shared folder. The list of frequent shingles is the
    only thing that reaches the driver; it has at most ``frequent`` entries and decides on the order of elements, not on results.
    Lists above ``block_rows`` rows are compared in pairs of blocks.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    order = spark.sparkContext.broadcast(frequent_shingles(narrow, width, frequent))
    rows = written(described(narrow, width, percent, order), "shingled")
    usable = rows.filter(F.col("id").isNotNull() & (F.col("n") > 0))

    # One id stands for all rows with the same set, and one for all sets with the same prefix and size.
    reps = usable.groupBy("set_id").agg(
        F.min("id").alias("rep"), F.min("prefix_key").alias("prefix_key"), F.min("n").alias("n"), F.min("bits").alias("bits")
    )
    groups = usable.groupBy("prefix_key", "n").agg(F.min("id").alias("gid"), F.min("prefix").alias("prefix"))
    lists = written(
        listed(groups).repartition("token").sortWithinPartitions("token", "n").mapInArrow(partnered_rows(percent), LISTED), "lists"
    )
    gids = usable.groupBy("prefix_key", "n").agg(F.min("id").alias("gid"))
    members = written(reps.join(gids, ["prefix_key", "n"]).select("set_id", "rep", "gid", "n", "bits"), "members")

    # A group is compared by the set of its first id. Both rounds read these rows.
    mapped = written(lists.join(members.filter("rep = gid").select("gid", "bits"), "gid").select("token", "gid", "n", "pos", "bits"), "mapped")
    in_lists = mapped.repartition("token").sortWithinPartitions("token", "n", F.xxhash64("gid", "token"))
    near = in_lists.mapInArrow(neighbour_pairs(percent), "a bigint, b bigint, apart bigint")
    within = members.filter(F.col("rep") != F.col("gid")).select(
        F.col("gid").alias("a"), F.col("rep").alias("b"), F.lit(0).cast("bigint").alias("apart")
    )
    tried = written(near.unionByName(within).groupBy("a", "b").agg(F.min("apart").alias("apart")), "tried")

    crowded = members.groupBy("gid").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("gid")
    sets = sets_of(narrow, tried, width)
    likeliest = written(
        tried.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"), "likeliest"
    )
    found = written(connected(written(verified(likeliest, sets, percent), "links")), "components")
    others = written(across(tried.select("a", "b").join(likeliest, ["a", "b"], "left_anti"), found).select("a", "b"), "other_pairs")
    if not others.isEmpty():
        found = joined_further(found, written(verified(others, sets, percent), "links"))

    # The rows of all lists with their components; a group with several sets has a row for each, and is a list of its own.
    several = written(members.join(crowded, "gid", "left_semi").select("gid", "rep", F.col("n").alias("_n"), F.col("bits").alias("_bits")), "several")
    entries = mapped.join(several.select("gid", "rep", "_bits"), "gid", "left").select(
        "token", F.coalesce("rep", "gid").alias("rep"), "n", "pos", F.coalesce("_bits", "bits").alias("bits")
    )
    own = several.select(F.xxhash64("gid").alias("token"), "rep", F.col("_n").alias("n"), F.lit(0).alias("pos"), F.col("_bits").alias("bits"))
    labels = found.select(F.col("id").alias("rep"), "component")
    placed = entries.unionByName(own).join(labels, "rep", "left").select(
        "token", "rep", "n", "pos", F.coalesce("component", "rep").alias("component"), "bits"
    )
    sizes = entries.select("token").unionByName(own.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    long = written(sizes.filter(F.col("rows") > block_rows).select("token"), "long_lists")
    has_long = not long.isEmpty()

    short = placed.join(long, "token", "left_anti") if has_long else placed
    crossing = short.repartition("token").sortWithinPartitions("token", "n", "rep").mapInArrow(
        crossing_pairs(percent), "a bigint, b bigint"
    )
    if has_long:
        blocks = cells(placed.join(long, "token", "left_semi"), percent, block_rows).repartition("x", "y")
        in_blocks = blocks.sortWithinPartitions("x", "y", "side", "n", "rep")
        crossing = crossing.unionByName(in_blocks.mapInArrow(cell_pairs(percent), "a bigint, b bigint"))
    more = written(crossing.distinct().join(tried, ["a", "b"], "left_anti"), "crossing")
    final = found if more.isEmpty() else joined_further(found, written(verified(more, sets_of(narrow, more, width), percent), "links"))

    by_set = members.join(final, F.col("rep") == F.col("id"), "left").select(
        "set_id", F.coalesce("component", "rep").alias("component")
    )
    out = rows.select("id", "n", "set_id").join(by_set, "set_id", "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id")).cast("bigint").alias("component_id"),
    )


def one_of_each_component(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without their near copies: of each component the one with the smallest id, all columns as they came.

    Rows with the same id are one document; of them the one whose text has the smallest hash stays. Documents without words have no
    near copies and stay, and so do rows without an id.
    """
    found = similarity_components(docs, width, percent, id_col, text_col)
    # Ids that do not stay as one row are the few: they travel, and the documents stay where they are.
    stays = F.sum((F.col("doc_id") == F.col("component_id")).cast("int"))
    others = written(
        found.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_other")).agg(stays.alias("rows")).filter("rows <> 1"), "others",
    )
    own = F.col(id_col).cast("bigint") == F.col("_other")
    single = docs.filter(F.col(id_col).cast("bigint").isNotNull()).join(sent(others, "_other"), own, "left_anti")
    order = Window.partitionBy(F.col("row")[id_col]).orderBy(F.xxhash64(F.col("row")[text_col]))
    repeated = docs.join(sent(others.filter("rows > 1"), "_other"), own, "left_semi").select(F.struct(*docs.columns).alias("row"))
    chosen = repeated.withColumn("at", F.row_number().over(order)).filter("at = 1").select("row.*")
    return single.unionByName(chosen).unionByName(docs.filter(F.col(id_col).isNull()))
