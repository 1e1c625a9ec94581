"""Substring deduplication: repeated windows of words, found in groups of memory size by prefix doubling; no tree is built.

A suffix starts at each word; only its first ``window`` words matter, as a node of the suffix tree that deep is a repeat long enough.
Suffixes are divided so that equal windows are in one group. A group's key is the short run of words (a gram)
with the lowest hash in the window: equal windows have the same one, and the windows next to each other mostly
too, so they travel together as one segment of words. Segments whose gram occurs in one document only are never sent.

A group that fits into memory becomes a subtree: its suffixes are told apart by prefixes of 1, 2, 4, ... words, up to the
window, and a suffix leaves as soon as its prefix is found in one document only. What is left at the full depth are the deep
nodes with several documents. For a group with too many segments or words, the prefix is taken at full length at once: each window is a row with a hash of its
words, and counting those is an aggregation, which no large group can hold up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkeeper.llm.common import mixed, rows_of, window_hashes, word_hashes, words_of
from rowkeeper.session import written

WINDOW = 50
GRAM = 8
GROUP_SEGMENTS = 20_000  # segments of a group that a task takes as one subtree
GROUP_WORDS = 1_000_000  # words in the segments of such a group; a segment of periodic text can be as long as its document
WORDS_AT_ONCE = 500_000  # words of segments, or windows, that a task gives away together
TREE_WORDS = 1_000_000  # smaller groups share a tree up to this size

KEYED = "id bigint, th bigint, key bigint, segments bigint, words bigint"
SEGMENTS = "id bigint, th bigint, key bigint, start int, words binary"
REMOVED = "id bigint, th bigint, first int, stop int"
WINDOWS = "id bigint, th bigint, start int, k1 bigint, k2 bigint"


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by windows that double."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def window_keys(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The key of each window: the lowest gram hash in it."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    return sliding_least(window_hashes(hashes, gram), window - gram + 1)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(keys))


def keyed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The distinct keys of each document, with the number of their segments in it and of the words in these."""

    def find(batches):
        for ids, marks, texts in rows_of(batches, "id", "th", "text"):
            keys, counts, words, rows = [], [], [], []
            for row, text in enumerate(texts):
                own = window_keys(word_hashes(words_of(text)), window, gram)
                starts, ends = runs_of(own)
                values, at, times = np.unique(own[starts], return_inverse=True, return_counts=True)
                sizes = np.zeros(len(values), np.int64)
                np.add.at(sizes, at, ends - starts + window - 1)
                keys.append(values.view(np.int64))
                counts.append(times.astype(np.int64))
                words.append(sizes)
                rows.append(np.full(len(values), row))
            at = np.concatenate(rows).astype(int)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(ids, np.int64)[at]), pa.array(np.array(marks, np.int64)[at]),
                    pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(words)),
                ],
                ["id", "th", "key", "segments", "words"],
            )

    return docs.mapInArrow(find, KEYED)


def segment_cutter(window: int, gram: int):
    """The segments of each document whose key is in its list; a document without a list has a null text too."""

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "th", "key", "start", "words"]
        )

    def cut(batches):
        for ids, marks, texts, wanted in rows_of(batches, "id", "th", "text", "wanted"):
            rows, size = [], 0
            for doc_id, mark, text, chosen in zip(ids, marks, texts, wanted):
                if not chosen:
                    continue
                words = word_hashes(words_of(text))
                own = window_keys(words, window, gram).view(np.int64)
                starts, ends = runs_of(own)
                here = np.isin(own[starts], np.array(chosen, np.int64))
                for a, b in zip(starts[here].tolist(), ends[here].tolist()):
                    rows.append((doc_id, mark, int(own[a]), a, words[a : b + window - 1].tobytes()))
                    size += b - a + window - 1
                if size >= WORDS_AT_ONCE:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    return cut


def classes(first: np.ndarray, second: np.ndarray | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number the pairs of prefixes; -1 where one document alone has it. Also the least id of each."""
    order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
    a = first[order]
    new = a[1:] != a[:-1]
    if second is not None:
        b = second[order]
        new = new | (b[1:] != b[:-1])
    starts = np.flatnonzero(np.concatenate([[True], new]))
    low, high = np.minimum.reduceat(ids[order], starts), np.maximum.reduceat(ids[order], starts)
    number = np.empty(len(first), np.int64)
    number[order] = np.repeat(np.where(low < high, np.arange(len(starts)), -1), np.diff(np.append(starts, len(first))))
    return number, low


def repeats(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """For each place in the segments that lie behind each other in ``words``: whether the window that
    starts there is also in a document with a smaller id. ``ids`` are the documents of the segments.
    """
    owner = np.repeat(ids, lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))  # words up to the end of the segment
    out = np.zeros(len(words), bool)
    if not len(words):
        return out
    prefix, _ = classes(words, None, owner)  # node of the first ``depth`` words at each place
    depth = 1
    while depth < window:
        step = min(depth, window - depth)  # the second half may overlap the first
        at = np.flatnonzero((prefix >= 0) & (room >= depth + step))
        at = at[prefix[at + step] >= 0]
        following = np.full(len(words), -1, np.int64)
        if len(at):
            number, low = classes(prefix[at], prefix[at + step], owner[at])
            following[at] = number
            if depth + step == window:
                deep = number >= 0
                out[at[deep]] = owner[at[deep]] > low[number[deep]]
        prefix, depth = following, depth + step
    return out


def covered_ranges(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Ranges of words covered by windows that begin at these places, which ascend."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    firsts = starts[np.concatenate([[0], breaks + 1])]
    lasts = starts[np.append(breaks, len(starts) - 1)]
    return list(zip(firsts.tolist(), (lasts + window).tolist()))


def tree_ranges(window: int):
    """Covered ranges of words from segments, which come sorted by key; groups share a tree up to TREE_WORDS."""

    def solve(held):
        ids, marks, starts, texts = (list(c) for c in zip(*held))
        lengths = np.array([len(t) // 8 for t in texts])
        found = repeats(np.array(ids, np.int64), lengths, np.frombuffer(b"".join(texts), np.uint64), window)
        rows, at = [], 0
        for doc_id, mark, start, length in zip(ids, marks, starts, lengths.tolist()):
            here = np.flatnonzero(found[at : at + length])
            rows += [(doc_id, mark, start + a, start + b) for a, b in covered_ranges(here, window)]
            at += length
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "th", "first", "stop"])

    def trees(batches):
        held, size, last = [], 0, None
        for ids, marks, keys, starts, words in rows_of(batches, "id", "th", "key", "start", "words"):
            for doc_id, mark, key, start, text in zip(ids, marks, keys, starts, words):
                if size >= TREE_WORDS and key != last:
                    yield solve(held)
                    held, size = [], 0
                held.append((doc_id, mark, start, text))
                size += len(text) // 8
                last = key
        if held:
            yield solve(held)

    return trees


def hashed_windows(window: int):
    """A row per window of a segment, with 128 bits of hash of its words."""

    def batch_of(parts):
        kinds = [np.int64, np.int64, np.int32, np.int64, np.int64]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(p) if p else np.zeros(0, k)) for p, k in zip(parts, kinds)], ["id", "th", "start", "k1", "k2"]
        )

    def spread(batches):
        for ids, marks, starts, words in rows_of(batches, "id", "th", "start", "words"):
            parts, size = [[], [], [], [], []], 0
            for doc_id, mark, start, text in zip(ids, marks, starts, words):
                hashes = np.frombuffer(text, np.uint64)
                k1, k2 = window_hashes(hashes, window), window_hashes(mixed(hashes), window)
                n = len(k1)
                for part, values in zip(parts, (
                    np.full(n, doc_id, np.int64), np.full(n, mark, np.int64), np.arange(start, start + n, dtype=np.int32),
                    k1.view(np.int64), k2.view(np.int64),
                )):
                    part.append(values)
                size += n
                if size >= WORDS_AT_ONCE:
                    yield batch_of(parts)
                    parts, size = [[], [], [], [], []], 0
            yield batch_of(parts)

    return spread


def repeated_ranges(rows: DataFrame, window: int, gram: int, group_segments: int, group_words: int) -> DataFrame:
    """Ranges of words (``first``, ``stop``) of rows ``id``, ``th``, ``text`` that repeat a document with a smaller id."""
    usable = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    keys = written(keyed(usable, window, gram), "keys")
    shared = keys.groupBy("key").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.sum("segments").alias("n"), F.sum("words").alias("size")
    ).filter("low < high").select("key", "n", "size")
    is_small = (F.col("n") <= group_segments) & (F.col("size") <= group_words)
    wanted = written(
        keys.join(shared, "key").groupBy("id", "th").agg(
            F.collect_set(F.when(is_small, F.col("key"))).alias("small"),
            F.collect_set(F.when(~is_small, F.col("key"))).alias("large"),
        ), "wanted",
    )
    # The same left join as the caller's: texts are then shuffled once for all.
    joined = rows.join(wanted, ["id", "th"], "left")

    def texts(keys: str) -> DataFrame:
        needed = F.when(F.size(keys) > 0, F.col("text")).alias("text")
        return joined.select("id", "th", needed, F.col(keys).alias("wanted"))

    cut, hashed = segment_cutter(window, gram), hashed_windows(window)
    segments = texts("small").mapInArrow(cut, SEGMENTS)
    ranges = segments.repartition("key").sortWithinPartitions("key").mapInArrow(tree_ranges(window), REMOVED)
    if wanted.filter(F.size("large") > 0).isEmpty():
        return ranges
    # Long segments never become rows of Spark on this way.
    windows = written(texts("large").mapInArrow(lambda batches: hashed(cut(batches)), WINDOWS), "windows")
    nodes = windows.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    large = windows.join(nodes.select("k1", "k2", "low"), ["k1", "k2"]).filter("id > low").select(
        "id", "th", F.col("start").alias("first"), (F.col("start") + window).cast("int").alias("stop")
    )
    return ranges.unionByName(large)


def kept_words(words: list, ranges: list[tuple[int, int]]) -> list:
    kept, at = [], 0
    for first, stop in sorted(ranges):
        kept += words[at:first]
        at = max(at, stop)
    return kept + words[at:]


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    group_segments: int = GROUP_SEGMENTS, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` of each row.

    Words lie between ASCII white space. A word is removed if a window of ``window`` consecutive words
    that covers it also starts in a document with a smaller id; windows are those of the input. Kept words are joined
    by one space. A null text has no words. Rows with the same id never remove words from each other, and a row without an id
    neither loses words nor removes any. Repeated rows get equal results. An empty table gives no rows; other columns
    are ignored. Windows are compared by 64-bit hashes of all their words (128 bits of the whole in large groups).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(rows, window, gram, group_segments, group_words)
    by_row = ranges.groupBy("id", "th").agg(F.collect_list("first").alias("firsts"), F.collect_list("stop").alias("stops"))

    def cut(batches):
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        for ids, texts, firsts, stops in rows_of(batches, "id", "text", "firsts", "stops"):
            counts, removed, kept = [], [], []
            for text, a, b in zip(texts, firsts, stops):
                words = words_of(text)
                left = kept_words(words, list(zip(a, b))) if a else words
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names,
            )

    joined = rows.join(by_row, ["id", "th"], "left").select("id", "text", "firsts", "stops")
    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
