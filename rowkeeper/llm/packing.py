"""Packing documents into sequences of a fixed size.

Only the number of pieces of each length matters for the packing, and there are no more lengths than tokens in a
sequence. So the packing is planned on that histogram, whatever the size of the corpus: first the sets that dominate every
other choice for a piece are fixed for good (Martello and Toth), then the rest is packed best fit, longest first.
The plan is a short list of runs, each a number of sequences with the same lengths in them. Spark then numbers the pieces of each
length and puts piece number k into the k-th place that the plan has for its length.
"""

from __future__ import annotations

import bisect
import json
import math
import os
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowkeeper.llm.common import MAX_CACHED_LENGTH, give_back
from rowkeeper.llm.tokens import BYTE_LEVEL_WORDS, MergeCounter, byte_symbols, chunks_of
from rowkeeper.session import written

BUCKET_ROWS = 65_536  # pieces of one length that one task numbers
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"

REMEMBERED = 300_000  # words or chunks that a worker remembers; the older half goes beyond
MARKS = 2**21  # bytes that mark by hash which words a worker has met; many come once and are not worth remembering
#: Texts encoded together: more share more words, and long ones take more memory.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1_024, 2**20

#: Characters that have long been letters, digits, white space or none of these; the libraries may be of different Unicode versions beyond.
SETTLED = re.compile("[\0-\u024f]*")

_encoders: dict[tuple[str, bool], "Encoder"] = {}


@dataclass
class Run:
    """``copies`` sequences that hold pieces of these lengths, in this order."""

    copies: int
    lengths: tuple[int, ...]


class Encoder:
    """Identifiers of texts as little-endian bytes; what the tokenizers library said of a chunk is remembered when it comes again.

    Most texts are words with one space or line feed between them. Such a text is split at its spaces, and a word stands for the
    chunk of a space and the word; other texts are cut into the chunks of ``chunks_of``. New words of Latin letters go through tiktoken when
    ``ranked`` says that the vocabulary merges by rank (``merges_by_rank``), as it gives the same identifiers in a third of the time.
    """

    def __init__(self, path: str, ranked: bool = False):
        # Spark runs a worker per core; threads of the library beside it only wait.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a token has a character per byte
        for token, at in vocabulary.items():
            self.sizes[at] = len(token)
        self.ranked = None
        if ranked:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks_of(path), special_tokens={})
        # By word after a space (or with its line feed), and by chunk as it stands.
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.met = bytearray(MARKS)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def fresh(self, words: list[str]) -> list[bytes]:
        """Identifiers of new words after a space, or with their line feed."""
        if self.ranked is None:
            return self.joined(words, self.one)
        found: dict[str, bytes] = {}
        old = [w for w in words if SETTLED.fullmatch(w)]
        if old:
            found.update(zip(old, self.joined(old, self.ranked.encode_ordinary)))
        new = [w for w in words if w not in found]
        if new:
            found.update(zip(new, self.joined(new, self.one)))
        return [found[w] for w in words]

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def joined(self, words: list[str], encode) -> list[bytes]:
        """Identifiers of words that are encoded as one text, which is quicker.

        No token crosses from one into the next; the bytes of the tokens tell where each ends.
        """
        text = "".join([w if w[0] == "\n" else " " + w for w in words])
        ids = np.asarray(encode(text), "<u4")
        ends = np.cumsum(self.sizes[ids])
        # A space or line feed stands at the start of each word and nowhere else.
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        bounds = np.append(np.flatnonzero((data == 32) | (data == 10))[1:], len(data))
        stops = np.searchsorted(ends, bounds) + 1
        if len(bounds) != len(words) or stops[-1] > len(ids) or not np.array_equal(ends[stops - 1], bounds):
            return self.whole([w if w[0] == "\n" else " " + w for w in words])
        coded, marks = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [coded[i:j] for i, j in zip(marks, marks[1:])]

    def _found(self, known: dict[str, bytes], wanted: list[str], find) -> list[bytes]:
        """Identifiers of each wanted key; keys of earlier calls are remembered unless they are very long."""
        if len(known) >= REMEMBERED:
            newer = list(islice(known.items(), len(known) // 2, None))
            known.clear()
            known.update(newer)
        found = list(map(known.get, wanted))
        missing = [at for at, ids in enumerate(found) if ids is None]
        if missing:
            new = list({wanted[at] for at in missing})
            fresh = dict(zip(new, find(new)))
            met, marks = self.met, len(self.met)
            for key, ids in fresh.items():
                mark = hash(key) % marks
                if not met[mark]:
                    met[mark] = 1
                elif len(key) <= MAX_CACHED_LENGTH and len(known) < REMEMBERED:
                    known[key] = ids
            for at in missing:
                found[at] = fresh[wanted[at]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        words: list[str] = []
        chunks: list[str] = []
        ends, others = [], set()
        for at, text in enumerate(texts):
            if any(t in text for t in self.added):
                others.add(at)
            else:
                spaced = text.replace("\n", " \n").split(" ")
                if plainly_spaced(text, spaced):
                    chunks.append(spaced[0])  # nothing stands before the first word
                    del spaced[0]
                    words += spaced
                else:
                    chunks += chunks_of(text)
            ends.append((len(chunks), len(words)))
        of_chunks = self._found(self.chunks, chunks, self.whole)
        of_words = self._found(self.words, words, self.fresh)
        out, (a, b) = [], (0, 0)
        for at, (c, d) in enumerate(ends):
            out.append(self.whole([texts[at]])[0] if at in others else b"".join(of_chunks[a:c] + of_words[b:d]))
            a, b = c, d
        return out


def plainly_spaced(text: str, spaced: list[str]) -> bool:
    """Whether the text is words with exactly one space or line feed between them and no other white space.

    ``spaced`` are its words, a line feed with the one that follows.
    """
    if "" in spaced or "\n" in spaced:
        return False
    # Of all white space, only the space is printable.
    if text.replace("\n", "").isprintable():
        return True
    words = text.split()
    return len(words) == len(spaced) and sum(map(len, words)) + len(words) - 1 == len(text)


def text_groups(batches):
    """Ids and texts of Arrow batches, as many at once as the bounds allow but at least one."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            reach = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, "right"))
            n = max(1, min(reach - at, TEXTS_AT_ONCE))
            yield ids.slice(at, n).to_pylist(), texts.slice(at, n).to_pylist()
            at += n


def ranks_of(path: str) -> dict[bytes, int]:
    """Identifier of each token of a byte-level vocabulary, by its bytes."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte = byte_symbols()
    return {bytes(byte[c] for c in token): at for token, at in vocabulary.items()}


def merges_by_rank(path: str) -> bool:
    """Whether merging the pair that makes the lowest identifier gives the tokens of the vocabulary's own list of merges.

    It does when the merges are in the order of the identifiers they make and every token is made from its bytes by them. Suppose the two
    ways part first at a pair that makes token t by identifier but is no merge of the list. No merge crossed the ends of t so far,
    so what lies between them is what the list makes of the bytes of t alone before its last merge, which is the one
    pair of the list that makes t.
    """
    try:
        merger = MergeCounter(path)
        ranks = ranks_of(path)
    except (KeyError, ValueError):
        return False
    if any(a >= b for a, b in zip(merger.merged, merger.merged[1:])):
        return False
    return len(merger.rank) == len(merger.merged) and all(merger.merge_count(token) == 1 for token in ranks)


def encoder(path: str, ranked: bool = False) -> Encoder:
    """One per worker."""
    if (path, ranked) not in _encoders:
        _encoders[path, ranked] = Encoder(path, ranked)
    return _encoders[path, ranked]


def piece_starts(n: int, size: int) -> list[int]:
    """Where the pieces of a document of ``n`` tokens begin: all but the first have the full size."""
    first = n % size or size
    return [0, *range(first, n, size)]


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The token pieces of each document, with a checksum of their identifiers, and ``slot``, a running number in the task.

    Equal rows have different slots, so no identifier gathers rows in one place.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    ranked = merges_by_rank(path)

    def cut(batches):
        give_back()  # what earlier stages left in this worker
        encode, slot = encoder(path, ranked).encode, 0
        for ids, texts in text_groups(batches):
            rows = []
            for doc_id, encoded in zip(ids, encode([t or "" for t in texts])):
                encoded += end
                n = len(encoded) // 4
                starts = piece_starts(n, size)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(encoded[4 * a : 4 * b])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 5
            slots = pa.array(np.arange(slot, slot + len(rows), dtype=np.int64))
            slot += len(rows)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, k) for c, k in zip(columns, kinds)], slots], ["doc_id", "piece", "start", "length", "ids_crc32", "slot"]
            )

    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{text_col}` AS text")
    return narrow.mapInArrow(cut, f"{PIECES}, slot bigint")


def best_pair(lengths: list[int], counts: Counter, room: int) -> int:
    """The largest sum of two pieces that fits, 0 if none does."""
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room:
            high -= 1
        elif low == high:
            return max(best, total) if counts[lengths[low]] > 1 else best
        else:
            best, low = max(best, total), low + 1
    return best


def reduce_by_dominance(counts: Counter, size: int) -> list[Run]:
    """Fix the sets that dominate every other way to place their longest piece; takes them out of ``counts``.

    For a piece and the room it leaves, a set dominates when each alternative could be exchanged for it without
    another sequence: alone, if nothing fits beside it; with the largest piece that fits, if that fills the
    room, if no two pieces fit, or if at most two fit and no two of them fill more than the one.
    """
    runs: list[Run] = []
    changed = True
    while changed:
        changed = False
        for longest in sorted(counts, reverse=True):
            while counts[longest] > 0:
                counts[longest] -= 1
                present = sorted(n for n, c in counts.items() if c > 0)
                room = size - longest
                fitting = present[: bisect.bisect_right(present, room)]
                counts[longest] += 1
                if not fitting:
                    here = counts[longest]
                    runs.append(Run(here, (longest,)))
                    counts[longest] -= here
                    changed = True
                    continue
                partner, least = fitting[-1], fitting[0]
                second = least if counts[least] - (least == longest) > 1 else (fitting[1] if len(fitting) > 1 else size)
                third = least if counts[least] - (least == longest) > 2 else None
                if third is None:
                    flat = [n for n in fitting[:3] for _ in range(min(3, counts[n] - (n == longest)))]
                    third = flat[2] if len(flat) > 2 else size
                one_fits = least + second > room
                two_fit = not one_fits and least + second + third > room
                sure = partner == room or one_fits
                if not sure and two_fit:
                    counts[longest] -= 1
                    sure = best_pair(fitting, counts, room) <= partner
                    counts[longest] += 1
                if not sure:
                    break
                if partner == longest:
                    here = counts[longest] // 2
                    counts[longest] -= 2 * here
                else:
                    here = min(counts[longest], counts[partner])
                    counts[longest] -= here
                    counts[partner] -= here
                runs.append(Run(here, (longest, partner)))
                changed = True
        for n in [n for n, c in counts.items() if c == 0]:
            del counts[n]
    return runs


def best_fit(counts: Counter, size: int) -> list[Run]:
    """Longest first, each piece into the fullest sequence that has room; equal sequences are handled together."""
    by_room: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def put(room: int, run: Run) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(run)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                run = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                room, run = size, Run(left, ())
            # The sequence just filled stays the best fit while it has room for one more.
            each = min(room // length, left)
            filled = min(run.copies, left // each)
            if run.copies > filled and run.lengths:
                put(room, Run(run.copies - filled, run.lengths))
            put(room - each * length, Run(filled, run.lengths + (length,) * each))
            left -= filled * each
    return [run for runs in by_room.values() for run in runs]


def plan_packing(counts: dict[int, int], size: int) -> list[Run]:
    left = Counter({n: c for n, c in counts.items() if c})
    fixed = reduce_by_dominance(left, size)
    return fixed + best_fit(left, size)


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """Per length, in the order of the pieces' numbers: from which number on, first sequence, offset in it."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length in run.lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += run.copies
            offset += length
        sequence += run.copies
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), columns))


def numbered_by_length(pieces: DataFrame, most: int) -> DataFrame:
    """Add ``number``, from 0 within each length; a frequent length is numbered in buckets, in many tasks.

    Buckets follow the slots, which are written with the pieces, so they fill evenly whatever the identifiers are.
    """
    buckets = max(1, math.ceil(most / BUCKET_ROWS))
    spread = pieces.withColumn("bucket", F.pmod(F.col("slot"), F.lit(buckets)))
    # A row per length and bucket.
    counted = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start", "slot")
    joined = spread.join(base, ["length", "bucket"])
    return joined.withColumn("number", F.col("base") + F.row_number().over(own) - 1).drop("bucket", "base")


def pack_documents(
    docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece with its sequence and its offset there; sequences have no gaps.

    A document is the identifiers of its text and then ``end_id``; only longer ones are cut, into pieces of ``size`` with
    the shorter one first. A null text counts as empty. Repeated rows and null identifiers are packed like
    others; an empty table gives no rows; other columns are ignored.

    The pieces are written to the shared folder once, so that texts are encoded once. At most ``size`` counts reach
    the driver, and the plan has a few thousand runs at any corpus size.
    """
    pieces = written(pieces_of(docs, path, size, end_id, id_col, text_col), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = places(plan_packing(counts, size))
    # Places of one length follow each other, so a length and a number are found by one search.
    reach = np.int64(max(counts.values(), default=0) + 1)
    key = plan["length"] * reach + plan["first"]

    def place(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            length, number = (rows[c].to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, length * reach + number, "right") - 1
            sequence = plan["sequence"][at] + number - plan["first"][at]
            rows = rows.drop_columns(["number"]).append_column("sequence_id", pa.array(sequence, pa.int64()))
            rows = rows.append_column("offset", pa.array(plan["offset"][at], pa.int64()))
            yield from rows.to_batches()

    numbered = numbered_by_length(pieces, max(counts.values(), default=0))
    names = [c.strip().split(" ")[0] for c in PIECES.split(",")]
    return numbered.select(*names, "number").mapInArrow(place, PACKED)
