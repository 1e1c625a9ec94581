"""Token counts by byte-pair merging, without making tokens.

The text is cut into chunks of white space and what follows it up to the next white space. No token of a byte-level
vocabulary crosses from other characters into white space, so a chunk has the same tokens wherever it stands, and the
count of a chunk met before is looked up. A new chunk is merged: its bytes are a linked list of symbols, a heap holds the adjacent
pairs by rank, and the pair of lowest rank is popped and merged until none is left. Symbols minus merges is the count.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rowkeeper.llm.common import MAX_CACHED_LENGTH, MAX_CACHED_WORDS, rows_of

#: Characters with the Unicode property White_Space, and the word pattern of byte-level vocabularies.
WHITE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

_loaded: dict[str, "MergeCounter"] = {}


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def chunks_of(text: str) -> list[str]:
    return CHUNK.findall(text)


class MergeCounter:
    """Counts tokens of texts under a byte-level pair vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level pair vocabulary: {odd or model['type']}")
        if splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("the vocabulary splits texts in another way")
        vocabulary = model["vocab"]
        self.size = max(vocabulary.values()) + 1
        self.of_byte = [0] * 256
        for symbol, byte in byte_symbols().items():
            self.of_byte[byte] = vocabulary[symbol]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(vocabulary[left] * self.size + vocabulary[right], rank)
            self.merged.append(vocabulary[left + right])
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take more than their own text are not supported")
        self.added = [t["content"] for t in sorted(added, key=lambda t: -len(t["content"]))]
        self.added_pattern = regex.compile("|".join(map(regex.escape, self.added))) if added else None
        self.words = regex.compile(BYTE_LEVEL_WORDS)
        self.known: dict[str, int] = {}

    def merge_count(self, word: bytes) -> int:
        """Symbols that are left when no adjacent pair can be merged."""
        symbols = [self.of_byte[b] for b in word]
        n, size, rank_of = len(symbols), self.size, self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            rank = rank_of(symbols[at] * size + symbols[at + 1])
            if rank is not None:
                heap.append(rank * n + at)
        heapify(heap)
        merges = 0
        while heap:
            rank, at = divmod(heappop(heap), n)
            right = after[at]
            # An entry is stale once either of its symbols has taken part in another merge.
            if right >= n or symbols[at] < 0 or rank_of(symbols[at] * size + symbols[right]) != rank:
                continue
            symbols[at], symbols[right] = self.merged[rank], -1
            merges += 1
            following = after[at] = after[right]
            if following < n:
                before[following] = at
                rank = rank_of(symbols[at] * size + symbols[following])
                if rank is not None:
                    heappush(heap, rank * n + at)
            previous = before[at]
            if previous >= 0:
                rank = rank_of(symbols[previous] * size + symbols[at])
                if rank is not None:
                    heappush(heap, rank * n + previous)
        return n - merges

    def chunk_count(self, chunk: str) -> int:
        return sum(self.merge_count(w.encode("utf-8")) for w in self.words.findall(chunk))

    def count(self, text: str) -> int:
        if self.added_pattern and any(t in text for t in self.added):
            parts = self.added_pattern.split(text)
            return len(parts) - 1 + sum(self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        total, known = 0, self.known
        for chunk in chunks_of(text):
            found = known.get(chunk)
            if found is None:
                found = self.chunk_count(chunk)
                if len(chunk) <= MAX_CACHED_LENGTH:
                    if len(known) >= MAX_CACHED_WORDS:
                        known.clear()
                    known[chunk] = found
            total += found
        return total


def counter(path: str) -> MergeCounter:
    """One per worker."""
    if path not in _loaded:
        _loaded[path] = MergeCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each text, and whether the tokens exceed ``limit``.

    ``path`` names a vocabulary file that every executor has. One row per input row, repeated and null identifiers
    included; a null text counts as empty (0 bytes, 0 tokens); other columns are ignored. The text of an added
    token inside a text is one token. No shuffle; a worker holds one batch, the vocabulary and a bounded cache.
    """

    def counted(batches):
        count = counter(path).count
        for ids, texts in rows_of(batches, "id", "text"):
            texts = [t or "" for t in texts]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{text_col}` AS text")
    return narrow.mapInArrow(counted, SCHEMA)
