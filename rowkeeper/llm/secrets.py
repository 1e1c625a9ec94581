"""Secret scan: known forms of secrets, and random strings found by their token efficiency.

Vocabularies are made from written language, so words take few tokens and random strings many. Every run of characters that gives
at most MOST_CHARS_PER_TOKEN characters per token is reported, unless it is something public: a digest of a usual
length, a UUID, a run without letters, or a name whose parts are cheap in tokens once its separators are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from rowkeeper.llm.common import rows_of

#: The known forms, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

#: Lengths of hexadecimal digests in use (MD5, SHA-1, SHA-2 family), and the word pattern of the vocabulary.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MOST_CHARS_PER_TOKEN = 2.0
LEAST_RANDOM = 20

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

# ASCII letters match in either case in the first form; the class of its second group holds both anyway.
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run of at least so many characters is what the plain form finds and keeps, as both take whole runs.
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SUBWORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")

_encoders: dict[str, object] = {}


def vocabulary(path: str):
    """The encoding of a vocabulary file of ranks; one per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


@dataclass
class Scanner:
    """Spans of secrets in a text: (start, kind, end) by code point, end exclusive."""

    path: str
    most: float = MOST_CHARS_PER_TOKEN
    #: Strings that are public although they look random.
    known: frozenset[str] = field(default_factory=frozenset)

    def public(self, run: str) -> bool:
        """Known strings, digests, UUIDs, numbers and rules of dashes."""
        if run in self.known or _UUID.fullmatch(run):
            return True
        if _DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS:
            return True
        return not any(c.isalpha() for c in run)

    def inefficient(self, run: str) -> bool:
        """Few characters per token, and not only because of the separators between the parts of a name."""
        encode = vocabulary(self.path).encode_ordinary
        if len(run) > self.most * len(encode(run)):
            return False
        parts = [p for p in _SUBWORDS.findall(run) if p.isalnum()]
        return sum(map(len, parts)) <= self.most * sum(len(encode(p)) for p in parts)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [
            (m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED
        ]
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def random(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Runs with few characters per token; a run that known forms cover from end to end is left out."""
        found = []
        for m in _RUN.finditer(text):
            start, end = m.span()
            at = start  # the first character that no known form covers; base is sorted by start
            for a, _, b in base:
                if a <= at < b:
                    at = b
            if at < end and not self.public(m.group()) and self.inefficient(m.group()):
                found.append((start, 3, end))
        return found

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The spans of known forms, and all spans."""
        base = self.base(text)
        return base, sorted(base + self.random(text, base))

    def redacted(self, text: str, mark: str) -> str:
        """The text with each secret, overlapping ones as one, replaced by the mark."""
        parts, at = [], 0
        for start, _, end in self.scan(text)[1]:
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join(parts) + text[at:] if parts else text


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(
    docs: DataFrame, path: str, most: float = MOST_CHARS_PER_TOKEN, known: frozenset[str] = frozenset(),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: how many spans each known form has, their digest, and all spans as text.

    ``path`` names a file of ranks that every executor has; ``known`` are public strings never to be reported, a short list.
    One row per input row, repeated and null ids included; a null text counts as empty and has no spans; other columns
    are ignored. One pass, no shuffle.
    """
    scanner = Scanner(path, most, known)

    def scanned(batches):
        for ids, texts in rows_of(batches, "id", "text"):
            counts, digests, spans = [[], [], []], [], []
            for text in texts:
                base, every = scanner.scan(text or "")
                for kind in range(3):
                    counts[kind].append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(written_spans(base).encode()).hexdigest())
                spans.append(written_spans(every))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                ],
                [c.strip().split(" ")[0] for c in SCHEMA.split(",")],
            )

    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{text_col}` AS text")
    return narrow.mapInArrow(scanned, SCHEMA)


def redact_secrets(
    docs: DataFrame, path: str, mark: str = "[secret]", most: float = MOST_CHARS_PER_TOKEN,
    known: frozenset[str] = frozenset(), text_col: str = "text",
) -> DataFrame:
    """The documents with every secret in their text replaced; a null text stays null, other columns stay as they are."""
    scanner = Scanner(path, most, known)
    at = docs.columns.index(text_col)

    def redact(batches):
        for batch in batches:
            texts = [None if t is None else scanner.redacted(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(redact, docs.schema)
