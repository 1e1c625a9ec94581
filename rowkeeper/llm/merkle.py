"""Document fingerprints: Merkle trees over sections, paragraphs and chunks of a text.

Leaves are chunks of a paragraph, cut where a hash of the bytes just before says so: an edit moves no cut but those next
to it. Chunks are finer at the start of a text, so that short texts have enough of them. A line is a paragraph; a section ends at an empty line or after a paragraph whose hash says so. Each node is
the hash of its children, the root also of the length. Equal roots mean equal texts; where roots differ, walking down the
differing branches finds the edited chunks.

A fingerprint is text: the root, a colon, then the sections with ``/`` between them, the paragraphs in a section with
``;``, the leaves in a paragraph with ``,``. A leaf is its hash, a dot and its bytes in hexadecimal. Inner nodes follow
from the leaves.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeeper.llm.common import rows_of, window_hashes

CONTEXT = 8  # bytes before a cut that decide on it
FINEST, COARSEST = 4, 7  # a chunk has 2**4 bytes on average at the start of a text and 2**7 from FINE_BYTES * 7 on
FINE_BYTES = 128
SECTION_EVERY = 8  # paragraphs of a section, on average
RANGES_PER_TASK = 2
DISTINCT = 10_000  # accuracy of the range bounds

SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def node(children: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(np.asarray(children, "<u8").tobytes())


@dataclass
class Tree:
    """Sections of paragraphs of leaves; a leaf is (hash, bytes)."""

    sections: list[list[list[tuple[int, int]]]]

    def leaves(self) -> list[tuple[int, int]]:
        return [leaf for section in self.sections for paragraph in section for leaf in paragraph]

    def size(self) -> int:
        return sum(n for _, n in self.leaves())

    def root(self) -> int:
        return node([self.size(), *(section_node(s) for s in self.sections)])

    def text(self) -> str:
        parts = "/".join(";".join(",".join(f"{h:016x}.{n:x}" for h, n in p) for p in s) for s in self.sections)
        return f"{self.root():016x}:{parts}"


def paragraph_node(paragraph: list[tuple[int, int]]) -> int:
    return node([x for leaf in paragraph for x in leaf])


def section_node(section: list[list[tuple[int, int]]]) -> int:
    return node([paragraph_node(p) for p in section])


def tree_of(text: str) -> Tree:
    """The tree of a text; every byte is in one leaf. An empty text has no sections."""
    data = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(data, np.uint8)
    lines = np.flatnonzero(codes == 10) + 1
    # A context that reaches into the paragraph before would make its edits move cuts here, so it is left out.
    hashes = window_hashes(codes.astype(np.uint64) + np.uint64(1), CONTEXT)
    bits = np.minimum(FINEST + np.log2(1 + np.arange(len(hashes)) // FINE_BYTES).astype(int), COARSEST)
    cuts = np.flatnonzero(hashes >> (64 - bits).astype(np.uint64) == 0) + CONTEXT
    if len(lines) and len(cuts):
        line_before = np.concatenate([[0], lines])[np.searchsorted(lines, cuts - 1, "right")]
        cuts = cuts[cuts - line_before >= CONTEXT]
    ends = np.unique(np.concatenate([lines, cuts, [len(data)]])) if data else np.zeros(0, int)
    line_ends = set(lines.tolist()) | {len(data)}
    sections, section, paragraph, start = [], [], [], 0
    for end in ends.tolist():
        if end > start:
            paragraph.append((xxhash.xxh3_64_intdigest(data[start:end]), end - start))
        if end in line_ends:
            if paragraph:
                section.append(paragraph)
                size = sum(n for _, n in paragraph)
                if size == 1 or paragraph_node(paragraph) % SECTION_EVERY == 0:
                    sections.append(section)
                    section = []
            paragraph = []
        start = end
    if section:
        sections.append(section)
    return Tree(sections)


def parsed(fingerprint: str) -> Tree:
    body = fingerprint.split(":", 1)[1]
    if not body:
        return Tree([])

    def leaf(text: str) -> tuple[int, int]:
        hashed, n = text.split(".")
        return int(hashed, 16), int(n, 16)

    return Tree([[[leaf(x) for x in p.split(",")] for p in s.split(";")] for s in body.split("/")])


def likeness(a: Tree, b: Tree) -> float:
    """Share of the bytes of both that are in leaves they have in common; 1 for two empty texts."""
    total = a.size() + b.size()
    if not total:
        return 1.0
    common = Counter(a.leaves()) & Counter(b.leaves())
    return 2 * sum(n * times for (_, n), times in common.items()) / total


def edited_spans(old: str, new: str) -> list[tuple[int, int]]:
    """Byte ranges of the new text that the old one does not have, from the two fingerprints alone.

    Branches with a node that the old tree has too are passed over whole.
    """
    before, after = parsed(old), parsed(new)
    if before.root() == after.root():
        return []
    sections = {section_node(s) for s in before.sections}
    paragraphs = {paragraph_node(p) for s in before.sections for p in s}
    leaves = set(before.leaves())
    spans, at = [], 0
    for section in after.sections:
        same_section = section_node(section) in sections
        for paragraph in section:
            same = same_section or paragraph_node(paragraph) in paragraphs
            for leaf in paragraph:
                if not same and leaf not in leaves:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + leaf[1])
                    else:
                        spans.append((at, at + leaf[1]))
                at += leaf[1]
    return spans


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each text; a null text counts as empty. One pass, no shuffle."""

    def mapped(batches):
        for ids, texts in rows_of(batches, "id", "text"):
            found = [tree_of(t or "").text() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["doc_id", "fingerprint"]
            )

    narrow = docs.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{text_col}` AS text")
    return narrow.mapInArrow(mapped, "doc_id bigint, fingerprint string")


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the cuts, which descend, are at or above the value; all of them for a null. By halving."""
    points = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    strides = F.array(*[F.lit(2**b) for b in reversed(range(len(cuts).bit_length()))])
    found = F.reduce(
        strides, F.lit(0),
        lambda at, stride: F.when(F.get(points, at + stride - 1) >= value, at + stride).otherwise(at),
    )
    return F.when(value.isNull(), F.lit(len(cuts))).otherwise(found)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in ranges of descending ids, each range followed by the row that comes after it (``tail`` = 1).

    The bounds are ids of the table, so the first row of a range is known without looking into it, and is sent to the range
    before as well. The first row of all also follows the last range. Equal ids stand in the order of their texts.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES_PER_TASK * tasks
    shares = [i / n for i in range(1, n)]
    row = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), shares, DISTINCT), F.max(id_col)).first()
    cuts = sorted(set(row[0] or []), reverse=True)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = range_of(F.col("id"), cuts) if cuts else F.lit(0)
    placed = rows.withColumn("own", own)
    is_cut = F.lit(False)
    if cuts:
        is_cut = F.get(F.array(*[F.lit(c) for c in cuts]), F.col("own") - 1) == F.col("id")
    is_first = F.col("id").eqNullSafe(F.lit(row[1]).cast("bigint"))

    def place(at: Column, tail: int) -> Column:
        return F.struct(at.cast("int").alias("range"), F.lit(tail).alias("tail"))

    # The last range holds what is below all cuts.
    where = F.concat(
        F.array(place(F.col("own"), 0)),
        F.when(is_cut, F.array(place(F.col("own") - 1, 1))).otherwise(F.array()),
        F.when(is_first, F.array(place(F.lit(len(cuts)), 1))).otherwise(F.array()),
    )
    sent = placed.select("id", "text", F.explode(where).alias("at")).select("at.range", "at.tail", "id", "text")
    # The own rows of a null-free table leave the last range empty only if the table is empty.
    return sent.repartition(tasks, "range").sortWithinPartitions("range", "tail", F.desc_nulls_last("id"), "text")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document, in descending
    order of the ids; the last document is followed by the first. A null text counts as empty; null ids come last; equal
    ids are ordered by text; repeated rows are rows of their own. A table of one row follows itself. Other columns are
    ignored. Texts are shuffled once, and a task holds two of them besides its batch.
    """

    def finished(doc_id, text, tree, next_text, next_tree):
        n = len(text)
        edited = text[: n - n // 2] + next_text[: n // 2]
        edited_tree = tree_of(edited)
        hashed = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (
            doc_id, n, hashed, tree.text(), edited_tree.text(), likeness(tree, edited_tree), likeness(tree, next_tree),
        )

    def streamed(batches):
        waiting = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        for ranges, tails, ids, texts in rows_of(batches, "range", "tail", "id", "text"):
            rows = []
            for at, tail, doc_id, text in zip(ranges, tails, ids, texts):
                follows = waiting is not None and waiting[0] == at
                tree = tree_of(text) if follows or not tail else None
                if follows:
                    rows.append(finished(*waiting[1:], text, tree))
                waiting = None if tail else (at, doc_id, text, tree)
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return with_next(docs, id_col, text_col).mapInArrow(streamed, SCHEMA)
