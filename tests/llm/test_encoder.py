"""Identifiers of texts from remembered words against the library, and packing of rows that share an identifier."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowkeeper.llm import packing
from rowkeeper.llm.queries import vocabulary_file

PATH = vocabulary_file("byte_bpe_50k.json")


@pytest.mark.parametrize("ranked", [False, True])
def test_encoder_agrees_with_the_library(monkeypatch, ranked):
    """Odd white space, added tokens, long words, and dictionaries that turn over all the time."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    rng = random.Random(1)
    odd = ["a", " ", "\n", "\t", "b", "é", "  ", "\n\n", "\x85", "\xa0", "<|endoftext|>", "'s", "1", "!!", "ab ", "\x1c", "\r\n", "x" * 70, "€"]
    words = ["w", "yy", "z!", "é?", "1\x1c2", "v" * 80]
    encoder = packing.Encoder(PATH, ranked)
    for _ in range(300):
        texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(9))) for _ in range(20)]
        texts += [rng.choice([" ", "\n"]).join(rng.choice(words) + str(rng.randrange(99)) for _ in range(5)) for _ in range(6)]
        assert encoder.encode(texts) == encoder.whole(texts)
    assert all(len(key) <= packing.MAX_CACHED_LENGTH for held in (*encoder.words, *encoder.chunks) for key in held)


def test_encoder_remembers_words_that_come_again_and_drops_the_older_half(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    encoder = packing.Encoder(PATH)
    once = "a " + " ".join(f"once{i}" for i in range(50))
    assert encoder.encode([once]) == encoder.whole([once])
    assert not encoder.words and not encoder.chunks
    for i in range(8):
        for _ in range(2):
            assert encoder.encode([f"a w{i}"]) == encoder.whole([f"a w{i}"])
    held = list(encoder.words)
    assert len(held) == 8
    assert encoder.encode(["a w7"]) == encoder.whole(["a w7"])
    assert list(encoder.words) == held[4:]


def test_rows_that_share_an_identifier_fill_all_buckets(spark, monkeypatch):
    """One id, one null id and one text in all rows: every piece has its own place, and buckets fill evenly."""
    monkeypatch.setattr(packing, "BUCKET_ROWS", 16)
    docs = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, 7).cast("bigint").alias("doc_id"), F.lit("the same words in all rows").alias("text")
    )
    pieces = packing.pieces_of(docs.repartition(4), PATH, 1024, 2, "doc_id", "text")
    sizes = [r["count"] for r in pieces.withColumn("bucket", F.pmod("slot", F.lit(25))).groupBy("bucket").count().collect()]
    assert len(sizes) == 25 and max(sizes) <= 2 * 16
    packed = packing.pack_documents(docs, PATH, size=64, end_id=2).collect()
    length = packed[0].length
    per_sequence = 64 // length
    assert len(packed) == 400 and len({r.sequence_id for r in packed}) == -(-400 // per_sequence)
    assert len({(r.sequence_id, r.offset) for r in packed}) == 400
    assert all(r.offset % length == 0 and r.offset + length <= 64 for r in packed)


def test_text_groups_cover_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(packing, "TEXTS_AT_ONCE", 4)
    monkeypatch.setattr(packing, "BYTES_AT_ONCE", 10)
    texts = [None, "", "a" * 25, "é" * 5, "abc", None, "x", "y", "z", "w", "v", "b" * 11, ""]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    groups = list(packing.text_groups([batch, batch.slice(0, 0), batch.slice(3)]))
    assert [pair for ids, found in groups for pair in zip(ids, found)] == [*enumerate(texts), *list(enumerate(texts))[3:]]
    for ids, found in groups:
        assert len(ids) <= 4 and (len(ids) == 1 or sum(len((t or "").encode()) for t in found) <= 10)


def test_merges_by_rank_holds_for_the_vocabulary_and_not_for_changed_ones(tmp_path):
    assert packing.merges_by_rank(PATH)
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    for at, changed in enumerate([merges[1:], [merges[1], merges[0], *merges[2:]]]):
        other = {**spec, "model": {**spec["model"], "merges": changed}}
        (tmp_path / f"{at}.json").write_text(json.dumps(other))
        assert not packing.merges_by_rank(str(tmp_path / f"{at}.json"))


def test_new_words_have_the_identifiers_of_the_library():
    rng = random.Random(4)
    letters = "aaabcdeeefghiiijklmnoopqrsttuvwxyzABCXYZ0123456789'-_.,;:!?()[]{}<>/\\@#$%&*+=|~`\"^"
    words = {"".join(rng.choices(letters, k=rng.randint(1, 24))) for _ in range(30_000)}
    words |= {"\n" + w for w in list(words)[:2_000]} | {w + "é" for w in list(words)[2_000:2_200]} | {"a" * n for n in range(1, 70)}
    accented = [chr(c) for c in range(0xA1, 0x250) if not chr(c).isspace()] + list("abc1'") + ["\U0001f600", "字", "\u0301", "٣"]
    words |= {"".join(rng.choices(accented, k=rng.randint(1, 8))) for _ in range(20_000)}
    words = sorted(words)
    assert packing.Encoder(PATH, True).fresh(words) == packing.Encoder(PATH).whole([w if w[0] == "\n" else " " + w for w in words])
