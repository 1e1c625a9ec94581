"""What the operators share: reading batches of text, words, and the session's own folders."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256  # rows of a batch that are Python objects at the same time
MAX_CACHED_WORDS = 600_000  # of a worker; the cache starts anew beyond
MAX_CACHED_LENGTH = 64

#: The words of a text, unchanged: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    workers_find_library(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_024  # rows of a batch, unless the session says otherwise; texts can be long


def workers_find_library(spark: SparkSession) -> None:
    """Let Python workers import this library when the driver found it outside their search path, and keep batches of texts small."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def give_back() -> None:
    """Return freed memory to the system: a worker lives through several stages, and pages freed in one count in all that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim is not None:
        trim(0)


def rows_of(batches, *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of Arrow batches as lists, a few hundred rows at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield tuple(c.slice(start, ROWS_AT_ONCE).to_pylist() for c in columns)
    give_back()


def words_of(text: str | None) -> list[bytes]:
    """``bytes.split`` splits at exactly the white space that ``WORD`` leaves out."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; looking words up in a cache takes longer than hashing them."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(FACTOR), -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(name: str, factor: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        filled = np.full(max(n, 2 * len(_powers[name])), factor, np.uint64)
        filled[0] = 1
        _powers[name] = np.multiply.accumulate(filled)
    return _powers[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values, from one running sum; all arithmetic is modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _grown("down", INVERSE, len(hashes)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _grown("up", FACTOR, n))


def null_safe_id(column: str):
    """Text of an identifier for hashing; a null has a text of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\0"))
