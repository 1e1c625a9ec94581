"""The incremental collectors as a stream (ST1)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_collect(
    spark: SparkSession, path: str, schema: StructType | str, out: str, ckpt: str, keys: list[str] | None = None,
    files_per_batch: int = 1_000, event_time: str | None = None, delay: str | None = None,
) -> StreamingQuery:
    """Append what is new under ``path`` to ``out`` and stop.

    The checkpoint takes the place of the stored mark: a file is loaded once, also across restarts. When sources send
    rows again give their ``keys``: a row whose key came before is left out. The keys met so far are the stream's state, which
    lies on disk beside the checkpoint; a batch looks up its own keys in it and never reads the output. Of rows of one key in
    one batch any one stays. Without more the state holds every key and no late row is lost; with the time column ``event_time`` and a
    ``delay`` keys are forgotten when the stream is past their time by the delay, which bounds the state, and a key that
    comes again later than that is a new row.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if keys is not None:
        rows = rows.dropDuplicates(keys) if event_time is None else rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    writer = rows.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    before = spark.conf.get(STATE_STORE, None)
    # A query takes the settings of its start with it.
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        return writer.format("parquet").outputMode("append").option("path", out).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
