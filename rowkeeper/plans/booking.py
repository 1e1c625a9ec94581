"""Booking the next job of a queue (T1): choosing it and marking it is one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeeper.operators.ordering import next_in_queue
from rowkeeper.sources.versions import TRIES, Conflict, Version, commit, current, publish, read_version, value_folder, write_rows

SELECTED = "is_selected"
ORDER = ["current_window_start", "backup_delta", "queue_time", "id"]
LOG_PRIORITY, LOG_TYPE = "LP", "L"


def log_priority(metadata: DataFrame) -> Column:
    """Whether log backups go first: the metadata row says a number other than 0. No row, or no number, means no."""
    said = metadata.filter(F.col("key_code") == LOG_PRIORITY).agg(F.max(F.col("key_value").try_cast("int")).alias("lp"))
    return F.coalesce(said.scalar() != 0, F.lit(False))


def store_queue(queue: DataFrame, path: str) -> Version:
    """The queue as a table whose open jobs lie apart from the booked ones."""
    return publish(queue, path, SELECTED)


def next_job(queue: DataFrame, metadata: DataFrame) -> DataFrame:
    """The job to book: queued, not booked and not taken back; logs first if the metadata says so, then by ``ORDER``."""
    waiting = (F.col(SELECTED) == 0) & (F.col("status") == "queued") & F.col("unqueue_time").isNull()
    preferred = log_priority(metadata) & F.coalesce(F.col("backup_type") == LOG_TYPE, F.lit(False))
    return next_in_queue(queue.filter(waiting).withColumn("_first", preferred), ORDER, F.col("_first")).drop("_first")


def book_next(spark: SparkSession, path: str, metadata: DataFrame):
    """Book the next job of the queue at ``path`` and give its id; None when no job waits.

    The commit is based on the version from which the job was chosen. If another booking came first it fails, and the choice is
    made again from what that one left, so no two bookings return the same job. Only the open jobs are written anew.
    """
    for _ in range(TRIES):
        base = current(spark, path)
        queue = read_version(spark, path, base)
        chosen = next_job(queue, metadata).select("id").first()
        if chosen is None:
            return None
        open_folder = f"{SELECTED}=0"
        marked = queue.filter(F.col(SELECTED) == 0).withColumn(
            SELECTED, F.when(F.col("id") == chosen.id, 1).otherwise(0).cast(queue.schema[SELECTED].dataType)
        )
        written = write_rows(marked, path, SELECTED)
        try:
            commit(spark, path, base, [f for f in base.folders if value_folder(f) != open_folder] + written, base.schema)
            return chosen.id
        except Conflict:
            continue
    raise Conflict(f"{path}: {TRIES} bookings came in between")
