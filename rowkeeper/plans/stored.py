"""Maintenance of stored tables: changes, incremental collection and purges that are commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeeper.functions.scalars import plus
from rowkeeper.operators.filters import moment
from rowkeeper.operators.maintenance import advance_marks, incremental_rows, retention_purge
from rowkeeper.session import written
from rowkeeper.sources.versions import TRIES, Conflict, Version, commit, current, publish, read_table, read_version, write_rows
from rowkeeper.sources.writers import staged_insert

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of nulls


def change_table(
    spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], partition: str | None = None
) -> Version:
    """Purge, synchronise or update a stored table: its rows are read, changed and committed as its next version.

    If another commit came in between, the change is made again on what that one left, so no change is lost.
    """
    for _ in range(TRIES):
        base = current(spark, path)
        changed = change(read_version(spark, path, base) if base.number else spark.read.parquet(path))
        try:
            return commit(spark, path, base, write_rows(changed, path, partition), changed.schema)
        except Conflict:
            continue
    raise Conflict(f"{path}: {TRIES} commits came in between")


def stored_marks(spark: SparkSession, path: str, sources: DataFrame, source: str) -> DataFrame:
    """The mark of every listed source, 0 for one that was never collected; ``path`` is the table of marks."""
    listed = sources.select(source).distinct()
    if not current(spark, path).number:
        return listed.withColumn("mark", F.lit(0).cast("bigint"))
    joined = listed.join(read_table(spark, path), source, "left")
    return joined.select(source, F.coalesce("mark", F.lit(0).cast("bigint")).alias("mark"))


def collect_new(
    spark: SparkSession, path: str, batch: DataFrame, sources: DataFrame, source: str, id: str, keys: list[str],
    shape: Callable[[DataFrame], DataFrame] = lambda rows: rows, partition: str | None = None,
) -> None:
    """One run of the incremental collector on a stored table: rows of the listed sources above their marks are added.

    Only new rows are read from the batch (see ``incremental_rows``) and written. Marks are a table beside this one
    (``<path>.marks``) and move after the rows are in. A run that broke in between is made good by the next one, as rows
    whose ``keys`` the table holds are left out; for that the table is read from the least new id on only. ``shape`` makes the rows
    to store from the new ones and keeps ``source`` and ``id``.
    """
    marks = written(stored_marks(spark, f"{path}.marks", sources, source), "marks")
    new = written(shape(incremental_rows(batch, marks, source, id, listed=True)), "new_rows")
    fresh = new
    if current(spark, path).number:
        fresh = staged_insert(read_table(spark, path).select(*new.columns), new, keys, bounded=[id])
    publish(fresh, path, partition, keep="all")
    held = marks
    if current(spark, f"{path}.marks").number:
        held = marks.unionByName(read_table(spark, f"{path}.marks"))
    publish(advance_marks(held, new, source, id), f"{path}.marks")


def month_of(ts: Column) -> Column:
    """The partition value of a time; it grows with it."""
    return F.date_format(ts, "yyyy-MM")


def purge_months(spark: SparkSession, path: str, month: str, ts: str, years: int, as_of: str) -> Version:
    """``retention_purge`` on a stored table that is partitioned by the month of its time column.

    Folders of months before the limit are left out of the next version unread, that of the limit's month is written anew, the
    others stay as they are; so a purge reads and writes one month, whatever the table holds. Rows without a time stay.
    """
    limit = spark.range(1).select(month_of(plus(moment(as_of), years=-years)).alias("month")).first().month
    for _ in range(TRIES):
        base = current(spark, path)
        months = {folder: folder.rpartition("=")[2] for folder in base.folders}
        kept = [folder for folder, value in months.items() if value > limit or value == NO_VALUE]
        here = tuple(folder for folder, value in months.items() if value == limit)
        if here:
            rows = read_version(spark, path, Version(base.number, here, base.schema))
            kept += write_rows(retention_purge(rows, ts, years, as_of), path, month)
        try:
            return commit(spark, path, base, kept, base.schema)
        except Conflict:
            continue
    raise Conflict(f"{path}: {TRIES} commits came in between")
