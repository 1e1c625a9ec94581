"""Table maintenance as functions from tables to tables (M1-M7).

Plain parquet tables take no MERGE, UPDATE or DELETE, so the result is written with
``sources.writers.replace_table``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowkeeper.operators.filters import moment
from rowkeeper.functions.scalars import plus
from rowkeeper.plans.skew import skew_join
from rowkeeper.sources.versions import read_table
from rowkeeper.sources.writers import replace_table


def single(df: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """The rows with a true column ``mark``, which raises an error for a key that occurs twice; null keys match nothing and may repeat.

    The count shares its shuffle with the join on these keys that follows.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    doubled = known & (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)
    text = F.concat(F.lit(f"several source rows for the key ({', '.join(keys)}) = "), F.to_json(F.struct(*keys)))
    return df.withColumn(mark, F.when(doubled, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def full_sync(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """Make the target hold exactly the keys of the source.

    Rows carry an ``action``: update, insert or delete; the new table is everything but the deletes. Columns that
    only the target has keep their value on a match and are null on an insert. A null in the source
    overwrites. A source key that occurs twice is an error, as it is for MERGE; target rows of one key are all updated.
    """
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = single(source.select(*keys, *update_cols), keys, "_in_source").alias("s")
    match = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    in_source = F.col("s._in_source").isNotNull()
    action = F.when(~in_source, "delete").when(F.col("t._in_target").isNull(), "insert").otherwise("update")

    def merged(c: str):
        if c in keys:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}"))
        if c in update_cols:
            return F.when(in_source, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
        return F.col(f"t.{c}")

    return t.join(s, match, "full_outer").select(
        *[merged(c).alias(c) for c in target.columns], action.alias("action")
    )


def full_sync_composite(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """``full_sync`` on several keys, with a target that has columns of its own."""
    if len(keys) < 2:
        raise ValueError("give at least two keys")
    return full_sync(target, source, keys, update_cols)


def synced_table(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("action") != "delete").drop("action")


def retention_purge(df: DataFrame, ts: str, years: int, as_of: str) -> DataFrame:
    """Without the rows that are at least ``years`` old; rows without a time stay, as a DELETE would leave them."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) > plus(moment(as_of), years=-years)))


def status_update(df: DataFrame, changes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Set columns for the keys of a change set; a null in the change set is written too. A key with two changes is an error."""
    renamed = single(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols]), [key], "_changed")
    joined = df.join(renamed, key, "left")

    def updated(c: str):
        if c not in cols:
            return F.col(c)
        return F.when(F.col("_changed").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[updated(c) for c in df.columns])


def disable_rules(rules: DataFrame, failed: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Disable every rule that matches a failed one."""
    hits = failed.select(*keys).distinct().withColumn("_failed", F.lit(1))
    joined = rules.join(hits, keys, "left")
    off = F.when(F.col("_failed").isNotNull(), "Disabled").otherwise(F.col(status))
    return joined.select(*[off.alias(c) if c == status else F.col(c) for c in rules.columns])


def split_by_target(df: DataFrame, target: str, path: str) -> None:
    """A copy of the central table per target, in one write."""
    replace_table(df, path, partition=target)


def target_copy(spark: SparkSession, path: str, target: str, value) -> DataFrame:
    """The copy of one target; only its folder is read."""
    return read_table(spark, path).filter(F.col(target) == value)


def incremental_rows(batch: DataFrame, marks: DataFrame, source: str, id: str, listed: bool = False) -> DataFrame:
    """Rows above the mark of their source; a source without a mark starts at 0, a null mark is 0.

    With ``listed`` only the sources in ``marks`` are collected. No row at or below the least mark can be new then, and that
    bound reaches the scan of the batch, so files and row groups of old rows are not read.
    """
    mark = F.coalesce(F.col("mark").cast("bigint"), F.lit(0))
    if listed:
        batch = batch.filter(F.col(id) > marks.agg(F.min(mark)).scalar())
    joined = skew_join(batch, marks.select(source, "mark"), [source], "inner" if listed else "left")
    return joined.filter(F.col(id) > mark).select(*batch.columns)


def incremental_append(loaded: DataFrame, batch: DataFrame, marks: DataFrame, source: str, id: str) -> DataFrame:
    """The loaded table with the new rows of a batch.

    Marks are a table of their own (see ``advance_marks``): taken from the loaded rows, the mark of a fully purged
    source would fall to 0 and its old rows would return.
    """
    return loaded.unionByName(incremental_rows(batch, marks, source, id))


def advance_marks(marks: DataFrame, batch: DataFrame, source: str, id: str) -> DataFrame:
    """Marks after a batch; they never fall."""
    seen = marks.select(source, "mark").unionByName(
        batch.groupBy(source).agg(F.max(id).alias("mark"))
    )
    return seen.groupBy(source).agg(F.max("mark").alias("mark"))
