"""Sinks: append, replace, staged insert, delimited text and log rows (K1-K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeeper.sources.versions import publish, versions


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a table; with a commit when it has commits."""
    if versions(df.sparkSession, path):
        publish(df, path, keep="all")
    else:
        df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace the whole table, or only the partitions that the frame holds; read it with ``versions.read_table``.

    The rows are written first and one commit makes them the table, so the frame may read the table that it replaces, a
    write that breaks at any step leaves the old rows, and readers of the old rows are not disturbed.
    """
    publish(df, path, partition, "nothing" if partition is None else "other partitions")


def staged_insert(target: DataFrame, staging: DataFrame, keys: list[str], bounded: list[str] | None = None) -> DataFrame:
    """Staged rows that the target does not hold yet, one per natural key.

    Loading the same staging rows again adds nothing, so a rerun after a crash is safe. For keys that grow over time, name them in
    ``bounded``: the target is then read only between the least and the greatest staged value, and these
    bounds reach its scan, so a batch reads a part of the target that does not grow with it.
    """
    rest = [c for c in staging.columns if c not in keys]
    held = target.select(*keys)
    for c in bounded or []:
        # Two plans that differ: Spark would merge alike ones into one struct, whose fields do not reach a scan.
        least, most = staging.agg(F.min(c)), staging.filter(F.col(c).isNotNull()).agg(F.max(c))
        held = held.filter(F.col(c).between(least.scalar(), most.scalar()))
    new = staging.join(held, keys, "left_anti")
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else new.distinct()
    return one.select(*[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in staging.columns])


def csv_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def fixed_width(c: Column, width: int) -> Column:
    """Pad to the width, or cut and mark the cut with two dots."""
    return F.when(
        F.length(c) > width, F.concat(F.substring(c, 1, width - 2), F.lit(".."))
    ).otherwise(F.rpad(c, width, " "))


def delimited_lines(
    df: DataFrame, cols: list[str], sep: str = " ;", body: str | None = None, width: int = 40
) -> DataFrame:
    """One text line per record; the body column comes last in a fixed width. A null is an empty field in its place."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    if body is not None:
        parts.append(fixed_width(F.coalesce(F.col(body), F.lit("")), width))
    return df.select(F.concat_ws(sep, *parts).alias("line"))


def command_log(df: DataFrame, outcome: str, codes: DataFrame) -> DataFrame:
    """Log rows with the number of their outcome; ``codes`` is (outcome, error_number)."""
    coded = df.join(codes.withColumnRenamed("outcome", outcome), outcome, "left")
    return coded.select(
        "id", "database_name", "command", "command_type", "start_time", "end_time",
        F.coalesce("error_number", F.lit(0)).alias("error_number"), "error_message",
    )
