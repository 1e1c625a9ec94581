"""Set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def membership_diff(current: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, action): add what is wanted and not current, remove what is current and not wanted.

    Names compare in lower case. One aggregation over both sides replaces two distincts and a full join.
    """
    name = F.lower(F.col(key)).alias(key)
    both = current.select(name, F.lit(1).alias("here"), F.lit(0).alias("there")).unionAll(
        wanted.select(name, F.lit(0), F.lit(1))
    )
    sides = both.groupBy(key).agg(F.max("here").alias("here"), F.max("there").alias("there"))
    return sides.filter(F.col(key).isNotNull() & (F.col("here") != F.col("there"))).select(
        key, F.when(F.col("there") == 1, "add").otherwise("remove").alias("action")
    )


def unpivot_columns(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """Several columns as one list, blanks left out, doubles kept."""
    values = F.array(*[F.col(c) for c in cols])
    return df.select(F.explode(F.filter(values, lambda v: v.isNotNull() & (v.cast("string") != ""))).alias(out))


def transpose(df: DataFrame, row: str, pos: str, value: str, rows: list) -> DataFrame:
    """Cells (row, position, value) of a few listed rows as one line per position: a column per row,
    and the values of the line in order. Two cells at one place are an error, as a line has room for one."""
    kind = df.schema[value].dataType

    def cell(r):
        here = F.col(row) == r
        text = F.concat(F.lit(f"several cells in row {r} at position "), F.coalesce(F.first(pos).cast("string"), F.lit("null")))
        return F.when(F.count_if(here) > 1, F.raise_error(text).cast(kind)).otherwise(F.max(F.when(here, F.col(value)))).alias(f"row_{r}")

    wide = df.groupBy(pos).agg(*[cell(r) for r in rows])
    return wide.withColumn("sorted_values", F.array_sort(F.array_compact(F.array(*[f"row_{r}" for r in rows]))))


def matrix_cells(df: DataFrame, row: str, values: str) -> DataFrame:
    """Array rows as cells (row, pos, value) with positions from 0."""
    return df.select(row, F.posexplode(values).alias("pos", "value"))


def nested_explode_report(df: DataFrame, parent: str, list_col: str) -> DataFrame:
    """One row per (parent, child); struct children become columns."""
    flat = df.select(parent, F.explode(list_col).alias("child"))
    if flat.schema["child"].dataType.typeName() == "struct":
        return flat.select(parent, "child.*")
    return flat
