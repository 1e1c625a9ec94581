"""Sorts, limits and top-k (T1-T8). Order shows as a rank or position column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkeeper.operators.filters import eligible_rows
from rowkeeper.plans.ordered import ordered, ranked, sort_columns
from rowkeeper.sources.readers import inline_rows

# Up to this many rows per key Spark cuts each key before the shuffle, so a hot key stays small.
GROUP_LIMIT = 1_000


def next_in_queue(
    df: DataFrame, order: list[str], prefer: Column | None = None, per: list[str] | None = None
) -> DataFrame:
    """First row by the order, preferred rows before all others; one overall or one per key."""
    lead = [] if prefer is None else [F.when(prefer, 0).otherwise(1)]
    sort = [*lead, *[F.asc(c) for c in order]]
    if per is None:
        return df.orderBy(*sort).limit(1)
    place = F.row_number().over(Window.partitionBy(*per).orderBy(*sort))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def oldest_eligible(df: DataFrame, conditions: list[Column], id: str) -> DataFrame:
    return eligible_rows(df, conditions).orderBy(id).limit(1)


def sample_per_source(df: DataFrame, source: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of every source by an order, which makes the sample repeatable."""
    if n > GROUP_LIMIT:
        placed = ordered(df, [source], order).add(position="position").rows()
    else:
        place = F.row_number().over(Window.partitionBy(source).orderBy(*order)).cast("bigint")
        placed = df.withColumn("position", place)
    return placed.filter(F.col("position") <= n)


def kth_row(df: DataFrame, order: list[str], k: int, keys: list[str] | None = None) -> DataFrame:
    """The k-th row overall or per key; a leading ``-`` on an order column means descending.

    Nulls come first upward and last downward. Beyond GROUP_LIMIT a hot key is cut along the order into slices, so no task sorts it.
    """
    if keys is None:
        return df.orderBy(*sort_columns(order)).offset(k - 1).limit(1)
    if k > GROUP_LIMIT:
        return ordered(df, keys, order).add(position="_place").rows().filter(F.col("_place") == k).drop("_place")
    # Keep "<= k" apart from "== k": the first is what Spark applies before the shuffle.
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_columns(order))))
    return placed.filter(F.col("_place") <= k).filter(F.col("_place") == k).drop("_place")


def multi_key_sort(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    return ranked(df, order, out)


def custom_order(df: DataFrame, col: str, reference: list, tie: list[str], out: str = "rank") -> DataFrame:
    """Order by the place in a reference list; unlisted values come last in their original order.

    An item that the list names twice has its first place.
    """
    kind = df.schema[col].dataType.simpleString()
    first = {item: place for place, item in reversed(list(enumerate(reference)))}
    places = inline_rows(df.sparkSession, list(first.items()), f"_item {kind}, _place int")
    placed = df.join(places, df[col] == places["_item"], "left")
    placed = placed.withColumn("_place", F.coalesce("_place", F.lit(len(reference)))).drop("_item")
    return ranked(placed, ["_place", *tie], out).drop("_place")


def numeric_text_sort(df: DataFrame, col: str, tie: list[str], out: str = "rank") -> DataFrame:
    """Text keys in the order of their numbers."""
    return ranked(df.withColumn("_number", F.col(col).cast("bigint")), ["_number", *tie], out).drop("_number")


def ordered_scan(df: DataFrame, id: str) -> DataFrame:
    """Rows in id order inside every output file, which is what an incremental reader needs."""
    return df.sortWithinPartitions(id)
