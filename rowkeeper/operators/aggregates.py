"""Aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeeper.functions.scalars import seconds_between
from rowkeeper.plans.ordered import ordered
from rowkeeper.plans.spread import repeat_rows
from rowkeeper.schemas import ALLOCATION_ERROR, VOWELS

LIST_PART = 1_000
BLANKS = r"[ \t\n\r\f]+"


def latest_per_key(df: DataFrame, keys: list[str], ts: str, id: str) -> DataFrame:
    """Largest time and largest id per key; the two may come from different rows."""
    return df.groupBy(*keys).agg(F.max(ts).alias(f"max_{ts}"), F.max(id).alias(f"max_{id}"))


def latest_row_per_key(df: DataFrame, keys: list[str], ts: str, id: str) -> DataFrame:
    """The whole latest row per key, ties by id."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, id)).alias("_row"))
    return latest.select(*keys, "_row.*")


def high_water_mark(sources: DataFrame, loaded: DataFrame, key: str, id: str) -> DataFrame:
    """Largest loaded id per source, 0 for a source without rows."""
    marks = loaded.groupBy(key).agg(F.max(id).alias("mark"))
    return sources.select(key).join(marks, key, "left").withColumn("mark", F.coalesce("mark", F.lit(0)))


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def check_summary(
    targets: DataFrame, findings: DataFrame, key: str, error: str = "error", message: str = "message_text",
    order: str = "id", code=ALLOCATION_ERROR,
) -> DataFrame:
    """Per target: ok without findings, else failed with the first message that has the code, which may be none.

    Counting needs the key alone; texts are read only where the code is.
    """
    counted = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n_findings"))
    first = findings.filter(F.col(error) == code).groupBy(key).agg(F.min_by(message, order).alias("first_message"))
    return targets.select(key).join(counted, key, "left").join(first, key, "left").select(
        key,
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.when(F.col("n_findings").isNull(), "ok").otherwise("failed").alias("result"),
        "first_message",
    )


def joined_parts(
    df: DataFrame, keys: list[str], item: str, order: list[str], sep: str, per_part: int = LIST_PART
) -> DataFrame:
    """Items of a key as text in order, at most ``per_part`` items in one row.

    A key with few items has the single part 0; a hot key is not built as one string.
    """
    placed = ordered(df.select(*dict.fromkeys([*keys, item, *order])), keys, order).add(position="_pos").rows()
    parts = placed.groupBy(*keys, F.expr(f"(_pos - 1) div {per_part}").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.col(item).cast("string").alias("item")))).alias("_items"),
    )
    return parts.select(
        *keys, "part", F.size("_items").cast("bigint").alias("n_items"),
        F.array_join(F.col("_items.item"), sep).alias("items"),
    )


def id_list(df: DataFrame, key: str, id: str, sep: str = ",", per_part: int = LIST_PART) -> DataFrame:
    return joined_parts(df, [key], id, [id], sep, per_part)


def join_names(
    df: DataFrame, key: str, name: str, sep: str = ", ", order: str | None = None, per_part: int = LIST_PART
) -> DataFrame:
    return joined_parts(df, [key], name, [order or name], sep, per_part)


def char_frequency(df: DataFrame, col: str) -> DataFrame:
    """Characters with their counts; read it by count descending, then character."""
    chars = df.select(F.explode(F.split(F.col(col), "")).alias("symbol"))
    return chars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol")


def sum_by_key(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias("total"))


def pivot_counts(df: DataFrame, row: str, item: str, values: list, other: str | None = None) -> DataFrame:
    """Count table: one row per row key, one column per listed item in alphabetical order, 0 where nothing is.

    ``other`` names a last column that counts the rows with an unlisted item or none.
    Conditional counts need one shuffle; a pivot would need two.
    """
    counts = [F.count_if(F.col(item) == v).alias(str(v)) for v in sorted(values, key=str)]
    if other is not None:
        counts.append(F.count_if(~F.coalesce(F.col(item).isin(list(values)), F.lit(False))).alias(other))
    return df.groupBy(row).agg(*counts).orderBy(row)


def duplicate_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values that occur more than once, each count - 1 times."""
    counted = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_extra")).filter(F.col("_extra") > 0)
    return repeat_rows(counted, "_extra")


def common_multiset(df: DataFrame, group: str, item: str) -> DataFrame:
    """Items that every group holds, each as often as in the group with the fewest."""
    counted = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    groups = counted.select(group).distinct().agg(F.count(F.lit(1))).scalar()
    everywhere = counted.groupBy(item).agg(
        F.count(F.lit(1)).alias("_groups"), F.min("n").alias("_times")
    ).filter(F.col("_groups") == groups)
    return repeat_rows(everywhere.select(item, "_times"), "_times")


def route_average(
    df: DataFrame, who: str, place: str, ts: str, duration: Callable[[Column, Column], Column] = seconds_between
) -> DataFrame:
    """Average duration per (start, end) over consecutive records of one who."""
    scan = ordered(df.select(who, place, ts), [who], [ts]).add(previous={
        "start_place": (F.col(place), F.lit(None)), "_left": (F.col(ts), F.lit(None)),
    })
    legs = scan.rows().filter(F.col("_left").isNotNull())
    return legs.groupBy("start_place", F.col(place).alias("end_place")).agg(
        F.count(F.lit(1)).alias("n_legs"),
        F.avg(duration(F.col("_left"), F.col(ts))).alias("avg_duration"),
    )


def covered_length(df: DataFrame, col: str, allowed: str, by: list[str] | None = None) -> DataFrame:
    """Total length of the words made only of allowed characters."""
    covered = F.filter(F.split(F.col(col), " "), lambda w: F.translate(w, allowed, "") == "")
    length = F.aggregate(covered, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.sum(length), F.lit(0)).alias("covered_length"))


def fold_sum(df: DataFrame, array_col: str, out: str = "total") -> DataFrame:
    return df.withColumn(out, F.aggregate(F.col(array_col), F.lit(0.0), lambda n, x: n + x))


def vowel_rule(word: Column) -> Column:
    """2 for an even number of vowels, else 1."""
    vowels = F.length(word) - F.length(F.translate(word, VOWELS, ""))
    return F.when(vowels % 2 == 0, 2).otherwise(1)


def token_rule_score(
    df: DataFrame, id: str, text: str, rule: Callable[[Column], Column] = vowel_rule, keep: list[str] | None = None
) -> DataFrame:
    """Score of all words of a text, without taking the words out of their row."""
    words = F.filter(F.split(F.col(text), BLANKS), lambda w: w != "")
    score = F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + rule(w))
    return df.select(id, *(keep or []), F.size(words).cast("bigint").alias("n_words"), score.alias("score"))


def sortedness_check(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Per chosen column how many keys break its order, and whether any does."""
    scan = ordered(df.select(*dict.fromkeys([*keys, *order, *cols])), keys, order).add(
        previous={f"_prev_of_{c}": (F.col(c), F.lit(None)) for c in cols}
    )
    per_key = scan.rows().groupBy(*keys).agg(*[
        F.max(F.when(F.col(f"_prev_of_{c}") > F.col(c), 1).otherwise(0)).alias(c) for c in cols
    ])
    totals = per_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])
    return totals.unpivot([], cols, "column_name", "n_unsorted_keys").withColumn(
        "is_sorted", F.col("n_unsorted_keys") == 0
    )
