"""Concordant and discordant pair counts without building pairs.

For every row of a key in its order: how many earlier and later rows are smaller or greater. All four
numbers follow from positions and from the earlier rows that sort lower by (value, order).

Those are counted digit by digit. Ranks are written with DIGIT as base; two ranks differ first in one digit, so
an earlier row with a lower rank shares the digits before that place and has a lower digit there. One running count
per digit value, inside (key, digits before), finds them. A key of n rows takes log(n) rounds; without hot
keys all rounds use the one shuffle by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkeeper.plans.ordered import hot_keys, hot_rows_limit, ordered
from rowkeeper.session import written

DIGIT = 16


def earlier_lower(placed: DataFrame, keys: list[str], largest: int, hot: bool, out: str) -> DataFrame:
    """Per row the rows of its key with a smaller ``_pos`` and ``_rank``, for keys of up to ``largest`` rows."""
    limit = hot_rows_limit(placed)
    rounds = 1
    while DIGIT**rounds < largest:
        rounds += 1
    df = placed.withColumn(out, F.lit(0).cast("bigint"))
    for left in reversed(range(rounds)):
        digits = {
            "_before": F.expr(f"(_rank - 1) div {DIGIT ** (left + 1)}"),
            "_digit": F.expr(f"((_rank - 1) div {DIGIT ** left}) % {DIGIT}"),
        }
        may_be_hot = hot and DIGIT ** (left + 1) > limit
        scan = ordered(
            df.withColumns(digits), [*keys, "_before"], ["_pos"], hot=None if may_be_hot else {},
            probe=placed.withColumns(digits),
        ).add(sums={f"_seen_{d}": F.when(F.col("_digit") == d, 1).otherwise(0) for d in range(DIGIT - 1)})
        lower = sum(
            (F.when(F.col("_digit") > d, F.col(f"_seen_{d}")).otherwise(0) for d in range(DIGIT - 1)), F.col(out)
        )
        df = scan.rows().withColumn(out, lower).drop("_before", "_digit", *[f"_seen_{d}" for d in range(DIGIT - 1)])
    return df


def concordance_counts(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The four counts per row, and ``n_monotone``: rising or falling triples with the row in the middle."""
    rows = df.select(*dict.fromkeys([*keys, *order, value]))
    hot = hot_keys(rows, keys, hot_rows_limit(rows))
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    placed = ordered(rows, keys, order, hot=hot).add(position="_pos", total="_n").rows()
    placed = ordered(placed, keys, [value, *order], hot=hot, probe=rows).add(position="_rank").rows()
    same_hot = None if hot else {}
    placed = ordered(placed, [*keys, value], order, hot=same_hot, probe=rows).add(
        position="_same_pos", total="_same"
    ).rows()
    if hot:
        placed = written(placed, "placed")
    counted = earlier_lower(placed, keys, largest, bool(hot), "_below")

    smaller = F.col("_below") - (F.col("_same_pos") - 1)
    greater = F.col("_pos") - 1 - F.col("_below")
    later_smaller = F.col("_rank") - 1 - F.col("_below")
    later_greater = F.col("_n") - F.col("_same") - smaller - greater - later_smaller
    return counted.select(
        *rows.columns, smaller.alias("earlier_smaller"), greater.alias("earlier_greater"),
        later_smaller.alias("later_smaller"), later_greater.alias("later_greater"),
        (smaller * later_greater + greater * later_smaller).alias("n_monotone"),
    )
