"""Projections, filters and row checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeeper.functions.scalars import plus
from rowkeeper.schemas import MAX_COPY_MB


def moment(as_of: str) -> Column:
    """A timestamp without zone, from text."""
    return F.lit(as_of).cast("timestamp_ntz")


def recent_rows(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    """Strictly newer than ``days`` before ``as_of``. The bound folds to a constant and reaches the scan."""
    return df.filter(F.col(ts) > plus(moment(as_of), days=-days))


def eligible_rows(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conditions))


def in_not_in(df: DataFrame, col: str, include: list | None = None, exclude: list | None = None) -> DataFrame:
    if None in (include or []) + (exclude or []):
        raise ValueError("lists must not hold nulls: NOT IN with a null keeps no row")
    if include is not None:
        df = df.filter(F.col(col).isin(include))
    if exclude is not None:
        df = df.filter(~F.col(col).isin(exclude))
    return df


def name_patterns(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Any of several LIKE patterns, whatever the case."""
    return df.filter(reduce(lambda a, b: a | b, [F.ilike(F.col(col), F.lit(p)) for p in patterns]))


def project_calc(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(*[e.alias(name) for name, e in exprs.items()])


def open_window(df: DataFrame, end: str, as_of: str, out: str = "window_state") -> DataFrame:
    """A window that ends exactly now is already closed."""
    return df.withColumn(out, F.when(F.col(end) > moment(as_of), "open").otherwise("out_of_window"))


def merged_since(df: DataFrame, ts: str, since: str, cols: list[str]) -> DataFrame:
    return df.filter(F.col(ts) > moment(since)).select(*cols)


def non_blank(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def clamp_default(df: DataFrame, col: str, default, floor=0, out: str | None = None) -> DataFrame:
    """Nulls get the default, then nothing is below the floor."""
    return df.withColumn(out or col, F.greatest(F.coalesce(F.col(col), F.lit(default)), F.lit(floor)))


def validate_plan(
    df: DataFrame, action: str, allowed: list[str], size: str, cap: float = MAX_COPY_MB,
    capped: list[str] | None = None,
) -> DataFrame:
    """Reject reason per row, null when accepted. The cap holds for the ``capped`` actions, by default for all."""
    over = F.col(size) > cap
    if capped is not None:
        over = over & F.col(action).isin(capped)
    return df.withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.col(action).isin(allowed), F.lit(False)), "invalid_action").when(over, "too_big"),
    )


# One @ and one dot; user of letters and digits, or with a - or _ somewhere; label of letters and digits;
# at most three characters after the dot.
VALID_ADDRESS = r"^([\p{L}\p{N}]+|[^@.]*[-_][^@.]*)@[\p{L}\p{N}]+\.[^@.]{0,3}$"
ADDRESS_BREAKS = r"[ \t\n\f\r<>()\[\]\",;:]+"


def address_tokens(text: Column) -> Column:
    """Words with an @, without the full stop of a sentence. Splitting keeps this linear in the text."""
    words = F.filter(F.split(text, ADDRESS_BREAKS), lambda w: F.contains(w, F.lit("@")))
    return F.transform(words, lambda w: F.rtrim(w, F.lit(".")))


def valid_address(address: Column) -> Column:
    return address.rlike(VALID_ADDRESS)


def email_quality(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Addresses found in a text column: how many pass the check, per group."""
    found = df.select(*by, F.explode(address_tokens(F.col(col))).alias("address"))
    return found.groupBy(*by, valid_address(F.col("address")).alias("valid")).agg(
        F.count(F.lit(1)).alias("n_addresses")
    )
