"""Scalar helpers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeeper.schemas import FILE_DATE, LOG_TIME

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed, not elapsed minutes: 00:00:59 to 00:01:00 counts 1.

    Built from calendar fields, so the session time zone plays no part.
    """
    days = F.datediff(F.to_date(end), F.to_date(start)).cast("bigint")
    return days * 1440 + (F.hour(end) - F.hour(start)) * 60 + (F.minute(end) - F.minute(start))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / 1_000_000


def swap_case(c: Column) -> Column:
    return F.translate(c, UPPER + LOWER, LOWER + UPPER)


def char_count(c: Column, char: str) -> Column:
    """How often one character occurs."""
    return (F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))).cast("bigint")


def plus(ts: Column, days: int = 0, months: int = 0, years: int = 0) -> Column:
    return ts + F.make_interval(years=F.lit(years), months=F.lit(months), days=F.lit(days))


def stamp(ts: Column) -> Column:
    """Text form used in logs."""
    return F.date_format(ts, LOG_TIME)


def scalar_text(df: DataFrame, col: str) -> DataFrame:
    c = F.col(col)
    words = F.split(c, " ")
    return df.withColumns({
        "reversed": F.reverse(c),
        "swapped": swap_case(c),
        "n_chars": F.length(c).cast("bigint"),
        "n_e": char_count(c, "e"),
        "joined": F.concat_ws("_", words),
        "first_word": words[0],
        "first_char": F.substring(c, 1, 1),
        "without_spaces": F.replace(c, F.lit(" "), F.lit("")),
        "space_at": F.instr(c, " ").cast("bigint"),
        "is_alnum": c.rlike("^[\\p{L}\\p{N}]+$"),
    })


def scalar_dates(df: DataFrame, ts: str) -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "days_back": plus(t, days=-45),
        "month_back": plus(t, months=-1),
        "years_back": plus(t, years=-2),
        "stamp": stamp(t),
        "file_stamp": F.date_format(t, FILE_DATE),
    })


def scalar_arrays(df: DataFrame, col: str) -> DataFrame:
    words = F.split(F.col(col), " ")
    numbered = F.arrays_zip(
        words.alias("word"), F.transform(words, lambda w: F.length(w)).alias("size"),
    )
    return df.withColumns({
        "sorted_words": F.array_join(F.array_sort(words), " "),
        "first_two": F.array_join(F.slice(words, 1, 2), " "),
        "every_second": F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " "),
        "repeated": F.array_join(F.array_repeat(words[0], 2), ","),
        "zipped": F.array_join(
            F.transform(numbered, lambda p: F.concat_ws(":", p["word"], p["size"].cast("string"))), " "),
        "all_short": F.forall(words, lambda w: F.length(w) <= 5),
        "n_words": F.size(words).cast("bigint"),
    })


def scalar_math_cast(df: DataFrame, cols: list[str]) -> DataFrame:
    whole, real = cols
    w, r = F.col(whole), F.col(real)
    return df.withColumns({
        "third": F.expr(f"`{whole}` div 3"),
        "rest": w % 3,
        "off_center": F.abs(w - 25),
        "as_text": w.cast("string"),
        "as_money": r.cast("decimal(18,2)"),
        "not_a_number": F.col(whole).cast("string").substr(2, 1).try_cast("int"),
        "or_zero": F.coalesce(F.when(r > 1000, r.cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)")),
        "smaller": F.least(w, F.lit(10)),
    })
