from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import EVENTS_AS_OF, check
from rowkeeper.functions import scalars
from rowkeeper.operators.filters import moment


@check("minutes_between", f"""
SELECT event_id, date_diff('minute', ts, TIMESTAMP '{EVENTS_AS_OF}') AS minutes FROM events
""")
def minutes_between(t):
    return t.events.select(
        "event_id", scalars.minutes_between(F.col("ts"), moment(EVENTS_AS_OF)).alias("minutes")
    )


@check("scalar_text", """
SELECT p_partkey, p_name, reverse(p_name) AS reversed,
  translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
    'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') AS swapped,
  length(p_name) AS n_chars, length(p_name) - length(replace(p_name, 'e', '')) AS n_e,
  replace(p_name, ' ', '_') AS joined, split_part(p_name, ' ', 1) AS first_word, left(p_name, 1) AS first_char,
  replace(p_name, ' ', '') AS without_spaces, CAST(instr(p_name, ' ') AS BIGINT) AS space_at,
  regexp_matches(p_name, '^[a-zA-Z0-9]+$') AS is_alnum
FROM part
""")
def scalar_text(t):
    return scalars.scalar_text(t.part.select("p_partkey", "p_name"), "p_name")


@check("scalar_dates", """
SELECT o_orderkey, o_orderdate, o_orderdate - INTERVAL 45 DAY AS days_back,
  o_orderdate - INTERVAL 1 MONTH AS month_back, o_orderdate - INTERVAL 2 YEAR AS years_back,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(o_orderdate, '%d%m%Y') AS file_stamp
FROM orders
""")
def scalar_dates(t):
    return scalars.scalar_dates(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@check("scalar_arrays", """
WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS words FROM part)
SELECT p_partkey, p_name, array_to_string(list_sort(words), ' ') AS sorted_words,
  array_to_string(words[1:2], ' ') AS first_two,
  array_to_string(list_filter(words, lambda w, i: i % 2 = 1), ' ') AS every_second,
  words[1] || ',' || words[1] AS repeated,
  array_to_string(list_transform(words, lambda w: w || ':' || length(w)), ' ') AS zipped,
  len(list_filter(words, lambda w: length(w) > 5)) = 0 AS all_short, CAST(len(words) AS BIGINT) AS n_words
FROM w
""")
def scalar_arrays(t):
    return scalars.scalar_arrays(t.part.select("p_partkey", "p_name"), "p_name")


@check("scalar_math_cast", """
SELECT p_partkey, p_size, p_retailprice, CAST(p_size // 3 AS BIGINT) AS third, p_size % 3 AS rest,
  abs(p_size - 25) AS off_center, CAST(p_size AS VARCHAR) AS as_text,
  CAST(p_retailprice AS DECIMAL(18,2)) AS as_money,
  TRY_CAST(nullif(substr(CAST(p_size AS VARCHAR), 2, 1), '') AS INTEGER) AS not_a_number,
  CASE WHEN p_retailprice > 1000 THEN CAST(p_retailprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS or_zero,
  least(p_size, 10) AS smaller
FROM part
""")
def scalar_math_cast(t):
    return scalars.scalar_math_cast(
        t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]
    )
