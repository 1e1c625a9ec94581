"""Equi joins whose left side may hold a hot key.

Adaptive execution splits a skewed join only when nothing after it relies on its partitioning. Where something does,
or to be independent of the session's settings, the hot keys are salted here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkeeper.plans.ordered import hot_keys, hot_rows_limit, key_hash

MAX_SALTS = 1_024
SALT = "_salt"


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", task_rows: int | None = None) -> DataFrame:
    """Join with the rows of hot left keys spread over salts and their right rows repeated per salt.

    The salt is a hash of the row, so a recomputed task gives a row the same salt. Right joins and full joins
    would repeat unmatched right rows and are refused. The right side should not hold many rows of a hot key.
    With ``task_rows``, the left side is counted, and dealt to more tasks than the session's shuffle partitions when they would get more rows each.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} join cannot repeat its right side")
    limit = hot_rows_limit(left)
    hot = hot_keys(left, keys, limit)
    tasks = math.ceil(left.count() / task_rows) if task_rows else 0
    more = tasks > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(tasks, *by) if more else df

    if not hot:
        return dealt(left, *keys).join(dealt(right, *keys), keys, how)
    salts = [(hashed, min(MAX_SALTS, math.ceil(2 * rows / limit))) for hashed, rows in hot.items()]
    # One row per hot key.
    table = F.broadcast(left.sparkSession.createDataFrame(salts, "_salt_key bigint, _salts int"))

    def with_salts(df: DataFrame) -> DataFrame:
        return df.join(table, key_hash(keys) == F.col("_salt_key"), "left").drop("_salt_key")

    # Maps have no hash; the other columns tell the rows apart.
    hashed = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    own = F.pmod(F.xxhash64(*hashed), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = with_salts(left).withColumn(SALT, own).drop("_salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    repeated = with_salts(right).withColumn(SALT, every).drop("_salts")
    return dealt(salted, *keys, SALT).join(dealt(repeated, *keys, SALT), [*keys, SALT], how).drop(SALT)
