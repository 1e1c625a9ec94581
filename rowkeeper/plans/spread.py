"""Writing out many rows for one row, without one task doing all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 100_000


def spread_range(df: DataFrame, first: str, last: str, out: str, step: int = STEP) -> DataFrame:
    """A row for each whole number from ``first`` to ``last``; none when the range is empty.

    The range is cut into steps, the steps are spread over the tasks, and each task writes its steps out.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in df.columns if c not in (first, last)]
    steps = df.filter(F.col(first) <= F.col(last)).withColumn(
        "_step", F.explode(F.expr(f"sequence(cast(`{first}` as bigint), cast(`{last}` as bigint), {step}L)"))
    )
    spread = steps.repartition(parts, *[c for c in kept], "_step")
    stop = F.least(F.col("_step") + step - 1, F.col(last).cast("bigint"))
    return spread.select(*kept, F.explode(F.sequence("_step", stop)).alias(out))


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as it says."""
    counted = df.withColumn("_from", F.lit(1).cast("bigint"))
    return spread_range(counted, "_from", times, "_copy").drop("_copy")
