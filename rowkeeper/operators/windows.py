"""Window computations (W1-W9). Everything that follows an order goes through ``plans.ordered``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkeeper.plans.ordered import ordered


def retention_candidates(
    df: DataFrame, keys: list[str], ts: str, id: str, type: str, full: str, types: list[str], keep: int
) -> DataFrame:
    """Rows to delete: more than ``keep`` full backups exist at or after the row.

    ``row_num`` is the recency rank inside (key, type), ``full_sets`` the full backups at or after
    the row. One scan gives both: a running count per type.
    """
    counts = {f"_n_{i}": F.when(F.col(type) == t, 1).otherwise(0) for i, t in enumerate(types)}
    scan = ordered(df, keys, [ts, id], descending=True).add(sums=counts).rows()
    own = F.coalesce(*[F.when(F.col(type) == t, F.col(f"_n_{i}")) for i, t in enumerate(types)])
    ranked = scan.withColumn("row_num", own).withColumn("full_sets", F.col(f"_n_{types.index(full)}"))
    return ranked.drop(*counts).filter(F.col("full_sets") > keep)


def chunk_members(placed: DataFrame, keys: list[str], item: str, chunk: str) -> DataFrame:
    """Members of each chunk in order. A chunk holds as many rows as its size says."""
    grouped = placed.groupBy(*keys, F.expr(chunk).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.col(item).cast("string").alias("item")))).alias("_members")
    )
    return grouped.select(
        *keys, "chunk", F.size("_members").cast("bigint").alias("n_members"),
        F.array_join(F.col("_members.item"), ",").alias("members"),
    )


def size_buckets(df: DataFrame, size: str, order: str) -> DataFrame:
    """Ids by their wanted group size, cut into groups of that size; the last may be short."""
    placed = ordered(df.select(size, order), [size], [order]).add(position="_pos").rows()
    return chunk_members(placed, [size], order, f"(_pos - 1) div `{size}`")


def fixed_chunks(df: DataFrame, keys: list[str], order: list[str], n: int, item: str) -> DataFrame:
    placed = ordered(df.select(*dict.fromkeys([*keys, *order, item])), keys, order).add(position="_pos").rows()
    return chunk_members(placed, keys, item, f"(_pos - 1) div {n}")


def drop_top_counts(df: DataFrame, value: str, top: int = 2) -> DataFrame:
    """Values with their counts, without all values that share a count of the first ``top`` ones."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    first = counted.orderBy(F.desc("n"), value).limit(top).select("n")
    return counted.join(first, "n", "left_anti").select(value, "n")


def island_heads(cells: DataFrame, row: str, col: str) -> DataFrame:
    """Set cells with nothing set just above or to the left.

    Each cell reports itself and blocks the cells below and to the right, so one aggregation does
    the work of two anti joins.
    """
    r, c = F.col(row), F.col(col)
    marks = F.explode(F.array(
        F.struct(r.alias(row), c.alias(col), F.lit(0).alias("blocked")),
        F.struct((r + 1).cast(cells.schema[row].dataType).alias(row), c.alias(col), F.lit(1).alias("blocked")),
        F.struct(r.alias(row), (c + 1).cast(cells.schema[col].dataType).alias(col), F.lit(1).alias("blocked")),
    ))
    seen = cells.select(marks.alias("m")).groupBy(F.col(f"m.{row}").alias(row), F.col(f"m.{col}").alias(col)).agg(
        F.min("m.blocked").alias("_set"), F.max("m.blocked").alias("_blocked")
    )
    return seen.filter((F.col("_set") == 0) & (F.col("_blocked") == 0)).select(row, col)


def coverage_rank(df: DataFrame, value: str, fraction: float = 0.5) -> DataFrame:
    """Smallest k such that the k most frequent values cover ``floor(fraction * rows)`` rows.

    Values are grouped by their count first: the number of different counts grows only with the
    square root of the rows, so the one-task window stays small.
    """
    levels = (
        df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("n").agg(F.count(F.lit(1)).alias("n_values"))
        .withColumn("rows_here", F.col("n") * F.col("n_values"))
    )
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    placed = levels.select(
        "n", "rows_here",
        F.coalesce(F.sum("n_values").over(above), F.lit(0)).alias("values_above"),
        F.coalesce(F.sum("rows_here").over(above), F.lit(0)).alias("rows_above"),
        F.greatest(F.floor(F.sum("rows_here").over(every) * fraction), F.lit(1)).alias("needed"),
    ).filter((F.col("rows_above") < F.col("needed")) & (F.col("rows_above") + F.col("rows_here") >= F.col("needed")))
    inside = F.ceil((F.col("needed") - F.col("rows_above")) / F.col("n"))
    return placed.select(
        (F.col("values_above") + inside).cast("bigint").alias("k"),
        (F.col("rows_above") + inside * F.col("n")).cast("bigint").alias("covered_rows"),
    )


def run_changes(df: DataFrame, keys: list[str], order: list[str], col: str, start) -> DataFrame:
    """How often the value changes along a sequence that begins with ``start``."""
    scan = ordered(df.select(*dict.fromkeys([*keys, *order, col])), keys, order).add(
        previous={"_before": (F.col(col), F.lit(start))}
    )
    changed = F.when(~F.col("_before").eqNullSafe(F.col(col)), 1).otherwise(0)
    return scan.rows().groupBy(*keys).agg(F.sum(changed).alias("n_changes"))


def circular_sum(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, out: str = "circular") -> DataFrame:
    """Sum of the next k values of a closed circle, or of the previous -k; 0 gives zeros.

    A circle is passed as often as |k| asks for: whole turns are multiples of the key's total, and the rest is a difference
    of running sums, one of them at another place. That place is reached by a second scan in which each row asks at the place it
    needs, so the cost does not depend on k. As in a plain sum nulls count nothing, and nothing but nulls gives null. Sums of
    floating point values carry the rounding of the running sums; decimals are exact.
    """
    kind = df.select(F.sum(value)).schema[0].dataType
    if k == 0:
        return df.withColumn(out, F.lit(0).cast(kind))
    known = F.when(F.col(value).isNotNull(), 1).otherwise(0)
    first = ordered(df, keys, order).add(
        position="_pos", total="_n", sums={"_sum": F.col(value), "_known": known},
        wholes={"_sum_all": F.col(value), "_known_all": known},
    )
    zero = F.lit(0).cast(kind)
    placed = first.rows().withColumns({
        "_sum": F.coalesce("_sum", zero), "_sum_all": F.coalesce("_sum_all", zero),
        "_turns": F.expr(f"{abs(k)} div _n"), "_rest": F.lit(abs(k)) % F.col("_n"),
    })
    if k > 0:
        # From behind the row up to the place; past the seam it is the rest of the circle and its beginning.
        there = (F.col("_pos") + F.col("_rest") - 1) % F.col("_n") + 1
        seam = F.col("_pos") + F.col("_rest") > F.col("_n")
        own = {"sum": F.col("_sum"), "known": F.col("_known")}
    else:
        # From behind the place up to the row before.
        back = F.col("_pos") - 1 - F.col("_rest")
        there = F.when(back < 0, back + F.col("_n")).otherwise(back)
        seam = back < 0
        own = {"sum": F.col("_sum") - F.coalesce(value, F.lit(0)), "known": F.col("_known") - known}
    row = F.struct(*[F.col(c) for c in df.columns])
    asked = F.struct(
        row.alias("row"), seam.alias("seam"), own["sum"].alias("sum"), own["known"].alias("known"), F.col("_turns").alias("turns"),
        F.col("_sum_all").alias("sum_all"), F.col("_known_all").alias("known_all"),
    )
    told = F.struct(F.col("_sum").alias("sum"), F.col("_known").alias("known"))
    # Two rows per row: what it tells at its own place, and what it asks at another one; telling comes first.
    step = F.explode(F.array(F.struct(F.col("_pos").alias("at"), F.lit(0).alias("asks")), F.struct(there.alias("at"), F.lit(1).alias("asks"))))
    both = placed.select("*", step.alias("_step")).select(
        *keys, F.col("_step.at").alias("_at"), F.col("_step.asks").alias("_asks"),
        F.when(F.col("_step.asks") == 0, told).alias("_told"), F.when(F.col("_step.asks") == 1, asked).alias("_asked"),
    )
    second = ordered(both, keys, ["_at"], hot=first.hot).by(["_at", "_asks"]).add(last={"_there": F.col("_told")})
    answered = second.rows().filter(F.col("_asks") == 1)

    def part(name: str, nothing: Column) -> Column:
        at_place = F.coalesce(F.col("_there")[name], nothing)
        apart = at_place - F.col("_asked")[name] if k > 0 else F.col("_asked")[name] - at_place
        once = F.when(F.col("_asked.seam"), F.col("_asked")[f"{name}_all"]).otherwise(nothing)
        return apart + once + F.col("_asked.turns") * F.col("_asked")[f"{name}_all"]

    found = F.when(part("known", F.lit(0).cast("bigint")) > 0, part("sum", zero).cast(kind))
    return answered.select("_asked.row.*", found.alias(out))


def systematic_sample(
    df: DataFrame, keys: list[str], order: list[str], skip_div: int = 3, step: int = 2
) -> DataFrame:
    """In order, leave out the first n div ``skip_div`` rows, then take every ``step``-th."""
    placed = ordered(df, keys, order).add(position="_pos", total="_n").rows()
    past = F.expr(f"_pos - 1 - _n div {skip_div}")
    return placed.filter((past >= 0) & (past % step == 0)).drop("_n").withColumnRenamed("_pos", "position")
