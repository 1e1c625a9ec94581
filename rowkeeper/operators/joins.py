"""Joins (J1-J15). No size hints on tables: Spark broadcasts a side when its measured size allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeeper.plans.ordered import ordered
from rowkeeper.plans.skew import skew_join
from rowkeeper.plans.spread import spread_range

TASK_ROWS = 1_000_000  # rows of the larger side that one task joins and holds


def history_join(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Distinct columns of an inner join. The right side is the one with several rows per key; its hot keys are
    salted, as the distinct after the join would keep them together. A task sorts both sides and holds its distinct rows, so
    large tables are dealt to more tasks."""
    return skew_join(right, left, keys, task_rows=TASK_ROWS).select(*cols).distinct()


def multi_key_join(left: DataFrame, right: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Join with the right side reduced to one row per key first."""
    return left.join(right.groupBy(*keys).agg(*aggs), keys, "inner")


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    return reduce(lambda df, dim: df.join(dim[0], dim[1], "inner"), dims, fact)


def anti_join(left: DataFrame, right: DataFrame, keys: list[str], right_filter: Column) -> DataFrame:
    return skew_join(left, right.filter(right_filter).select(*keys).distinct(), keys, "left_anti")


def semi_join(left: DataFrame, right: DataFrame, keys: list[str], right_filter: Column) -> DataFrame:
    return skew_join(left, right.filter(right_filter).select(*keys).distinct(), keys, "left_semi")


def update_from_join(target: DataFrame, changes: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Replace a column where the key has a change. Changes are reduced to one per key
    (the largest value) before they are joined."""
    one = changes.groupBy(*keys).agg(F.max(col).alias("_new")).withColumn("_changed", F.lit(1))
    joined = target.join(one, keys, "left")
    updated = F.when(F.col("_changed").isNull(), F.col(col)).otherwise(F.col("_new"))
    return joined.select(*[updated.alias(c) if c == col else F.col(c) for c in target.columns])


def one_row_cross(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row beside the columns of a one-row set, read as a scalar subquery.

    More than one row is an error; no row leaves nothing, as a join would.
    """
    beside = df.withColumn("_one", one_row.select(F.struct("*")).scalar()).filter(F.col("_one").isNotNull())
    return beside.select(*df.columns, *[F.col("_one")[c].alias(c) for c in one_row.columns])


def lateral_values(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Computed columns; each may use the ones before it."""
    return reduce(lambda d, item: d.withColumn(*item), exprs.items(), df)


def directory_lookup(names: DataFrame, directory: DataFrame, key: str) -> DataFrame:
    return names.join(directory, key, "inner")


def dict_lookup(df: DataFrame, col: str, lookup: DataFrame) -> DataFrame:
    """Left join with a (col, value) table; ``missing`` marks keys that the table lacks."""
    found = lookup.withColumn("_found", F.lit(1))
    joined = df.join(found, col, "left")
    return joined.withColumn("missing", F.when(F.col("_found").isNull(), 1).otherwise(0)).drop("_found")


def interval_overlap(a: DataFrame, b: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Intersections of two sets of closed intervals; touching ends give a point.

    Two intervals meet when one holds the start of the other. Sorted by start, the starts that an interval holds are
    a run of ranks: one scan gives the first rank, a second one the last. So only pairs that
    do meet are built, however dense the intervals of a key are.
    """
    sides = {"a": a, "b": b}
    others = {side: [c for c in df.columns if c not in keys] for side, df in sides.items()}

    kinds = {s: df.select(F.struct(*others[s])).schema[0].dataType for s, df in sides.items()}

    def tagged(side: str) -> DataFrame:
        rows = {s: F.struct(*others[s]) if s == side else F.lit(None).cast(kinds[s]) for s in sides}
        return sides[side].select(
            *keys, F.lit(side).alias("_side"), F.col(start).alias("_start"), F.col(end).alias("_end"),
            rows["a"].alias("_a"), rows["b"].alias("_b"),
        )

    is_a, is_b = [F.when(F.col("_side") == side, 1).otherwise(0) for side in "ab"]
    stacked = tagged("a").unionByName(tagged("b")).withColumn("_tie", F.xxhash64("_a", "_b"))
    # At equal starts a comes before b, so a pair with one start is found from its a only. The tie breaker lets slices be cut
    # inside one start; the row itself ends the order: ranks must come out the same in every evaluation.
    cut = ["_start", "_side", "_end", "_tie"]
    by_start = ordered(stacked, keys, cut).by([*cut, "_a", "_b"])
    placed = by_start.add(sums={"_rank_a": is_a, "_rank_b": is_b}).rows()
    starts = stacked.select(*keys, F.col("_start").alias("_pos"), "_side", "_tie", F.lit(0).alias("_kind"))
    ends = placed.withColumn("_pos", F.col("_end")).withColumn("_kind", F.lit(1))
    counted = {f"_last_{s}": F.when((F.col("_side") == s) & (F.col("_kind") == 0), 1).otherwise(0) for s in sides}
    by_end = ordered(ends.unionByName(starts, allowMissingColumns=True), keys, ["_pos", "_kind", "_tie"])
    probes = by_end.add(sums=counted).rows().filter(F.col("_kind") == 1)

    def of_side(x: Column, y: Column) -> Column:
        return F.when(F.col("_side") == "a", x).otherwise(y)

    own = probes.select(
        *keys, "_a", "_b", of_side(F.lit("b"), F.lit("a")).alias("_meets"),
        (of_side(F.col("_rank_b"), F.col("_rank_a")) + 1).alias("_first"),
        of_side(F.col("_last_b"), F.col("_last_a")).alias("_last"),
    )
    held = placed.select(
        *keys, F.col("_side").alias("_meets"), of_side(F.col("_rank_a"), F.col("_rank_b")).alias("_rank"),
        F.col("_a").alias("_held_a"), F.col("_b").alias("_held_b"),
    )
    met = spread_range(own, "_first", "_last", "_rank").join(held, [*keys, "_meets", "_rank"], "inner")
    pairs = met.withColumns({"_a": F.coalesce("_a", "_held_a"), "_b": F.coalesce("_b", "_held_b")})
    columns = [F.col(f"_{s}")[c].alias(f"{c}_{s}") for s in sides for c in others[s]]
    bounds = [
        F.greatest(F.col("_a")[start], F.col("_b")[start]).alias("overlap_start"),
        F.least(F.col("_a")[end], F.col("_b")[end]).alias("overlap_end"),
    ]
    return pairs.select(*keys, *columns, *bounds)


def inventory_match(files: DataFrame, history: DataFrame, path: str) -> DataFrame:
    """Files on disk with their history row, by path in any case."""
    return (
        files.withColumn("_path", F.lower(path))
        .join(history.withColumn("_path", F.lower(path)).drop(path), "_path", "inner")
        .drop("_path")
    )


SHORT_LIST = 1_000  # values that are written into the plan


def dense_scaffold(
    base: DataFrame, domains: dict[str, list | DataFrame], facts: DataFrame | None = None, measure: str | None = None,
    pred: Column | None = None, when: dict[str, Column] | None = None,
) -> DataFrame:
    """Each base row with every combination of values, optionally only those that pass a test; facts fill the measure and what
    has no fact gets 0.

    Domains are added one by one. ``when`` names, for a domain, the test of the columns that are there once it is added; it is
    applied at once, so combinations that fail it meet no further domain. ``pred`` tests whole combinations. A domain is a list
    of values, or a table of one column, which is joined by its test: such a domain needs one.
    """
    tests = dict(when or {})
    dense = base
    for name, values in domains.items():
        test = tests.pop(name, None)
        if isinstance(values, DataFrame):
            if test is None:
                raise ValueError(f"the table domain {name} needs a test that ties it to the columns before it")
            dense = dense.join(values.toDF(name), test)
            continue
        if len(values) <= SHORT_LIST:
            listed = F.array(*[F.lit(v) for v in values])
        else:
            # A list is held by the driver already; it reaches the rows as one value.
            literal = base.sparkSession.createDataFrame([(list(values),)], ["values"])
            listed = literal.select("values").scalar()
        dense = dense.withColumn(name, F.explode(listed))
        if test is not None:
            dense = dense.filter(test)
    if tests:
        raise ValueError(f"tests of unknown domains: {', '.join(tests)}")
    if pred is not None:
        dense = dense.filter(pred)
    if facts is None:
        return dense
    return dense.join(facts, dense.columns, "left").withColumn(measure, F.coalesce(F.col(measure), F.lit(0)))


def nearest_each_side(
    probes: DataFrame, points: DataFrame, keys: list[str], pos: str, limit, label: str
) -> DataFrame:
    """For each probe the nearest point strictly before and strictly after it on its key,
    when the distance is below the limit.

    Probes and points are stacked and scanned once in each direction, so no probe is
    paired with more than one point per side.
    """
    others = [c for c in probes.columns if c not in keys and c != pos]
    probe = probes.select(
        *keys, pos, F.struct(*[F.col(c) for c in others]).alias("_probe"),
        F.lit(None).cast(points.schema[label].dataType).alias("_label"), F.lit(0).alias("_kind"),
    )
    point = points.select(
        *keys, pos, F.lit(None).cast(probe.schema["_probe"].dataType).alias("_probe"),
        F.col(label).alias("_label"), F.lit(1).alias("_kind"),
    )
    # At one position a probe must not meet points of that position: it sorts first in both directions. Each direction is cut along
    # its own order, tie breakers included, so many rows at one position are no single slice.
    stacked = probe.unionByName(point).withColumns({"_back": -F.col("_kind"), "_tie": F.xxhash64("_probe")})
    seen = F.when(F.col("_kind") == 1, F.struct(F.col(pos).alias("at"), F.col("_label").alias("label")))
    ahead = ordered(stacked, keys, [pos, "_kind", "_label", "_tie"])
    back = ordered(
        ahead.add(last={"_before": seen}).rows(), keys, [pos, "_back", "_label", "_tie"], descending=True, hot=ahead.hot, probe=stacked
    )
    scan = back.add(last={"_after": seen})
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])  # As in a join, null meets nothing.
    before = F.when(known & (F.col(pos) - F.col("_before")["at"] < limit), F.col("_before"))
    after = F.when(known & (F.col("_after")["at"] - F.col(pos) < limit), F.col("_after"))
    return scan.rows().filter(F.col("_kind") == 0).select(
        *keys, pos, *[F.col("_probe")[c].alias(c) for c in others],
        before["label"].alias("before_label"), (F.col(pos) - before["at"]).alias("before_distance"),
        after["label"].alias("after_label"), (after["at"] - F.col(pos)).alias("after_distance"),
    )
