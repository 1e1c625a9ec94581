"""Ordered work inside a key, when one key may hold a third of the table.

A window over ``partitionBy(key)`` puts a whole key into one task. Here the
few hot keys are cut into slices along their order; positions, running sums and
look-backs are computed inside (key, slice), and what earlier slices
contribute is carried in from one summary row per slice. Keys that are not hot
stay in slice 0, so a table without hot keys gets the plain window plan.

The cut points are constants in the plan, so a recomputed task puts every row
into the same slice again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS_CONF = "spark.rowkeeper.hotRows"
HOT_ROWS = 4_000_000  # rows of one key that one task may hold
SAMPLED_ROWS = 2_000  # rows sampled from a key that is just hot
MAX_HOT_KEYS = 4_096  # keys beyond these hold less than 1/4096 of the rows each and stay whole
MAX_SLICES = 16_384  # of all hot keys together; also bounds the carry table
CUTS_SAMPLE = 16  # sampled rows per slice
SEED = 7

SLICE = "_slice"


def column_of(c: str) -> str:
    return c[1:] if c.startswith("-") else c


def is_down(c: str) -> bool:
    """Whether a leading ``-`` asks for descending order; nulls come first upward and last downward."""
    return c.startswith("-")


def sort_columns(order: list[str], reverse: bool = False) -> list[Column]:
    return [F.desc(column_of(c)) if is_down(c) != reverse else F.asc(column_of(c)) for c in order]


def not_after(cut: Column, names: list[str], order: list[str]) -> Column:
    """Whether a cut (a struct with these fields) is at or before the row, in an order that has a direction per column."""
    found = F.lit(True)
    for name, c in reversed(list(zip(names, order))):
        a, b = cut[name], F.col(column_of(c))
        low, high = (b, a) if is_down(c) else (a, b)
        # Upward a null is before everything, downward after.
        before = (low.isNull() & high.isNotNull()) | F.coalesce(low < high, F.lit(False))
        found = before | (a.eqNullSafe(b) & found)
    return found


def hot_rows_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> dict[int, float]:
    """Hash of each of the hottest keys and its estimated rows, from a sample of the key columns.

    At most MAX_HOT_KEYS rows reach the driver. A missed hot key costs time, not
    correctness.
    """
    fraction = min(1.0, SAMPLED_ROWS / limit)
    sampled = df.select(*keys) if keys else df.select(F.lit(1))
    if fraction < 1.0:
        sampled = sampled.sample(fraction, SEED)
    counted = (
        sampled.groupBy(key_hash(keys).alias("key_hash")).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit * fraction)
        .orderBy(F.desc("n")).limit(MAX_HOT_KEYS)
    )
    return {row.key_hash: row.n / fraction for row in counted.collect()}


def cut_points(
    rows: DataFrame, keys: list[str], order: list[str], hot: dict[int, float], slice_rows: int
) -> list[tuple]:
    """(key hash, values of the order columns as text) that cut each hot key into equally filled slices.

    Cuts are quantiles weighted by how often a value was met, so a value that fills slices alone has its own; give
    tie breakers in the order to cut inside it. The sample has CUTS_SAMPLE rows per slice, so its size is bounded like the slices.
    """
    fraction = min(1.0, CUTS_SAMPLE / slice_rows)
    columns = [column_of(c) for c in order]
    sampled = rows.select(key_hash(keys).alias("key_hash"), *columns)
    if fraction < 1.0:
        sampled = sampled.sample(fraction, SEED)
    # One row per hot key.
    wanted = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hot], "key_hash bigint"))
    counted = sampled.join(wanted, "key_hash", "left_semi").groupBy("key_hash", *columns).agg(F.count(F.lit(1)).alias("_met"))
    values = counted.orderBy("key_hash", *sort_columns(order)).select(
        "key_hash", "_met", *[F.col(c).cast("string") for c in columns]
    ).collect()
    found = []
    for hashed, group in groupby(values, key=lambda row: row.key_hash):
        members = list(group)
        step = sum(row[1] for row in members) / math.ceil(hot[hashed] / slice_rows)
        cuts, before, due = [], 0, step
        for row in members:
            # A cut before this value, when the slice is full or this value would fill it over by itself.
            if before and (before >= due or before + row[1] >= due + step):
                cuts.append(tuple(row)[2:])
                due = before + step
            before += row[1]
        found.append((hashed, cuts))
    return found


def with_slices(
    df: DataFrame, keys: list[str], order: list[str], hot: dict[int, float], out: str, probe: DataFrame | None = None
) -> DataFrame:
    """Add the slice number of each row: 0 for keys that are not hot, else 1 and up along the order."""
    slice_rows = max(hot_rows_limit(df) // 2, math.ceil(sum(hot.values()) / MAX_SLICES), 1)
    probe = df if probe is None else probe
    cuts = cut_points(probe, keys, order, hot, slice_rows)
    most = max([len(points) for _, points in cuts], default=0)
    if most == 0:
        return df.withColumn(out, F.lit(0))  # Nothing to cut by: the keys stay whole.
    kinds = [df.schema[column_of(c)].dataType.simpleString() for c in order]
    names = [f"o{i}" for i in range(len(order))]
    as_text = ", ".join(f"{n}: string" for n in names)
    typed = ", ".join(f"{n}: {kind}" for n, kind in zip(names, kinds))
    table = df.sparkSession.createDataFrame(cuts, f"_cut_key bigint, _cuts array<struct<{as_text}>>")
    table = table.withColumn("_cuts", F.col("_cuts").cast(f"array<struct<{typed}>>"))
    # At most MAX_HOT_KEYS rows, which hold MAX_SLICES points together.
    joined = df.join(F.broadcast(table), key_hash(keys) == F.col("_cut_key"), "left")
    strides = F.array(*[F.lit(2**b) for b in reversed(range(most.bit_length()))])
    # Halving search: a stride is taken when the point it leads to is at or below the row.
    found = F.reduce(
        strides, F.lit(0),
        lambda at, stride: F.when(
            (at + stride <= F.size("_cuts")) & not_after(F.get("_cuts", at + stride - 1), names, order), at + stride
        ).otherwise(at),
    )
    return joined.withColumn(out, F.when(F.col("_cuts").isNull(), 0).otherwise(found + 1)).drop("_cut_key", "_cuts")


@dataclass(frozen=True)
class Ordered:
    """Rows with a key and an order; ``add`` gives columns that depend on the order."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    descending: bool
    hot: dict[int, float]

    @property
    def sliced(self) -> bool:
        return bool(self.hot)

    def by(self, order: list[str], descending: bool = False) -> "Ordered":
        """The same slices, scanned in another order that starts with the sliced columns."""
        return replace(self, order=list(order), descending=descending)

    def _sorted(self) -> list[Column]:
        return sort_columns(self.order, self.descending)

    def _carry(self, position, total, sums, previous, last, wholes) -> DataFrame:
        """Per hot (key, slice): what the slices before it contribute."""
        here = F.struct(*[column_of(c) for c in self.order])
        final = F.min_by if self.descending else F.max_by
        parts = [F.count(F.lit(1)).alias("_n")]
        parts += [F.sum(e).alias(f"_sum_{name}") for name, e in {**sums, **wholes}.items()]
        parts += [final(F.struct(e.alias("v")), here).alias(f"_prev_{name}") for name, (e, _) in previous.items()]
        parts += [final(e, F.when(e.isNotNull(), here)).alias(f"_last_{name}") for name, e in last.items()]
        summary = self.df.filter(F.col(SLICE) > 0).groupBy(*self.keys, SLICE).agg(*parts)

        every = Window.partitionBy(*self.keys)
        along = every.orderBy(F.desc(SLICE) if self.descending else F.asc(SLICE))
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.col(k).alias(f"_c_key_{i}") for i, k in enumerate(self.keys)] + [F.col(SLICE).alias("_c_slice")]
        if position:
            carried.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c_position"))
        if total:
            carried.append(F.sum("_n").over(every).alias("_c_total"))
        carried += [F.sum(f"_sum_{name}").over(before).alias(f"_c_sum_{name}") for name in sums]
        carried += [F.sum(f"_sum_{name}").over(every).alias(f"_c_whole_{name}") for name in wholes]
        carried += [F.lag(f"_prev_{name}").over(along).alias(f"_c_prev_{name}") for name in previous]
        carried += [F.last(f"_last_{name}", True).over(before).alias(f"_c_last_{name}") for name in last]
        return summary.select(*carried)

    def add(
        self,
        position: str | None = None,
        total: str | None = None,
        sums: dict[str, Column] | None = None,
        previous: dict[str, tuple[Column, Column]] | None = None,
        last: dict[str, Column] | None = None,
        wholes: dict[str, Column] | None = None,
    ) -> "Ordered":
        """Add columns: 1-based position, rows of the key, running sums up to the row,
        value of the row before (with a default for the first row), latest value
        that is not null up to the row, and sums over the key.
        """
        sums, previous, last, wholes = sums or {}, previous or {}, last or {}, wholes or {}
        if (previous or last) and any(map(is_down, self.order)):
            raise ValueError("values of other rows need an order of one direction")
        df, group, carried_columns = self.df, list(self.keys), []
        if self.sliced:
            group.append(SLICE)
            carry = self._carry(position, total, sums, previous, last, wholes)
            carried_columns = carry.columns
            match = [df[k].eqNullSafe(carry[f"_c_key_{i}"]) for i, k in enumerate(self.keys)]
            match.append(df[SLICE] == carry["_c_slice"])
            # One row per slice of a hot key, at most MAX_SLICES + MAX_HOT_KEYS.
            df = df.join(F.broadcast(carry), reduce(lambda a, b: a & b, match), "left")

        whole = Window.partitionBy(*group)
        w = whole.orderBy(*self._sorted())
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        place = F.row_number().over(w).cast("bigint")

        def carried(name: str, otherwise: Column) -> Column:
            return F.coalesce(F.col(name), otherwise) if self.sliced else otherwise

        added = {}
        if position:
            added[position] = place + carried("_c_position", F.lit(0).cast("bigint"))
        if total:
            added[total] = carried("_c_total", F.count(F.lit(1)).over(whole))
        for name, e in sums.items():
            here = F.sum(e).over(running)
            carry_in = F.col(f"_c_sum_{name}")
            added[name] = F.coalesce(here + carry_in, here, carry_in) if self.sliced else here
        for name, e in wholes.items():
            added[name] = carried(f"_c_whole_{name}", F.sum(e).over(whole))
        for name, (e, default) in previous.items():
            first = default
            if self.sliced:
                from_slice = F.col(f"_c_prev_{name}")
                first = F.when(from_slice.isNull(), default).otherwise(from_slice["v"])
            added[name] = F.when(place == 1, first).otherwise(F.lag(e).over(w))
        for name, e in last.items():
            here = F.last(e, True).over(running)
            added[name] = F.coalesce(here, F.col(f"_c_last_{name}")) if self.sliced else here

        return replace(self, df=df.withColumns(added).drop(*carried_columns))

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE)


def ordered(
    df: DataFrame, keys: list[str], order: list[str], descending: bool = False, hot: dict[int, float] | None = None,
    probe: DataFrame | None = None,
) -> Ordered:
    """Prepare a table for ordered work; the order should be total inside a key. A leading ``-`` on a column means descending.

    Looks at a sample of the keys first, unless the hot ones are given. No keys means one sequence
    over the whole table. ``probe`` is a cheaper frame with the same keys and order columns to sample from.
    """
    keys, order = list(keys), list(order)
    if hot is None:
        hot = hot_keys(df if probe is None else probe, keys, hot_rows_limit(df))
    if hot:
        df = with_slices(df, keys, order, hot, SLICE, probe)
    return Ordered(df, keys, order, descending, hot)


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows in one sequence, without a single sorting task; a leading ``-`` on a column means descending."""
    return ordered(df, [], order).add(position=out).rows()
