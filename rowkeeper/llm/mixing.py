"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source; each source gets its share of the target size by weight, at most ``most`` times what it has, and the
excess goes to the others. A document is then taken floor(rate) times and once more when a coin, seeded
from its id, falls below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkeeper.llm.common import WORD
from rowkeeper.plans.ordered import ordered
from rowkeeper.session import written

#: Weights of the sources in the order of their names, repeated as long as there are sources.
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # size of the mix against the size of all sources
MOST = 2.0  # a source is repeated this often at most
DIGITS = 13  # hexadecimal digits of a coin: 52 bits, which a double holds
SEED = "mix-1"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def coin(id_col: str, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on the id and the seed only; a null id has one of its own."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row per source with its target; ``sizes`` has a row per ``source`` with its ``source_size``.

    A source whose share by weight exceeds ``most`` times its size is held at that, and the excess is shared again. A source
    is held exactly if its ``most * size / weight`` is no more than the share per weight that is left when all with
    a smaller ratio are held, so one running sum along the ratio replaces the rounds. Both orders (name and ratio)
    are numbered without a single sorting task when there are many sources.
    """
    # A null name sorts last.
    named = sizes.withColumn("_none", F.col("source").isNull().cast("int")).withColumn("_name", F.coalesce("source", F.lit("")))
    placed = ordered(named, [], ["_none", "_name"]).add(position="_at").rows()
    each = F.array(*[F.lit(float(w)) for w in weights])
    weighted = placed.withColumn("_weight", F.get(each, F.pmod(F.col("_at") - 1, F.lit(len(weights))).cast("int")))
    capped = weighted.withColumn("_cap", F.lit(most) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    total = capped.agg(F.sum("source_size").alias("_total"), F.sum("_weight").alias("_all_weights"))
    running = ordered(capped, [], ["_ratio", "_none", "_name"]).add(
        sums={"_caps": F.col("_cap"), "_weights": F.col("_weight")}
    ).rows()
    # One row.
    joined = running.join(F.broadcast(total), F.lit(True))
    room = F.lit(share) * F.col("_total") - (F.col("_caps") - F.col("_cap"))
    level = room / (F.col("_all_weights") - (F.col("_weights") - F.col("_weight")))
    levels = joined.withColumn("_level", level).withColumn("_held", F.col("_ratio") <= F.col("_level"))
    # The share per weight of those that are not held: the level of the first of them.
    first = levels.agg(F.min_by("_level", F.when(~F.col("_held"), F.struct("_ratio", "_none", "_name"))).alias("_share"))
    return levels.join(F.broadcast(first), F.lit(True)).select(
        "source", "source_size",
        F.when(F.col("_held"), F.col("_cap")).otherwise(F.col("_share") * F.col("_weight")).alias("target"),
    )


def _planned(docs: DataFrame, size: Column, weights, share, most, id_col, source_col, seed, keep: list[str]) -> DataFrame:
    """``row`` holds the columns in ``keep``, so that their names meet no others."""
    sized = docs.select(
        F.struct(*keep).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")
    )
    # The tables of sources are written, so that the texts are read once for them and their size is known to joins.
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", "of")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = joined.withColumn("rate", rate)
    extra = (coin("id", seed) < F.col("rate") - F.floor("rate")).cast("bigint")
    return rated.select("row", "size", "source_size", "target", (F.floor("rate") + extra).cast("bigint").alias("copies"))


def mix_plan(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", seed: str = SEED,
) -> DataFrame:
    """Each document's id, size, source_size, target of its source and ``copies``, how often the mix takes it.

    A null or empty text has size 0; a source of size 0 has target 0 and its documents are taken 0 times. Repeated rows are
    documents of their own that share their coin. A null source is a source, after all others. Other columns are
    ignored. Reruns agree.
    """
    planned = _planned(docs, word_count(text_col), weights, share, most, id_col, source_col, seed, [id_col])
    return planned.select("row.*", "size", "source_size", "target", "copies")


def mixed_documents(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", seed: str = SEED,
) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with the columns they came with."""
    planned = _planned(docs, word_count(text_col), weights, share, most, id_col, source_col, seed, docs.columns)
    repeated = planned.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select("row.*")
