import random

import pytest
from pyspark.sql import functions as F

from rowkeeper.plans.ordered import SLICE, ordered, ranked


def rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{rng.randrange(40)}")
        mark = rng.choice([None, None, rng.randrange(9)])
        out.append((key, rng.randrange(300), i, mark, rng.choice([None, 1, 2, 3])))
    return out


def expected(data, descending):
    groups = {}
    for row in data:
        groups.setdefault(row[0], []).append(row)
    out = set()
    for members in groups.values():
        members.sort(key=lambda r: (r[1], r[2]), reverse=descending)
        total, last, prev = None, None, -5
        for pos, (key, at, i, mark, amount) in enumerate(members, 1):
            if amount is not None:
                total = (total or 0) + amount
            if mark is not None:
                last = mark
            out.add((i, pos, len(members), total, prev, last))
            prev = amount
    return out


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("limit", ["40", "200", "4000000"])
def test_scan_matches_plain_loop(spark, descending, limit):
    spark.conf.set("spark.rowkeeper.hotRows", limit)
    data = rows(3)
    df = spark.createDataFrame(data, "k string, at int, i int, mark int, amount int").repartition(5)
    scan = ordered(df, ["k"], ["at", "i"], descending)
    assert scan.sliced == (limit != "4000000")
    got = scan.add(
        position="pos", total="n", sums={"s": F.col("amount")},
        previous={"p": (F.col("amount"), F.lit(-5))}, last={"l": F.col("mark")},
    ).rows()
    assert got.columns == ["k", "at", "i", "mark", "amount", "pos", "n", "s", "p", "l"]
    assert {(r.i, r.pos, r.n, r.s, r.p, r.l) for r in got.collect()} == expected(data, descending)
    spark.conf.unset("spark.rowkeeper.hotRows")


def test_hot_key_is_spread_and_cold_keys_are_not(spark, few_hot_rows):
    df = spark.createDataFrame(rows(5), "k string, at int, i int, mark int, amount int")
    per = ordered(df, ["k"], ["at", "i"]).df.groupBy("k", SLICE).count().collect()
    assert max(r["count"] for r in per) < 120
    assert len([r for r in per if r.k == "hot"]) > 5
    assert {r[SLICE] for r in per if r.k not in ("hot", None)} == {0}


def test_ranked_over_whole_table(spark, few_hot_rows):
    data = [(i, i % 4, f"n{i % 90:02d}") for i in range(500)]
    df = spark.createDataFrame(data, "i int, size int, name string").repartition(4)
    got = {r.i: r.rank for r in ranked(df, ["-size", "name", "i"], "rank").collect()}
    want = sorted(data, key=lambda r: (-r[1], r[2], r[0]))
    assert got == {r[0]: pos for pos, r in enumerate(want, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, at int")
    assert ordered(df, ["k"], ["at"]).add(position="pos").rows().count() == 0
