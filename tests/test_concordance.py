import random

import pytest

from rowkeeper.plans.concordance import concordance_counts


@pytest.mark.parametrize("limit", ["60", "4000000"])
def test_counts_match_loop(spark, limit):
    spark.conf.set("spark.rowkeeper.hotRows", limit)
    rng = random.Random(4)
    data = [("hot" if i % 3 == 0 else f"k{i % 20}", i, rng.randrange(30)) for i in range(900)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(4)
    got = {
        r.i: (r.earlier_smaller, r.earlier_greater, r.later_smaller, r.later_greater)
        for r in concordance_counts(df, ["k"], ["i"], "v").collect()
    }
    spark.conf.unset("spark.rowkeeper.hotRows")
    for k, i, v in data:
        same = [(j, w) for key, j, w in data if key == k]
        assert got[i] == (
            sum(j < i and w < v for j, w in same), sum(j < i and w > v for j, w in same),
            sum(j > i and w < v for j, w in same), sum(j > i and w > v for j, w in same),
        )
