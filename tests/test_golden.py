"""Operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from rowkeeper.functions import scalars
from rowkeeper.operators import aggregates, filters, joins, ordering, reshape, windows


def sequence(spark, values, kind="int"):
    """One key with values in order."""
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], f"k string, i int, v {kind}")


def chars(spark, text):
    return sequence(spark, list(text), "string")


def test_char_frequency(spark):
    rows = aggregates.char_frequency(spark.createDataFrame([("google",)], "s string"), "s").collect()
    assert [(r.symbol, r.n) for r in rows] == [("g", 2), ("o", 2), ("e", 1), ("l", 1)]


@pytest.mark.parametrize(("address", "valid"), [
    ("daniyal@gmail.coma", False), ("asd@web.com", True), ("a-b@web.com", True), ("a_b@web.c", True),
    ("a+b@web.com", False), ("a+-b@web.com", True), ("a@b@web.com", False), ("a@web.co.uk", False), ("@web.com", False),
    ("a@.com", False), ("a@we-b.com", False), ("é1@web.com", True), ("a@webcom", False),
])
def test_valid_address(spark, address, valid):
    df = spark.createDataFrame([(address,)], "a string")
    assert df.select(filters.valid_address(F.col("a")).alias("v")).first().v is valid


def test_email_quality_finds_addresses_in_text(spark):
    df = spark.createDataFrame([("en", "Write to <asd@web.com>, or x@y.coma. No at here"), ("de", "nichts")], "l string, t string")
    got = filters.email_quality(df, "t", ["l"]).collect()
    assert {(r.l, r.valid, r.n_addresses) for r in got} == {("en", True, 1), ("en", False, 1)}


def test_token_rule_score(spark):
    df = spark.createDataFrame([(1, "programming is awesome"), (2, "  "), (3, "x\ny")], "id int, t string")
    got = {r.id: (r.n_words, r.score) for r in aggregates.token_rule_score(df, "id", "t").collect()}
    assert got == {1: (3, 4), 2: (0, 0), 3: (2, 3)}


def test_lookup_and_sum_by_key(spark):
    books = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("E", "a"), ("F", "a"), ("G", "z")], "book string, c string")
    prices = spark.createDataFrame([("a", 2), ("b", 4), ("c", 5)], "c string, price int")
    found = joins.dict_lookup(books, "c", prices)
    assert found.filter("missing = 1").select("book").collect()[0].book == "G"
    totals = aggregates.sum_by_key(found.filter("missing = 0"), ["c"], "price").collect()
    assert {(r.c, r.total) for r in totals} == {("a", 6), ("b", 4), ("c", 5)}


def test_size_buckets(spark):
    df = spark.createDataFrame(list(enumerate([2, 1, 2, 2, 3])), "i int, size int")
    got = {(r["size"], r.chunk): r.members for r in windows.size_buckets(df, "size", "i").collect()}
    assert got == {(2, 0): "0,2", (2, 1): "3", (1, 0): "1", (3, 0): "4"}


def test_fixed_chunks(spark):
    df = sequence(spark, [2, 1, 2, 2, 3, 4, 5, 6])
    got = sorted((r.chunk, r.members) for r in windows.fixed_chunks(df, ["k"], ["i"], 2, "v").collect())
    assert got == [(0, "2,1"), (1, "2,2"), (2, "3,4"), (3, "5,6")]


def test_concordance(spark):
    from rowkeeper.plans.concordance import concordance_counts

    got = {r.i: r.n_monotone for r in concordance_counts(sequence(spark, [5, 2, 3, 4]), ["k"], ["i"], "v").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0}


def test_systematic_sample(spark):
    df = sequence(spark, [9, 8, 7, 6, 5, 1, 2, 3, 4])
    assert [r.v for r in windows.systematic_sample(df, ["k"], ["v"]).orderBy("v").collect()] == [4, 6, 8]


def test_island_heads(spark):
    grid = ["X.X", "..X", "..X"]
    cells = [(i, j) for i, line in enumerate(grid) for j, c in enumerate(line) if c == "X"]
    df = spark.createDataFrame(cells, "i int, j int")
    assert {(r.i, r.j) for r in windows.island_heads(df, "i", "j").collect()} == {(0, 0), (0, 2)}


@pytest.mark.parametrize(("values", "k", "covered"), [
    ([5, 5, 2, 3, 3, 3, 3, 5, 2, 7], 2, 7), ([1], 1, 1), ([1, 2, 3, 4], 2, 2), ([1, 1, 1, 2], 1, 3),
])
def test_coverage_rank(spark, values, k, covered):
    got = windows.coverage_rank(sequence(spark, values), "v").collect()
    assert [(r.k, r.covered_rows) for r in got] == [(k, covered)]


@pytest.mark.parametrize("hot", ["2", "4000000"])
def test_interval_overlap(spark, hot):
    spark.conf.set("spark.rowkeeper.hotRows", hot)
    a = spark.createDataFrame([("u", 0, 2), ("u", 5, 10), ("u", 13, 23), ("u", 24, 25)], "k string, s int, e int")
    b = spark.createDataFrame([("u", 1, 5), ("u", 8, 12), ("u", 15, 24), ("u", 25, 26), ("w", 0, 99)], "k string, s int, e int")
    got = joins.interval_overlap(a, b, "s", "e", ["k"]).collect()
    spark.conf.unset("spark.rowkeeper.hotRows")
    assert sorted((r.overlap_start, r.overlap_end) for r in got) == [
        (1, 2), (5, 5), (8, 10), (15, 23), (24, 24), (25, 25)
    ]


def test_interval_overlap_same_and_nested_and_repeated(spark):
    spans = [(0, 10), (0, 10), (2, 3), (3, 3), (10, 12), (20, 30)]
    a = spark.createDataFrame([("u", i, *x) for i, x in enumerate(spans)], "k string, id int, s int, e int")
    b = spark.createDataFrame([("u", i, *x) for i, x in enumerate(reversed(spans))], "k string, id int, s int, e int")
    got = joins.interval_overlap(a, b, "s", "e", ["k"]).collect()
    want = [
        (i, j) for i, (s, e) in enumerate(spans) for j, (t, f) in enumerate(reversed(spans)) if s <= f and t <= e
    ]
    assert sorted((r.id_a, r.id_b) for r in got) == sorted(want)


def test_duplicate_values(spark):
    df = sequence(spark, [4, 3, 2, 7, 8, 2, 3, 1])
    assert sorted(r.v for r in aggregates.duplicate_values(df, ["v"]).collect()) == [2, 3]
    many = sequence(spark, [1, 1, 1, 2])
    assert [r.v for r in aggregates.duplicate_values(many, ["v"]).collect()] == [1, 1]


def test_repeat_rows_across_steps(spark):
    from rowkeeper.plans.spread import spread_range

    df = spark.createDataFrame([("a", 3, 12), ("b", 1, 0), ("c", 7, 7)], "k string, f int, t int")
    got = sorted((r.k, r.n) for r in spread_range(df, "f", "t", "n", step=4).collect())
    assert got == [("a", n) for n in range(3, 13)] + [("c", 7)]


def test_run_changes(spark):
    assert windows.run_changes(chars(spark, "10111"), ["k"], ["i"], "v", "0").first().n_changes == 3


def test_nearest_each_side_on_a_grid(spark):
    points = spark.createDataFrame([(2, 0), (1, 6), (3, 4), (4, 1)], "r int, c int").withColumn("label", F.concat_ws(",", "r", "c"))
    probe = spark.createDataFrame([(3, 5)], "r int, c int")
    axes = {
        "row": ("r", "c"), "column": ("c", "r"), "falling": ("r - c", "r"), "rising": ("r + c", "r"),
    }
    found = {}
    for name, (key, pos) in axes.items():
        def on_axis(df):
            return df.withColumn("key", F.expr(key)).withColumn("pos", F.expr(pos))

        near = joins.nearest_each_side(
            on_axis(probe).select("key", "pos", "r"), on_axis(points).select("key", "pos", "label"), ["key"], "pos", 9, "label"
        ).first()
        found[name] = (near.before_label, near.before_distance, near.after_label, near.after_distance)
    assert found["row"] == ("3,4", 1, None, None)
    assert all(found[n] == (None, None, None, None) for n in ("column", "falling", "rising"))


def test_nearest_is_strict_on_both_sides(spark):
    probes = spark.createDataFrame([("u", 10, "p")], "k string, pos int, name string")
    points = spark.createDataFrame([("u", 10, "same"), ("u", 7, "left"), ("u", 19, "far"), ("v", 9, "other")], "k string, pos int, l string")
    got = joins.nearest_each_side(probes, points, ["k"], "pos", 9, "l").first()
    assert (got.before_label, got.before_distance, got.after_label) == ("left", 3, None)


def test_kth_row(spark):
    divisors = spark.range(1, 13).filter("12 % id = 0")
    assert ordering.kth_row(divisors, ["id"], 3).first().id == 3
    keyed = divisors.withColumn("k", F.lit("x"))
    assert ordering.kth_row(keyed, ["-id"], 2, ["k"]).first().id == 6


def test_scaffold_with_unequal_neighbours(spark):
    places = [f"p{i}" for i in range(5)]
    pred = F.expr(" and ".join(f"{a} <> {b}" for a, b in zip(places, places[1:])))
    words = joins.dense_scaffold(spark.range(1).select(F.lit(1).alias("one")), {p: list("abc") for p in places}, pred=pred)
    words = words.select(F.concat(*places).alias("word"))
    assert words.count() == 48
    assert ordering.kth_row(words, ["word"], 35).first().word == "cabca"


def test_drop_top_counts(spark):
    got = windows.drop_top_counts(chars(spark, "addshjkfhhdsjaaac"), "v").orderBy(F.desc("n"), "v").collect()
    assert [r.v for r in got] == ["j", "s", "c", "f", "k"]


def test_pivot_counts(spark):
    orders = [
        ("David", "3", "Ceviche"), ("Corina", "10", "Beef Burrito"), ("David", "3", "Fried Chicken"),
        ("Carla", "5", "Water"), ("Carla", "5", "Ceviche"), ("Rous", "3", "Ceviche"),
    ]
    df = spark.createDataFrame(orders, "name string, t string, food string").withColumn("t", F.col("t").cast("int"))
    table = aggregates.pivot_counts(df, "t", "food", ["Water", "Ceviche", "Beef Burrito", "Fried Chicken"])
    assert table.columns == ["t", "Beef Burrito", "Ceviche", "Fried Chicken", "Water"]
    assert [tuple(r) for r in table.collect()] == [(3, 0, 2, 1, 0), (5, 0, 1, 0, 1), (10, 1, 0, 0, 0)]


def test_route_average(spark):
    trips = [("u1", "aa", 0), ("u1", "bb", 10), ("u2", "aa", 5), ("u2", "bb", 17), ("u3", "aa", 1), ("u3", "bb", 11)]
    df = spark.createDataFrame(trips, "u string, place string, t int")
    got = aggregates.route_average(df, "u", "place", "t", lambda a, b: b - a).collect()
    assert [(r.start_place, r.end_place, r.n_legs) for r in got] == [("aa", "bb", 3)]
    assert got[0].avg_duration == pytest.approx(32 / 3)


def test_custom_order(spark):
    got = ordering.custom_order(chars(spark, "abcdaaacccmxzzxz"), "v", list("mlpcbaqwerty"), ["i"]).orderBy("rank")
    assert "".join(r.v for r in got.collect()) == "mccccbaaaadxzzxz"


def matrix(spark):
    return spark.createDataFrame([(i, list(w)) for i, w in enumerate(["cba", "daf", "ghi"])], "r int, values array<string>")


def test_sortedness(spark):
    df = spark.createDataFrame([("t", i, *w) for i, w in enumerate(["cba", "daf", "ghi"])], "k string, i int, a string, b string, c string")
    got = {r.column_name: r.is_sorted for r in aggregates.sortedness_check(df, ["k"], ["i"], ["a", "b", "c"]).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_transpose(spark):
    cells = reshape.matrix_cells(matrix(spark), "r", "values")
    got = reshape.transpose(cells, "r", "pos", "value", [0, 1, 2]).orderBy("pos").collect()
    assert [r.row_0 + r.row_1 + r.row_2 for r in got] == ["cdg", "bah", "afi"]
    assert ["".join(r.sorted_values) for r in got] == ["cdg", "abh", "afi"]


def test_covered_length(spark):
    df = spark.createDataFrame([("hello world leetcode",)], "words string")
    assert aggregates.covered_length(df, "words", "welldonehoneyr").first().covered_length == 10


def test_common_multiset(spark):
    rows = [(w, c) for w in ("bella", "label", "roller") for c in w]
    got = aggregates.common_multiset(spark.createDataFrame(rows, "w string, c string"), "w", "c").collect()
    assert sorted(r.c for r in got) == ["e", "l", "l"]


@pytest.mark.parametrize("hot", ["2", "4000000"])
@pytest.mark.parametrize(("k", "want"), [(-2, [5, 9, 12, 8]), (2, [8, 5, 9, 12]), (0, [0, 0, 0, 0]), (3, [12, 10, 16, 13])])
def test_circular_sum(spark, k, want, hot):
    spark.conf.set("spark.rowkeeper.hotRows", hot)
    got = windows.circular_sum(sequence(spark, [5, 7, 1, 4]), ["k"], ["i"], "v", k).orderBy("i").collect()
    spark.conf.unset("spark.rowkeeper.hotRows")
    assert [r.circular for r in got] == want


def test_circular_sum_single_and_around(spark):
    assert windows.circular_sum(sequence(spark, [7]), ["k"], ["i"], "v", 1).first().circular == 7
    assert windows.circular_sum(sequence(spark, [7]), ["k"], ["i"], "v", 2).first().circular == 14


def test_fold_sum(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "v array<double>")
    assert [r.total for r in aggregates.fold_sum(df, "v").collect()] == [6.0, 0.0]


def test_numeric_text_sort(spark):
    df = spark.createDataFrame([("10",), ("9",), ("100",)], "t string")
    assert [r.t for r in ordering.numeric_text_sort(df, "t", ["t"]).orderBy("rank").collect()] == ["9", "10", "100"]


def test_minutes_between_counts_boundaries(spark):
    pairs = [("2024-01-01 00:00:59", "2024-01-01 00:01:00", 1), ("2024-01-01 00:00:00", "2024-01-01 00:00:59", 0),
             ("2024-03-01 00:01:00", "2024-02-28 23:59:30", -1442), ("2023-12-31 23:59:59", "2024-01-01 00:00:00", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, n int").select(
        F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz"), "n"
    )
    for r in df.select(scalars.minutes_between(F.col("a"), F.col("b")).alias("got"), "n").collect():
        assert r.got == r.n


def test_scalar_text(spark):
    row = scalars.scalar_text(spark.createDataFrame([("aB cé",)], "t string"), "t").first()
    assert (row.reversed, row.swapped, row.joined, row.n_chars) == ("éc Ba", "Ab Cé", "aB_cé", 5)


def test_fixed_width(spark):
    from rowkeeper.sources.writers import delimited_lines

    df = spark.createDataFrame([("h1", "short"), ("h2", "x" * 41), ("h3", "y" * 40)], "hash string, body string")
    lines = [r.line for r in delimited_lines(df, ["hash"], body="body").collect()]
    assert lines == ["h1 ;" + "short".ljust(40), "h2 ;" + "x" * 38 + "..", "h3 ;" + "y" * 40]
