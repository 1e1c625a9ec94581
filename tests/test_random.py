"""Operators against brute force on random tables with a hot key, on the plain and on the sliced path."""

import datetime as dt
import random

import pytest

from rowkeeper.operators import joins, windows

LIMITS = ["25", "4000000"]


@pytest.fixture(params=LIMITS)
def either_path(spark, request):
    spark.conf.set("spark.rowkeeper.hotRows", request.param)
    yield
    spark.conf.unset("spark.rowkeeper.hotRows")


def keyed(rng, n):
    return [("hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None]), i) for i in range(n)]


def test_interval_overlap(spark, either_path):
    rng = random.Random(11)

    def spans(n):
        out = []
        for key, i in keyed(rng, n):
            start = rng.randrange(400)
            out.append((key, i, start, start + rng.choice([0, 1, 5, 30, 200])))
        return out

    a, b = spans(150), spans(120)
    schema = "k string, id int, s int, e int"
    got = joins.interval_overlap(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "s", "e", ["k"])
    want = sorted(
        (x[1], y[1], max(x[2], y[2]), min(x[3], y[3]))
        for x in a for y in b if x[0] == y[0] and x[0] is not None and x[2] <= y[3] and y[2] <= x[3]
    )
    assert sorted((r.id_a, r.id_b, r.overlap_start, r.overlap_end) for r in got.collect()) == want


def test_interval_overlap_of_times(spark, either_path):
    day = dt.datetime(2024, 1, 1)
    rows = [("u", i, day + dt.timedelta(hours=i), day + dt.timedelta(hours=i + 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, id int, s timestamp_ntz, e timestamp_ntz")
    got = joins.interval_overlap(df, df, "s", "e", ["k"])
    assert got.count() == sum(abs(i - j) <= 2 for i in range(60) for j in range(60))


def test_nearest_each_side(spark, either_path):
    rng = random.Random(12)
    probes = [(k, i, rng.randrange(300)) for k, i in keyed(rng, 150)]
    points = [(k, i, rng.randrange(300)) for k, i in keyed(rng, 120)]
    got = joins.nearest_each_side(
        spark.createDataFrame(probes, "k string, id int, pos int"),
        spark.createDataFrame(points, "k string, label int, pos int"), ["k"], "pos", 9, "label",
    ).collect()
    assert len(got) == len(probes)
    for r in got:
        near = [
            (abs(p - r.pos), p < r.pos, label) for k, label, p in points
            if k is not None and k == r.k and 0 < abs(p - r.pos) < 9
        ]
        for side, distance, label in ((True, r.before_distance, r.before_label), (False, r.after_distance, r.after_label)):
            there = [(d, lab) for d, before, lab in near if before is side]
            assert distance == min([d for d, _ in there], default=None)
            assert label is None if not there else (distance, label) in there


def test_nearest_in_time(spark):
    day = dt.datetime(2024, 1, 1)
    probes = spark.createDataFrame([("u", day, 1)], "k string, t timestamp_ntz, id int")
    points = spark.createDataFrame(
        [("u", day - dt.timedelta(minutes=5), "near"), ("u", day + dt.timedelta(hours=2), "far")],
        "k string, t timestamp_ntz, l string",
    )
    got = joins.nearest_each_side(probes, points, ["k"], "t", dt.timedelta(hours=1), "l").first()
    assert (got.before_label, got.before_distance, got.after_label) == ("near", dt.timedelta(minutes=5), None)


@pytest.mark.parametrize("k", [4, -4])
def test_circular_sum(spark, either_path, k):
    rng = random.Random(13)
    rows = [(key, i, rng.randrange(50)) for key, i in keyed(rng, 200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.i: r.circular for r in windows.circular_sum(df, ["k"], ["i"], "v", k).collect()}
    groups = {}
    for key, i, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(key, []).append((i, v))
    for members in groups.values():
        n = len(members)
        for at, (i, _) in enumerate(members):
            steps = range(1, k + 1) if k > 0 else range(k, 0)
            assert got[i] == sum(members[(at + s) % n][1] for s in steps)


def test_whole_circle_is_total_minus_self(spark, either_path):
    rows = [("u", i, i * i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    total = sum(v for _, _, v in rows)
    for r in windows.circular_sum(df, ["k"], ["i"], "v", 59).collect():
        assert r.circular == total - r.v


def test_chunk_sizes_add_up(spark, either_path):
    rng = random.Random(14)
    df = spark.createDataFrame(keyed(rng, 333), "k string, i int")
    got = windows.fixed_chunks(df, ["k"], ["i"], 4, "i").collect()
    assert sum(r.n_members for r in got) == 333 and max(r.n_members for r in got) == 4
    assert sorted(int(i) for r in got for i in r.members.split(",")) == list(range(333))
