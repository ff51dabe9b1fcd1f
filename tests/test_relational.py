import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import (
    DoFn,
    as_of_join,
    except_,
    group_into_batches,
    grouping_sets,
    intersect,
    interval_join,
    join,
    par_do,
    rollup,
    top_per_key,
)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def two(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "n"), (4, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "m")], "k int, r string")
    return left, right


def test_joins(two):
    left, right = two
    assert rows(join(left, right, "k")) == [(1, "a", "x")] * 2 + [(1, "a", "y")] * 2
    assert len(rows(join(left, right, "k", "left"))) == 7 and len(rows(join(left, right, "k", "full"))) == 9
    assert rows(join(left, right, "k", "left_semi")) == [(1, "a")] * 2
    assert rows(join(left, right, "k", "left_anti")) == [(2, "b"), (4, "d"), (None, "n")]
    with pytest.raises(ValueError, match="how"):
        join(left, right, "k", "cross")


def test_sets(two):
    left, right = (d.select("k") for d in two)
    assert rows(intersect(left, right)) == [(1,), (None,)]
    assert rows(intersect(left, right, repeated=True)) == [(1,), (1,), (None,)]
    assert rows(except_(left, right)) == [(2,), (4,)] and rows(except_(right, left)) == [(3,)]
    assert rows(except_(left, left.limit(0), repeated=True)) == [(1,), (1,), (2,), (4,), (None,)]


def test_levels(two):
    left, _ = two
    assert rows(rollup(left, ["l"], n=F.count("*"))) == [("a", 0, 2), ("b", 0, 1), ("d", 0, 1), ("n", 0, 1), (None, 1, 5)]
    assert rows(grouping_sets(left, [["l"], []], ["l"], n=F.count("*")))[-1] == (None, 5)
    assert rows(top_per_key(left, "l", 1, F.col("k"))) == [(1, "a", 1), (2, "b", 1), (4, "d", 1), (None, "n", 1)]


def test_as_of_join_against_brute_force(spark):
    draw = random.Random(5)
    left = [(draw.choice([1, 2, None]), draw.randint(0, 30), i) for i in range(60)]
    right = [(draw.choice([1, 2, 3, None]), draw.randint(0, 30), draw.randint(0, 99)) for _ in range(40)]
    df = as_of_join(
        spark.createDataFrame(left, "k int, t int, id int"), spark.createDataFrame(right, "k int, t int, v int"), "t", ["k"], ["v"]
    )
    want = []
    for k, t, i in left:
        found = max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=(None, None))
        want.append((k, t, i, found[1]))
    assert rows(df) == sorted(want, key=str)
    assert as_of_join(spark.createDataFrame(left, "k int, t int, id int"), spark.createDataFrame([], "k int, t int, v int"), "t", ["k"], ["v"]).where("v is not null").count() == 0


def test_as_of_join_with_tolerance(spark):
    left = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 01:00:00' AS t, 'l' AS id")
    right = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' AS t, 7 AS v")
    for minutes, v in ((30, None), (60, 7)):
        got = as_of_join(left, right, "t", ["k"], ["v"], F.expr(f"interval {minutes} minutes"))
        assert got.first()["v"] == v


def test_interval_join_against_brute_force(spark):
    draw = random.Random(6)
    points = [(i, draw.randint(-20, 60)) for i in range(80)]
    ranges = [(j, a := draw.randint(-30, 50), a + draw.randint(-3, 40)) for j in range(30)]
    got = interval_join(
        spark.createDataFrame(points, "p int, at int"), spark.createDataFrame(ranges, "r int, low int, high int"), "at", "low", "high", 10
    )
    want = [(p, r) for p, at in points for r, a, b in ranges if a <= at < b]
    assert rows(got.select("p", "r")) == sorted(want, key=str)


def test_batches(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(7)], "key int, value int")
    assert rows(group_into_batches(df, 2)) == [(0, 0, [0, 2]), (0, 1, [4, 6]), (1, 0, [1, 3]), (1, 1, [5])]
    salted = group_into_batches(spark.createDataFrame([(1, i) for i in range(1000)], "key int, value int"), 10, salts=8).collect()
    assert sorted(v for r in salted for v in r["values"]) == list(range(1000))
    assert max(len(r["values"]) for r in salted) == 10 and len(salted) <= 108 and len({r["batch"] for r in salted}) == len(salted)
    with pytest.raises(ValueError, match="positive"):
        group_into_batches(df, 0)


def test_functions_know_their_task_and_log(spark, capfd):
    class Where(DoFn):
        def process(self, element, emit):
            self.logger.warning("element %s", element)
            emit(self.context.partitionId())

    got = par_do(spark.range(4).repartition(2).select(F.col("id").alias("value")), Where(), int).collect()
    assert {r.value for r in got} == {0, 1}
    assert Where().context is None and Where().logger.name == "millrace.Where"


def test_outputs_are_released(spark):
    outs = par_do(spark.range(4), lambda r: [], {"a": int, "b": int})
    assert outs.tagged.is_cached
    outs.release()
    assert not outs.tagged.is_cached
