import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.operators import OffsetRange, RangeTracker, StatefulFn, as_side_iter, as_side_map, explode_range
from millrace.operators import full_combine, process_ranges, simple_merge, split_ranges, stateful_par_do
from millrace.operators.state import Bag, Combining, Map, MultiMap, OrderedList, Set, Value, windowed_bag

# Classes of a test module cannot be imported by the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(10).select((F.col("id") % 3).alias("key"), F.col("id").alias("value"))


def test_side_iter(spark, keyed):
    main = spark.range(1).select(F.lit("m").alias("m"))
    side = as_side_iter(keyed.select(F.col("value").alias("s")))
    assert sorted(r.s for r in side.join(main).collect()) == list(range(10))
    assert "BroadcastNestedLoopJoin" in side.join(main)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="more than 3"):
        as_side_iter(keyed, bound=3).join(main)


def test_side_map(spark, keyed):
    main = spark.createDataFrame([(0,), (1,), (7,), (None,)], "k bigint")
    side = as_side_map(keyed)
    got = sorted((r.k, r.side_value) for r in side.get(main, F.col("k")).collect())
    assert got == [(0, 0), (0, 3), (0, 6), (0, 9), (1, 1), (1, 4), (1, 7)]
    missing = [r.k for r in side.get(main, F.col("k"), missing=True).where("side_value is null").collect()]
    assert sorted(missing, key=str) == [7, None]
    assert sorted(r.k for r in side.having(main, F.col("k")).collect()) == [0, 1]
    assert sorted((r.k for r in side.lacking(main, F.col("k")).collect()), key=str) == [7, None]
    assert sorted(r.key for r in side.keys().collect()) == [0, 1, 2]
    plan = side.get(main, F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    large = as_side_map(keyed, bound=2).get(main, F.col("k"))
    assert sorted((r.k, r.side_value) for r in large.collect()) == got


def test_side_checks(spark, keyed):
    with pytest.raises(TypeError):
        as_side_iter([1])
    with pytest.raises(ValueError):
        as_side_map(keyed, "nokey")
    with pytest.raises(ValueError):
        as_side_iter(spark.readStream.format("rate").load())


class Totals(StatefulFn):
    """The sum of the bag after each value; the bag is emptied at three values."""

    bag = Bag()

    def process(self, key, row, emit):
        self.bag.append(row["value"])
        held = list(self.bag.read())
        emit((key, sum(held)))
        if len(held) == 3:
            self.bag.clear()


BAG = [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 2, 1), (5, 1, 4), (6, 1, 5), (7, 2, 3)]
WANT = sorted([(1, 1), (1, 3), (1, 6), (1, 4), (1, 9), (2, 1), (2, 4)])


def test_bag(spark):
    df = spark.createDataFrame(BAG, "seq bigint, key bigint, value bigint").repartition(3)
    got = stateful_par_do(df, Totals(), "key bigint, total bigint", order_by="seq").collect()
    assert sorted(map(tuple, got)) == WANT
    native = windowed_bag(df, "key", "value", ["seq"], 3).select("key", "total").collect()
    assert sorted(map(tuple, native)) == WANT


def test_stateful_checks(spark, keyed):
    class Stateless(StatefulFn):
        pass

    with pytest.raises(TypeError, match="no state"):
        stateful_par_do(keyed, Stateless(), int, order_by="value")
    with pytest.raises(TypeError):
        stateful_par_do(keyed, lambda k, r, e: None, int, order_by="value")
    with pytest.raises(ValueError, match="order_by"):
        stateful_par_do(keyed, Totals(), "key bigint, total bigint")


class Everything(StatefulFn):
    def __init__(self):
        self.value, self.names, self.seen = Value(), Map(), Set()
        self.many, self.ordered = MultiMap(), OrderedList()
        self.mean = Combining(full_combine(lambda: (0, 0), lambda a, v: (a[0] + 1, a[1] + v), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a: a[1] / a[0]))
        self.top = Combining(simple_merge(max))

    def process(self, key, row, emit):
        v = row["value"]
        before = self.value.read(-1)
        self.value.write(v)
        self.names.put(v % 2, v)
        fresh = self.seen.add(v % 2)
        self.many.put(v % 2, v)
        self.ordered.add(-v, v)
        self.mean.add(v)
        self.top.add(v)
        text = f"{before}/{sorted(self.names.items())}/{fresh}/{list(self.many.get(v % 2))}/{[x for _, x in self.ordered.read()]}/{self.mean.read()}/{self.top.read()}"
        emit((key, v, text))
        if v == 7:
            self.names.remove(1)
            self.value.clear()
            self.ordered.clear_range(-7, 0)


def test_all_cells(spark, keyed):
    got = stateful_par_do(keyed, Everything(), "key bigint, value bigint, text string", order_by="value").collect()
    by = {(r.key, r.value): r.text for r in got}
    assert len(by) == 10
    assert by[1, 7] == "4/[(0, 4), (1, 7)]/False/[1, 7]/[7, 4, 1]/4.0/7"
    assert by[0, 9] == "6/[(0, 6), (1, 9)]/False/[3, 9]/[9, 6, 3, 0]/4.5/9"


def test_bag_in_streaming(spark, tmp_path):
    df = spark.createDataFrame(BAG, "seq bigint, key bigint, value bigint").coalesce(1).sortWithinPartitions("seq")
    from millrace.streaming import run_available

    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    from millrace.streaming import run_available

    out = stateful_par_do(stream, Totals(), "key bigint, total bigint")
    got = run_available(out, str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()
    assert sorted(map(tuple, got)) == WANT


def test_all_cells_in_streaming(spark, keyed, tmp_path):
    from millrace.streaming import run_available

    keyed.coalesce(1).sortWithinPartitions("value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(keyed.schema).parquet(str(tmp_path / "in"))
    out = stateful_par_do(stream, Everything(), "key bigint, value bigint, text string")
    got = run_available(out, str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()
    batch = stateful_par_do(keyed, Everything(), "key bigint, value bigint, text string", order_by="value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


class Alarm(StatefulFn):
    """Counts elements and reports when a timer is due."""

    n = Value()

    def process(self, key, row, emit):
        self.n.write(self.n.read(0) + 1)
        self.set_timer(1)

    def timer(self, key, time_ms, emit):
        emit((key, self.n.read()))


def test_timers(spark, keyed, tmp_path):
    import time

    keyed.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(keyed.schema).parquet(str(tmp_path / "in"))
    out = stateful_par_do(stream, Alarm(), "key bigint, n bigint")
    query = out.writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(120):
            got = sorted(map(tuple, spark.table("alarms").collect()))
            if len(got) >= 3:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert got == [(0, 4), (1, 3), (2, 3)]


def test_range_tracker():
    t = RangeTracker(OffsetRange(3, 6))
    assert t.start() == 3 and t.try_claim(3) and t.progress() == (1, 2)
    with pytest.raises(ValueError):
        t.try_claim(3)
    assert t.try_claim(5) and t.is_done() and not t.try_claim(6)
    with pytest.raises(ValueError):
        OffsetRange(2, 1)


@pytest.mark.parametrize(("claimed", "fraction", "kept", "rest"), [(0, 0.5, (0, 6), (6, 10)), (0, 0.0, (0, 1), (1, 10)), (8, 0.5, None, None), (0, 1.0, None, None)])
def test_range_splits(claimed, fraction, kept, rest):
    t = RangeTracker(OffsetRange(0, 10))
    t.try_claim(claimed)
    given = t.try_split(fraction)
    assert given == (None if rest is None else OffsetRange(*rest))
    if kept:
        assert t.range == OffsetRange(*kept)


def test_ranges_split_evenly():
    parts = list(OffsetRange(0, 10).split(4))
    assert parts == [OffsetRange(0, 4), OffsetRange(4, 8), OffsetRange(8, 10)] and list(OffsetRange(2, 2).split(4)) == []


def test_range_expansion(spark):
    df = spark.range(10)
    want = [(n, k) for n in range(10) for k in range(n + 1)]
    native = explode_range(df, F.lit(0), F.col("id") + 1)
    assert sorted(map(tuple, native.collect())) == want and len(want) == 55
    for most in (2, 100):
        got = process_ranges(df, lambda r: OffsetRange(0, r["id"] + 1), lambda r, p: (p + 1, [(r["id"], p)]), "id bigint, p bigint", most)
        assert sorted(map(tuple, got.collect())) == want
    assert explode_range(df, F.lit(5), F.lit(5)).count() == 0


def test_split_ranges(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 5, 5), (3, 2, 3)], "id bigint, low bigint, high bigint")
    got = sorted(map(tuple, split_ranges(df, "low", "high", 4).collect()))
    assert got == [(1, 0, 4), (1, 4, 8), (1, 8, 10), (3, 2, 3)]


@pytest.mark.parametrize("fraction", [-5.0, -0.5, 0.0])
def test_claimed_positions_are_never_given_away(fraction):
    t = RangeTracker(OffsetRange(0, 10))
    for i in range(5):
        assert t.try_claim(i)
    assert t.try_split(fraction) == OffsetRange(5, 10) and t.is_done()
    assert RangeTracker(OffsetRange(0, 10)).try_split(7.5) is None


def test_long_ranges_are_unfolded_in_blocks(spark):
    from millrace.operators import explode_range

    df = spark.createDataFrame([(1, 0, 200_001), (2, 5, 5), (3, -3, 1)], "k int, low bigint, high bigint")
    got = explode_range(df, F.col("low"), F.col("high")).groupBy("k").agg(F.count("*").alias("n"), F.min("position").alias("a"), F.max("position").alias("b"))
    assert sorted(map(tuple, got.collect())) == [(1, 200_001, 0, 200_000), (3, 4, -3, 0)]
    assert "_" not in explode_range(df, F.col("low"), F.col("high")).columns[-1]


class _Keys(StatefulFn):
    seen, by, many = Set(), Map(), MultiMap()

    def process(self, key, row, emit):
        import json

        value = json.loads(row["j"])
        fresh = self.seen.add(value)
        self.by.put(value, row["n"])
        self.many.put(value, row["n"])
        emit((key, row["n"], fresh, len(self.seen.read()), len(self.by.keys()), len(list(self.many.get(value)))))


def test_state_keys_of_any_type_alike_in_batch_and_stream(spark, tmp_path):
    values = ["1", "true", "1.0", "[1, 2]", '{"a": 1, "b": [2]}', "[1, 2]", '{"b": [2], "a": 1}', "null", "1", '"1"']
    rows = [(1, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "key bigint, n bigint, j string").coalesce(1)
    out = "key bigint, n bigint, fresh boolean, held bigint, entries bigint, listed bigint"
    got = sorted(map(tuple, stateful_par_do(df, _Keys(), out, order_by="n").collect()))
    assert [r[2] for r in got] == [True, True, True, True, True, False, False, True, False, True]
    assert got[-1][3:] == (7, 7, 1) and got[5][5] == 2
    from millrace.streaming import run_available

    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streamed = run_available(stateful_par_do(stream, _Keys(), out), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, streamed.collect())) == got
