import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import spark_type
from millrace.functions.types import key_type
from millrace.operators import (
    DoFn,
    co_group_by_key,
    combine_globally,
    combine_per_key,
    compose,
    create,
    expand,
    filter_,
    flat_map,
    flatten,
    full_combine,
    add_merge,
    group_by_key,
    impulse,
    map_,
    merge_extract,
    par_do,
    partition,
    reshuffle,
    simple_merge,
)


def values(df, col="value"):
    return sorted(r[col] for r in df.collect())


@pytest.fixture(scope="module")
def ints(spark):
    return spark.range(10).select(F.col("id").alias("value"))


@pytest.fixture(scope="module")
def keyed(ints):
    return ints.select((F.col("value") % 3).alias("key"), "value")


def test_impulse(spark):
    assert [bytes(r.value) for r in impulse(spark).collect()] == [b""]


def test_create(spark):
    assert [r.value for r in create(spark, 1, 2, 3, 4, 5).collect()] == [1, 2, 3, 4, 5]
    assert values(create(spark, "one", "two", "three")) == ["one", "three", "two"]
    assert create(spark, schema=int).collect() == []
    with pytest.raises(ValueError):
        create(spark)


def test_map_filter_flat_map(ints):
    assert values(map_(ints, value=F.col("value") * 2)) == list(range(0, 20, 2))
    assert values(filter_(ints, F.col("value") > 7)) == [8, 9]
    pairs = flat_map(ints, F.sequence(F.lit(0), "value"), "position", ["value"])
    assert sorted((r.value, r.position) for r in pairs.collect()) == [(n, k) for n in range(10) for k in range(n + 1)]


def test_map_to_a_constant(spark):
    out = par_do(impulse(spark), lambda _: ["squeamish_ossiphrage"], str)
    assert values(out) == ["squeamish_ossiphrage"]


def test_partition_and_flatten(ints):
    even, odd = partition(ints, F.col("value") % 2, 2)
    assert values(even) == [0, 2, 4, 6, 8] and values(odd) == [1, 3, 5, 7, 9]
    assert values(flatten(even, odd)) == list(range(10))
    assert values(flatten(ints, ints)) == sorted(2 * list(range(10)))


def test_partition_out_of_range(ints):
    with pytest.raises(Exception, match="out of range"):
        partition(ints, F.col("value") - 1, 10)[0].collect()


def test_partition_of_negative_keys_keeps_the_sign(spark):
    df = spark.range(-3, 3).select((F.col("id") % 2).alias("m"))
    assert {r.m for r in df.collect()} == {-1, 0, 1}


def test_flatten_checks(ints, spark):
    with pytest.raises(ValueError):
        flatten()
    with pytest.raises(TypeError):
        flatten(ints, create(spark, "a"))


def test_group_by_key(keyed):
    got = {r.key: sorted(r["values"]) for r in group_by_key(keyed).collect()}
    assert got == {0: [0, 3, 6, 9], 1: [1, 4, 7], 2: [2, 5, 8]}


def test_float_keys(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 3), (float("nan"), 4)], "key double, value int")
    assert group_by_key(df).count() == 2


def test_map_keys_are_refused(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("key"), F.lit(1).alias("value"))
    with pytest.raises(TypeError):
        group_by_key(df)


def test_co_group_by_key(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "key bigint, value string")
    b = spark.createDataFrame([(1, 10), (3, 30)], "key bigint, value bigint")
    got = {r.key: (sorted(r.left), sorted(r.right)) for r in co_group_by_key(left=a, right=b).collect()}
    assert got == {1: (["x", "y"], [10]), 2: (["z"], []), 3: ([], [30])}


def test_reshuffle(ints):
    out = reshuffle(ints, 3)
    assert values(out) == list(range(10)) and out.rdd.getNumPartitions() == 3


def test_expand(ints):
    assert values(expand(ints, lambda d: d.where("value > 5"), lambda d: d.where("value < 8"))) == [6, 7]


def test_par_do_outputs(ints):
    class Split(DoFn):
        def process(self, element, emit):
            emit(element, "even" if element % 2 == 0 else "odd")
            if element == 9:
                emit((element, "last"), "marked")

    outs = par_do(ints, Split(), {"even": int, "odd": int, "marked": "value bigint, why string"})
    assert values(outs["even"]) == [0, 2, 4, 6, 8] and values(outs["odd"]) == [1, 3, 5, 7, 9]
    assert [tuple(r) for r in outs["marked"].collect()] == [(9, "last")]


def test_par_do_bundles(ints):
    class Total(DoFn):
        def start_bundle(self):
            self.sum = 0

        def process(self, element, emit):
            self.sum += element

        def finish_bundle(self, emit):
            emit(self.sum)

    got = values(par_do(ints.repartition(3), Total(), int))
    assert len(got) == 3 and sum(got) == 45


def test_par_do_errors_fail_the_job(ints):
    with pytest.raises(Exception, match="ZeroDivisionError"):
        par_do(ints, lambda v: [1 // v], int).collect()
    with pytest.raises(Exception, match="no output named"):
        class Wrong(DoFn):
            def process(self, element, emit):
                emit(element, "nowhere")

        par_do(ints, Wrong(), {"a": int, "b": int})["a"].collect()


def test_compose_is_one_hop(ints):
    out = par_do(ints, compose(lambda v: [v, v + 100], lambda v: [v * 2] if v % 2 == 0 else []), int)
    assert values(out) == sorted(2 * v for v in [*range(0, 10, 2), *range(100, 110, 2)])
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


MEAN = full_combine(
    create=lambda: (0, 0), add=lambda a, v: (a[0] + 1, a[1] + v),
    merge=lambda a, b: (a[0] + b[0], a[1] + b[1]), extract=lambda a: a[1] / a[0],
)


def test_sum_by_key(keyed):
    assert {r.key: r.value for r in combine_per_key(keyed, "sum").collect()} == {0: 18, 1: 12, 2: 15}


def test_sum_and_mean_of_one_key(ints):
    one = ints.select(F.lit(0).cast("bigint").alias("key"), "value")
    assert [tuple(r) for r in combine_per_key(one, "sum").collect()] == [(0, 45)]
    assert [tuple(r) for r in combine_per_key(one, MEAN, output=float).collect()] == [(0, 4.5)]
    assert [tuple(r) for r in combine_per_key(one, "mean").collect()] == [(0, 4.5)]


def test_builtin_combiners_aggregate_before_the_shuffle(keyed):
    assert "partial_sum" in combine_per_key(keyed, "sum")._jdf.queryExecution().executedPlan().toString()


def test_minimum_of_positive_numbers(spark):
    df = spark.createDataFrame([(1, 3), (1, 5), (1, 7)], "key bigint, value bigint")
    for c in ("min", simple_merge(min)):
        assert combine_per_key(df, c, output=int).first().value == 3


def test_all_kinds_of_combiner(keyed):
    kinds = {
        "simple": (simple_merge(lambda a, b: a + b), int, {0: 18, 1: 12, 2: 15}),
        "add": (add_merge(lambda: 0, lambda a, v: a + 1, lambda a, b: a + b), int, {0: 4, 1: 3, 2: 3}),
        "extract": (merge_extract(max, str), str, {0: "9", 1: "7", 2: "8"}),
        "full": (MEAN, float, {0: 4.5, 1: 4.0, 2: 5.0}),
    }
    for c, out, want in kinds.values():
        assert {r.key: r.value for r in combine_per_key(keyed, c, output=out).collect()} == want


def test_custom_combiner_under_any_partitioning(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None, "c"]), draw.randrange(100)) for _ in range(400)]
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    for n in (1, 3, 11):
        df = spark.createDataFrame(rows, "key string, value bigint").repartition(n)
        got = {r.key: r.value for r in combine_per_key(df, MEAN, output=float).collect()}
        assert got == {k: sum(v) / len(v) for k, v in want.items()}


def test_custom_combiner_flushes_a_full_table(spark, monkeypatch):
    from millrace.operators import combine

    monkeypatch.setattr(combine, "CACHE", 10)
    df = spark.range(1000).select((F.col("id") % 100).alias("key"), F.lit(1).cast("bigint").alias("value"))
    got = combine_per_key(df, simple_merge(lambda a, b: a + b), output=int).collect()
    assert len(got) == 100 and all(r.value == 10 for r in got)


def test_custom_combiner_groups_odd_keys(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1), (nan, 2), (0.0, 3), (-0.0, 4), (None, 5)], "key double, value bigint").repartition(3)
    got = combine_per_key(df, simple_merge(lambda a, b: a + b), output=int).collect()
    assert sorted(r.value for r in got) == [3, 5, 7]


def test_combine_globally(ints):
    assert combine_globally(ints, "sum").first().value == 45
    assert combine_globally(ints, MEAN, output=float).first().value == 4.5


def test_combiner_checks(keyed):
    with pytest.raises(TypeError):
        add_merge(None, lambda a, v: a, lambda a, b: a)
    with pytest.raises(TypeError):
        combine_per_key(keyed, MEAN)


def test_types():
    assert spark_type(int) == T.LongType() and spark_type("uint64") == T.DecimalType(20, 0)
    assert spark_type(list[str]) == T.ArrayType(T.StringType()) and spark_type(str | None) == T.StringType()
    assert spark_type(dict[str, int]) == T.MapType(T.StringType(), T.LongType())
    with pytest.raises(TypeError):
        spark_type(object)
    with pytest.raises(TypeError):
        key_type(T.StructType([T.StructField("m", T.MapType(T.StringType(), T.LongType()))]))


def test_values_round_trip(spark):
    row = (True, 1, 2, 3, 4, 1.5, 2.5, "é", b"x", {"a": None}, None)
    schema = "b boolean, i8 tinyint, i16 smallint, i32 int, i64 bigint, f float, d double, s string, y binary, m map<string,bigint>, n string"
    df = spark.createDataFrame([row], schema)
    out = par_do(df, lambda r: [r], df.schema)
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in df.collect()]
