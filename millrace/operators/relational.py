"""Joins, set operations and multi-level aggregates, as the optimizer plans them best.

Nothing here is broadcast by hand: the planner knows the sizes, and adaptive execution
splits skewed keys.  Joins over time or ranges never pair rows beyond those that match.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOW = ("inner", "left", "right", "full", "left_semi", "left_anti")


def join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Rows with equal keys; keys appear once, and a null key meets nothing."""
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    return left.join(right, on, how)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def intersect(left: DataFrame, right: DataFrame, repeated: bool = False) -> DataFrame:
    """Rows that are in both; with ``repeated`` as often as in the one that has fewer."""
    return left.intersectAll(right) if repeated else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, repeated: bool = False) -> DataFrame:
    """Rows of ``left`` that are not in ``right``; with ``repeated`` each takes one away."""
    return left.exceptAll(right) if repeated else left.subtract(right)


def rollup(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by all keys, by all but the last, and so on up to the total.

    ``level`` is the number of keys that are rolled up; those are null.
    """
    level = sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*keys).agg(level.alias("level"), *[c.alias(k) for k, c in aggs.items()])


def cube(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by every subset of the keys; ``level`` is as in ``rollup``."""
    level = sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.cube(*keys).agg(level.alias("level"), *[c.alias(k) for k, c in aggs.items()])


def grouping_sets(df: DataFrame, sets: Iterable[Iterable[str]], keys: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by each of ``sets``, subsets of ``keys``, in one pass over ``df``."""
    wanted = [[F.col(k) for k in s] for s in sets]
    return df.groupingSets(wanted, *keys).agg(*[c.alias(k) for k, c in aggs.items()])


def top_per_key(df: DataFrame, key: str, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, with ``rank`` from 1.

    Each task keeps ``k`` rows of a key before the shuffle, so a hot key is no burden.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def as_of_join(
    left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], tolerance: Column | None = None
) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its time.

    Rows meet within equal ``by``; without one, or with one older than ``tolerance`` (an
    interval), the values are null.  Both sides are tagged, united and sorted once, and the
    last value is carried along: no row is paired.  Rows of ``right`` that tie in time count
    by the greatest values.
    """
    kept = [c for c in left.columns if c not in (time, *by)]
    found = F.struct(F.col(time).alias("at_"), *values)
    nothing = F.lit(None)
    one = left.select(*by, time, F.struct(*kept).alias("row_"), nothing.cast(right.select(found.alias("x")).schema["x"].dataType).alias("found_"))
    two = right.select(*by, time, nothing.cast(one.schema["row_"].dataType).alias("row_"), found.alias("found_"))
    order = Window.partitionBy(*by).orderBy(time, F.col("row_").isNotNull(), "found_").rowsBetween(Window.unboundedPreceding, 0)
    met = one.unionByName(two).withColumn("met_", F.last("found_", ignorenulls=True).over(order)).where("row_ is not null")
    if tolerance is not None:
        met = met.withColumn("met_", F.when(F.col("met_.at_") >= F.col(time) - tolerance, F.col("met_")))
    return met.select(*by, time, "row_.*", *[F.col(f"met_.{v}").alias(v) for v in values])


def interval_join(
    points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int, by: Iterable[str] = ()
) -> DataFrame:
    """Points with each range that holds them: ``low <= at < high``, and equal ``by``.

    Integers are cut into buckets of ``width``: a range is repeated for each bucket that it
    touches, a point has one, and buckets are joined by equality.  Choose a width near the
    usual length of a range.
    """
    bucket = F.floor(F.col(at) / width)
    touched = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("bucket_", F.explode(touched))
    met = points.withColumn("bucket_", bucket).join(spread, ["bucket_", *by])
    return met.where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("bucket_")


def group_into_batches(df: DataFrame, size: int, *order: str, key: str = "key", value: str = "value", salts: int = 1) -> DataFrame:
    """``key, batch, values``: the values of each key in batches of ``size`` at most.

    ``salts`` parts of a key are batched each by itself, so that a hot key is spread; each
    part may end in a batch that is not full.  Batches are filled in ``order``.
    """
    if size < 1 or salts < 1:
        raise ValueError("size and salts must be positive")
    sort = list(order) or [value]
    salted = df.withColumn("salt_", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    place = F.row_number().over(Window.partitionBy(key, "salt_").orderBy(*sort)) - 1
    numbered = salted.withColumn("at_", place).withColumn("batch_", F.expr(f"at_ div {size}"))
    packed = numbered.groupBy(key, "salt_", "batch_").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at_", F.col(value).alias("v_")))), lambda x: x["v_"]).alias("values")
    )
    return packed.select(F.col(key).alias("key"), (F.col("batch_") * salts + F.col("salt_")).alias("batch"), "values")
