"""Keyed and global combiners.

Built-in ones are Spark aggregates, which combine before the shuffle by themselves.  A
custom combiner over Python values runs in two phases: each partition folds its rows to
one accumulator for a key, with a bounded table that is flushed when full, and only
accumulators are shuffled and merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from ..functions.types import key_type, spark_type

#: Keys that one task folds at a time before it sends what it has.
CACHE = 10_000


@dataclass(frozen=True)
class Combiner:
    """Functions over an accumulator; all but ``merge`` have defaults.

    Without ``create`` a key's first input starts its accumulator, so no identity is
    needed and, unlike with a zero that is merged in, a minimum of positive numbers is right.
    """

    merge: Callable[[object, object], object]
    create: Callable[[], object] | None = None
    add: Callable[[object, object], object] | None = None
    extract: Callable[[object], object] | None = None

    def __post_init__(self):
        if self.add is not None and self.create is None:
            raise TypeError("a combiner with add needs create")

    def first(self, value: object) -> object:
        if self.add is not None:
            return self.add(self.create(), value)
        return value if self.create is None else self.merge(self.create(), value)

    def step(self, acc: object, value: object) -> object:
        return self.add(acc, value) if self.add is not None else self.merge(acc, value)

    def finish(self, acc: object) -> object:
        return acc if self.extract is None else self.extract(acc)


def simple_merge(merge) -> Combiner:
    """Input, accumulator and output are of one type."""
    return Combiner(merge)


def add_merge(create, add, merge) -> Combiner:
    """Inputs are folded into an accumulator, which is the output."""
    return Combiner(merge, create, add)


def merge_extract(merge, extract, create=None) -> Combiner:
    """Inputs are accumulators; the output is extracted."""
    return Combiner(merge, create, None, extract)


def full_combine(create, add, merge, extract) -> Combiner:
    return Combiner(merge, create, add, extract)


#: Built-in combiners by name; each is an aggregate with partial aggregation.
BUILTIN: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "count": F.count,
    "distribution": lambda c: F.struct(
        F.count(c).alias("count"), F.sum(c).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max")
    ),
}


def builtin(name: str, value: str = "value") -> Column:
    return BUILTIN[name](F.col(value))


def combine_per_key(
    df: DataFrame,
    combiner: str | Column | Combiner,
    key: str = "key",
    value: str = "value",
    output: object = None,
) -> DataFrame:
    """``key, value``: the combined values of each key.

    ``combiner`` is a built-in's name, an aggregate Column, or a ``Combiner``, which needs
    the type of its ``output``.
    """
    key_type(df.schema[key].dataType)
    if isinstance(combiner, str):
        combiner = builtin(combiner, value)
    if isinstance(combiner, Column):
        return df.groupBy(F.col(key).alias("key")).agg(combiner.alias("value"))
    if output is None:
        raise TypeError("a custom combiner needs the type of its output")
    return _two_phase(df, combiner, key, value, spark_type(output))


def _two_phase(df: DataFrame, c: Combiner, key: str, value: str, output: T.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    ship(df.sparkSession)
    kind = df.schema[key].dataType
    # The key's hash as written by Spark decides the task; the key itself, what is equal.
    keyed = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    arrow_key, arrow_out = to_arrow_type(kind), to_arrow_type(output)

    def frozen(k):
        if isinstance(k, float) and k != k:
            return "NaN", None
        return pickle.dumps(k) if isinstance(k, (dict, list, bytearray)) else k

    def packed(accs: dict) -> pa.RecordBatch:
        keys = pa.array([k for k, _ in accs.values()], arrow_key)
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([pickle.dumps(a) for _, a in accs.values()], pa.binary())], names=["key", "acc"]
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accs: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = frozen(k)
                if f in accs:
                    accs[f] = (k, c.step(accs[f][1], v))
                else:
                    if len(accs) >= CACHE:
                        yield packed(accs)
                        accs = {}
                    accs[f] = (k, c.first(v))
        if accs:
            yield packed(accs)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, acc, empty, keys, outs = None, None, True, [], []
        for batch in batches:
            for k, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = pickle.loads(a)  # noqa: S301  written by ``partial`` above
                if not empty and (k == last or (k != k and last != last)):  # NaN is one key
                    acc = c.merge(acc, a)
                    continue
                if not empty:
                    keys.append(last)
                    outs.append(c.finish(acc))
                last, acc, empty = k, a, False
            if len(keys) >= CACHE:
                yield pa.RecordBatch.from_arrays([pa.array(keys, arrow_key), pa.array(outs, arrow_out)], names=["key", "value"])
                keys, outs = [], []
        if not empty:
            keys.append(last)
            outs.append(c.finish(acc))
        yield pa.RecordBatch.from_arrays([pa.array(keys, arrow_key), pa.array(outs, arrow_out)], names=["key", "value"])

    head = T.StructType([T.StructField("key", kind), T.StructField("acc", T.BinaryType())])
    tail = T.StructType([T.StructField("key", kind), T.StructField("value", output)])
    # Sorted within the partition, accumulators of a key follow each other: no group is built.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.mapInArrow(partial, head).repartition(n, "key").sortWithinPartitions("key").mapInArrow(final, tail)


def combine_globally(df: DataFrame, combiner: str | Column | Combiner, value: str = "value", output: object = None) -> DataFrame:
    """One row with the combined values of all rows."""
    if isinstance(combiner, str):
        combiner = builtin(combiner, value)
    if isinstance(combiner, Column):
        return df.agg(combiner.alias("value"))
    one = df.select(F.lit(0).alias("key"), F.col(value).alias("value"))
    return combine_per_key(one, combiner, output=output).select("value")
