"""Element-wise and grouping transforms.

Columns are the default: ``map_``, ``filter_``, ``flat_map`` and ``partition`` take
expressions, which Catalyst plans with the rest of the query.  ``par_do`` runs opaque
Python functions over Arrow batches, and feeds several outputs from one pass.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from ..functions.types import key_type, spark_type


def impulse(spark: SparkSession) -> DataFrame:
    """One row with an empty byte string."""
    return spark.range(1).select(F.lit(bytearray()).alias("value"))


def create(spark: SparkSession, *values: object, schema: object = None) -> DataFrame:
    """Literal values as a column ``value``; ``schema`` where it cannot be told from them."""
    if schema is None:
        if not values:
            raise ValueError("create() without values needs a schema")
        schema = spark_type(type(values[0]))
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("value", spark_type(schema))]))


def map_(df: DataFrame, *columns: Column, **named: Column) -> DataFrame:
    """One row for each row: the given expressions."""
    return df.select(*columns, *[c.alias(k) for k, c in named.items()])


def filter_(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def flat_map(df: DataFrame, array: Column, name: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    """A row for each entry of ``array``; none where it is empty or null."""
    return df.select(*keep, F.explode(array).alias(name))


def partition(df: DataFrame, index: Column, n: int) -> list[DataFrame]:
    """``n`` DataFrames by index.  An index outside 0..n-1 is an error, not a lost row.

    The branches are filters of one plan, which are pushed to its scan; persist ``df``
    where making it is dear and several branches are used.
    """
    checked = F.when((index >= 0) & (index < n), index).otherwise(
        F.raise_error(F.concat(F.lit("partition index out of range: "), index.cast("string"))).cast("int")
    )
    return [df.where(checked == i) for i in range(n)]


def flatten(*dfs: DataFrame) -> DataFrame:
    """All rows of all inputs; no deduplication and no order."""
    if not dfs:
        raise ValueError("flatten() needs an input")
    for df in dfs[1:]:
        if [f.dataType for f in df.schema] != [f.dataType for f in dfs[0].schema]:
            raise TypeError("flatten() needs inputs of one type")
    return reduce(DataFrame.unionByName, dfs)


def group_by_key(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``key, values``: the values of each key, in no particular order.

    A group becomes one array; prefer ``combine_per_key``, which never builds it.
    """
    key_type(df.schema[key].dataType)
    return df.groupBy(key).agg(F.collect_list(value).alias("values"))


def co_group_by_key(key: str = "key", value: str = "value", **inputs: DataFrame) -> DataFrame:
    """``key`` and an array of values for each named input, for keys of any of them.

    One tagged union and one aggregation: the inputs are shuffled once.
    """
    tagged = flatten(
        *[
            df.select(
                F.col(key).alias("key"),
                *[
                    (F.col(value) if k == name else F.lit(None).cast(d.schema[value].dataType)).alias(k)
                    for k, d in inputs.items()
                ],
            )
            for name, df in inputs.items()
        ]
    )
    return tagged.groupBy("key").agg(*[F.collect_list(k).alias(k) for k in inputs])


def reshuffle(df: DataFrame, n: int | None = None) -> DataFrame:
    """The same rows, dealt out evenly anew."""
    return df.repartition(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def expand(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply composites, functions from DataFrame to DataFrame, in turn."""
    for step in steps:
        df = df.transform(step)
    return df


class DoFn:
    """A function over the elements of a partition, with hooks around them.

    ``process`` gets an element (the value of a single column named ``value``, or a dict
    of columns) and an ``emit``: ``emit(v)`` for a single output, ``emit(v, "name")``
    with several.  One instance serves one partition.
    """

    @property
    def logger(self) -> logging.Logger:
        """Named by the class; it writes to the executor's log."""
        return logging.getLogger(f"millrace.{type(self).__name__}")

    @property
    def context(self) -> TaskContext | None:
        """The running task: partition, attempt, stage; None outside of one."""
        return TaskContext.get()

    def start_bundle(self) -> None: ...

    def process(self, element: object, emit: Callable[..., None]) -> None:
        raise NotImplementedError

    def finish_bundle(self, emit: Callable[..., None]) -> None: ...


class _Function(DoFn):
    def __init__(self, fn: Callable[[object], Iterable[object]]):
        self.fn = fn

    def process(self, element, emit):
        for out in self.fn(element):
            emit(out)


class _Chain(DoFn):
    def __init__(self, fns: list[DoFn]):
        self.fns = fns

    def start_bundle(self):
        for f in self.fns:
            f.start_bundle()

    def _emit(self, i: int, emit):
        if i == len(self.fns):
            return emit
        return lambda v: self.fns[i].process(v, self._emit(i + 1, emit))

    def process(self, element, emit):
        self._emit(0, emit)(element)

    def finish_bundle(self, emit):
        for i, f in enumerate(self.fns):
            f.finish_bundle(self._emit(i + 1, emit))


def compose(*fns: DoFn | Callable[[object], Iterable[object]]) -> DoFn:
    """Several functions as one, so that rows go to Python and back only once."""
    return _Chain([f if isinstance(f, DoFn) else _Function(f) for f in fns])


def _struct(schema: object) -> T.StructType:
    kind = spark_type(schema) if not isinstance(schema, (T.StructType, str)) else schema
    if isinstance(kind, str):
        kind = T._parse_datatype_string(kind)
    if not isinstance(kind, T.StructType):
        kind = T.StructType([T.StructField("value", kind)])
    return kind


class Outputs(dict):
    """Named outputs of one pass; ``release`` drops the rows that they share."""

    tagged: DataFrame | None = None

    def release(self) -> None:
        if self.tagged is not None:
            self.tagged.unpersist()


def par_do(
    df: DataFrame,
    fn: DoFn | Callable[[object], Iterable[object]],
    outputs: object,
    persist: bool | None = None,
) -> DataFrame | dict[str, DataFrame]:
    """Run ``fn`` over all rows, in Arrow batches, without a shuffle.

    ``outputs`` is a schema, or a dict of named ones.  Named outputs come from one
    Python pass whose tagged rows are persisted (unless ``persist`` is false), so the
    function does not run once for each output that is used; ``release`` the result when done.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if not isinstance(fn, DoFn):
        fn = _Function(fn)
    ship(df.sparkSession)
    single = not isinstance(outputs, dict)
    kinds = {"": _struct(outputs)} if single else {k: _struct(v) for k, v in outputs.items()}
    for k, kind in kinds.items():
        for f in kind:
            if isinstance(f.dataType, T.NullType):
                raise TypeError(f"output {k!r} has a field without a type")
    scalar = [f.name for f in df.schema] == ["value"]
    whole = (
        kinds[""]
        if single
        else T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(k, s) for k, s in kinds.items()]])
    )
    arrow = to_arrow_schema(whole)
    names = {k: [f.name for f in s] for k, s in kinds.items()}

    def shaped(value: object, tag: str) -> dict:
        if isinstance(value, dict):
            row = value
        elif len(names[tag]) == 1:
            row = {names[tag][0]: value}
        else:
            row = dict(zip(names[tag], value, strict=True))
        return row if single else {"tag": tag, tag: row}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []

        def emit(value, tag=""):
            if tag not in names:
                raise ValueError(f"no output named {tag!r}")
            out.append(shaped(value, tag))

        def flush():
            batch = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            return batch

        fn.start_bundle()
        for batch in batches:
            rows = batch.column(0).to_pylist() if scalar else batch.to_pylist()
            for row in rows:
                fn.process(row, emit)
                if len(out) >= 10_000:
                    yield flush()
        fn.finish_bundle(emit)
        if out:
            yield flush()

    done = df.mapInArrow(run, whole)
    if single:
        return done
    found = Outputs((k, done) for k in kinds)
    if persist or (persist is None and len(kinds) > 1):
        found.tagged = done = done.persist()
    found.update((k, done.where(F.col("tag") == k).select(f"{k}.*")) for k in kinds)
    return found
