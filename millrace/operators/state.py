"""Keyed stateful processing, in batch and in Structured Streaming.

A ``StatefulFn`` declares its cells and processes the elements of a key one by one.  In
batch, rows are dealt by key and sorted by an explicit order, and stream through one
Python pass that holds the state of a single key at a time; no group is built.  In
streaming the same function runs over Spark's state store.  The order of elements is the
given one in batch; a stream has the order of arrival.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from ..functions.types import key_type
from .combine import Combiner
from .transforms import _struct


class _LocalValue:
    """State of one key, in memory."""

    def __init__(self):
        self.data = None

    def get(self):
        return self.data

    def set(self, data) -> None:
        self.data = data

    def clear(self) -> None:
        self.data = None


class _LocalList:
    def __init__(self):
        self.data = []

    def append(self, value) -> None:
        self.data.append(value)

    def read(self) -> list:
        return list(self.data)

    def put(self, values: list) -> None:
        self.data = values

    def clear(self) -> None:
        self.data = []


def entry_key(value: object) -> bytes:
    """Names a key of a map or a member of a set, alike in batch and in streaming.

    Values are alike when type and content are: 1, 1.0 and True are three keys, lists and
    dicts are keys like any other, and the order in a dict or set is no matter.
    """
    if isinstance(value, (list, tuple)):
        inner = b"".join(map(entry_key, value))
    elif isinstance(value, dict):
        inner = b"".join(sorted(entry_key(k) + entry_key(v) for k, v in value.items()))
    elif isinstance(value, (set, frozenset)):
        inner = b"".join(sorted(map(entry_key, value)))
    elif value is None or isinstance(value, (bool, int, float, str, bytes)):
        inner = repr(value).encode()
    else:
        inner = pickle.dumps(value)
    kind = type(value).__name__.encode()
    return b"%s:%d:%s" % (kind, len(inner), inner)


class _LocalMap:
    """Entries by ``entry_key``."""

    def __init__(self):
        self.data: dict[bytes, tuple] = {}

    def get(self, key, default=None):
        return self.data.get(entry_key(key), (None, default))[1]

    def put(self, key, value) -> None:
        self.data[entry_key(key)] = (key, value)

    def __contains__(self, key) -> bool:
        return entry_key(key) in self.data

    def remove(self, key) -> None:
        self.data.pop(entry_key(key), None)

    def keys(self) -> list:
        return [k for k, _ in self.data.values()]

    def pairs(self) -> list:
        return list(self.data.values())

    def clear(self) -> None:
        self.data.clear()


_BLOB = T.StructType([T.StructField("data", T.BinaryType())])


def _load(row):
    return pickle.loads(row[0])  # noqa: S301  written by this module


class _StoredValue:
    """State of one key, in the state store."""

    def __init__(self, handle, name: str):
        self.state = handle.getValueState(name, _BLOB)

    def get(self):
        return _load(self.state.get()) if self.state.exists() else None

    def set(self, data) -> None:
        self.state.update((pickle.dumps(data),))

    def clear(self) -> None:
        self.state.clear()


class _StoredList:
    """Appends write one value, whatever the list holds."""

    def __init__(self, handle, name: str):
        self.state = handle.getListState(name, _BLOB)

    def append(self, value) -> None:
        self.state.appendValue((pickle.dumps(value),))

    def read(self) -> list:
        return [_load(r) for r in self.state.get()]

    def put(self, values: list) -> None:
        if values:
            self.state.put([(pickle.dumps(v),) for v in values])
        else:
            self.state.clear()

    def clear(self) -> None:
        self.state.clear()


class _StoredMap:
    """Reads and writes touch one entry, found by its ``entry_key``."""

    def __init__(self, handle, name: str):
        self.state = handle.getMapState(name, _BLOB, _BLOB)

    def get(self, key, default=None):
        k = (entry_key(key),)
        return _load(self.state.getValue(k))[1] if self.state.containsKey(k) else default

    def put(self, key, value) -> None:
        self.state.updateValue((entry_key(key),), (pickle.dumps((key, value)),))

    def __contains__(self, key) -> bool:
        return self.state.containsKey((entry_key(key),))

    def remove(self, key) -> None:
        self.state.removeKey((entry_key(key),))

    def keys(self) -> list:
        return [k for k, _ in self.pairs()]

    def pairs(self) -> list:
        return [_load(v) for _, v in self.state.iterator()]

    def clear(self) -> None:
        self.state.clear()


_LOCAL = {"value": _LocalValue, "list": _LocalList, "map": _LocalMap}
_STORED = {"value": _StoredValue, "list": _StoredList, "map": _StoredMap}


class Cell:
    """A state cell; instances on a ``StatefulFn`` are templates, bound to each key."""

    kind = "value"

    def __init__(self, backend=None):
        self.backend = backend

    def bound(self, backend) -> Cell:
        return type(self)(backend)

    def clear(self) -> None:
        self.backend.clear()


class Bag(Cell):
    """Values in the order they were appended."""

    kind = "list"

    def append(self, value) -> None:
        self.backend.append(value)

    def read(self) -> Iterator:
        return iter(self.backend.read())


class Value(Cell):
    def write(self, value) -> None:
        self.backend.set((value,))

    def read(self, default=None):
        data = self.backend.get()
        return default if data is None else data[0]


class Combining(Cell):
    """A combiner's accumulator."""

    def __init__(self, combiner: Combiner, backend=None):
        super().__init__(backend)
        self.combiner = combiner

    def bound(self, backend):
        return Combining(self.combiner, backend)

    def add(self, value) -> None:
        data = self.backend.get()
        self.backend.set((self.combiner.first(value) if data is None else self.combiner.step(data[0], value),))

    def read(self, default=None):
        data = self.backend.get()
        return default if data is None else self.combiner.finish(data[0])


class Map(Cell):
    kind = "map"

    def put(self, key, value) -> None:
        self.backend.put(key, value)

    def get(self, key, default=None):
        return self.backend.get(key, default)

    def remove(self, key) -> None:
        self.backend.remove(key)

    def keys(self) -> list:
        return list(self.backend.keys())

    def items(self) -> list:
        return self.backend.pairs()


class Set(Cell):
    """Distinct values."""

    kind = "map"

    def add(self, value) -> bool:
        """Add a value; whether it is new."""
        if value in self.backend:
            return False
        self.backend.put(value, True)
        return True

    def remove(self, value) -> None:
        self.backend.remove(value)

    def __contains__(self, value) -> bool:
        return value in self.backend

    def read(self) -> list:
        """The values in order; by type and content where they have none."""
        values = self.backend.keys()
        try:
            return sorted(values)
        except TypeError:
            return sorted(values, key=entry_key)


class MultiMap(Cell):
    kind = "map"

    def put(self, key, value) -> None:
        self.backend.put(key, [*self.backend.get(key, ()), value])

    def get(self, key) -> Iterator:
        return iter(self.backend.get(key, ()))

    def remove(self, key) -> None:
        self.backend.remove(key)

    def keys(self) -> list:
        return list(self.backend.keys())


class OrderedList(Cell):
    """Values by time; equal times keep the order they were added in."""

    kind = "list"

    def add(self, time, value) -> None:
        self.backend.append((time, value))

    def read(self, low=None, high=None) -> list:
        """``(time, value)`` with low <= time < high, by time."""
        found = [x for x in self.backend.read() if (low is None or x[0] >= low) and (high is None or x[0] < high)]
        return sorted(found, key=lambda x: x[0])

    def clear_range(self, low, high) -> None:
        held = self.backend.read()
        left = [x for x in held if not low <= x[0] < high]
        if len(left) < len(held):
            self.backend.put(left)


class StatefulFn:
    """Cells are class or instance attributes; ``process`` gets key, row (a dict) and ``emit``."""

    def process(self, key, row: dict, emit: Callable[[object], None]) -> None:
        raise NotImplementedError

    def timer(self, key, time_ms: int, emit: Callable[[object], None]) -> None:
        """Called in streaming when a timer set with ``self.set_timer(ms)`` is due."""

    def cells(self) -> dict[str, Cell]:
        names = {**vars(type(self)), **vars(self)}
        for base in type(self).__mro__[1:]:
            names = {**vars(base), **names}
        return {k: v for k, v in names.items() if isinstance(v, Cell)}


def _checked(fn: StatefulFn) -> dict[str, Cell]:
    if not isinstance(fn, StatefulFn):
        raise TypeError("a stateful function must be a StatefulFn")
    cells = fn.cells()
    if not cells:
        raise TypeError(f"{type(fn).__name__} has no state; use par_do")
    return cells


def _row(value: object, names: list[str]) -> dict:
    if isinstance(value, dict):
        return value
    return {names[0]: value} if len(names) == 1 else dict(zip(names, value, strict=True))


def stateful_par_do(
    df: DataFrame,
    fn: StatefulFn,
    output: object,
    key: str = "key",
    order_by: Iterable[str] | str | None = None,
    time_mode: str | None = None,
) -> DataFrame:
    """Process the rows of each key in order, with state of its own.

    A bounded ``df`` needs ``order_by``, as a shuffle keeps no order; a streaming one
    processes rows as they arrive.  Timers of a function that has a ``timer`` fire by
    ``time_mode``, ``ProcessingTime`` unless told; a query with such timers never runs dry.
    """
    cells = _checked(fn)
    key_type(df.schema[key].dataType)
    ship(df.sparkSession)
    out = _struct(output)
    if df.isStreaming:
        timed = type(fn).timer is not StatefulFn.timer
        return _streaming(df, fn, cells, out, key, time_mode or ("ProcessingTime" if timed else "None"))
    if order_by is None:
        raise ValueError("stateful processing of a bounded input needs order_by")
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return _batch(df, fn, list(cells), out, key, order)


def _batch(df, fn, names, out: T.StructType, key: str, order: list[str]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, fields = to_arrow_schema(out), [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = {n: getattr(fn, n) for n in names}
        last, begun, rows = None, False, []
        for batch in batches:
            for row in batch.to_pylist():
                k = row[key]
                if not begun or (k != last and (k == k or last == last)):  # NaN is one key
                    last, begun = k, True
                    for n, t in templates.items():
                        setattr(fn, n, t.bound(_LOCAL[t.kind]()))
                fn.process(k, row, lambda v: rows.append(_row(v, fields)))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows.clear()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def _streaming(df, fn, cells: dict[str, Cell], out: T.StructType, key: str, time_mode: str) -> DataFrame:
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    fields = [f.name for f in out]

    class Processor(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            for name, cell in cells.items():
                setattr(fn, name, cell.bound(_STORED[cell.kind](handle, name)))
            fn.set_timer = handle.registerTimer
            fn.delete_timer = handle.deleteTimer

        def _frame(self, rows):
            return pd.DataFrame([[r.get(f) for f in fields] for r in rows], columns=fields)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802  the name Spark calls
            found: list[dict] = []
            for pdf in rows:
                for row in pdf.to_dict("records"):
                    fn.process(key[0], row, lambda v: found.append(_row(v, fields)))
            yield self._frame(found)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
            found: list[dict] = []
            fn.timer(key[0], expiredTimerInfo.getExpiryTimeInMs(), lambda v: found.append(_row(v, fields)))
            yield self._frame(found)

        def close(self):
            pass

    # Spark also starts a worker on the driver, which gets no shipped files: the package
    # travels with the function itself.
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        return df.groupBy(key).transformWithStateInPandas(
            statefulProcessor=Processor(), outputStructType=out, outputMode="Append", timeMode=time_mode
        )
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def windowed_bag(df: DataFrame, key: str, value: str, order_by: list[str], every: int) -> DataFrame:
    """The bag example as window expressions: running sums, reset after ``every`` elements.

    The JVM-side form of a ``StatefulFn`` whose state depends only on position.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(*order_by)
    numbered = df.withColumn("run_", F.floor((F.row_number().over(order) - 1) / every))
    within = Window.partitionBy(key, "run_").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("total", F.sum(value).over(within)).drop("run_")

