"""Side inputs, as joins.

A side input is read in full by every element.  Its size decides how: up to a checked
bound it is broadcast; beyond, a map is an ordinary join, and an iterable that large is
refused rather than multiplied out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import key_type

#: Bytes of a side input that are broadcast.
BOUND = 64 << 20


def _small(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has ``bound`` bytes at most: by the plan's estimate, or else measured.

    An estimate counts files as they are compressed, so only a far smaller one needs no job.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) <= bound // 8:
        return True
    wide = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return df.agg(F.coalesce(F.sum(wide), F.lit(0))).first()[0] <= bound


@dataclass(frozen=True)
class SideIter:
    side: DataFrame
    bound: int = BOUND

    def join(self, main: DataFrame, condition: Column | None = None) -> DataFrame:
        """Every row of ``main`` with every row of the side input that meets ``condition``."""
        if not _small(self.side, self.bound):
            raise ValueError(f"an iterable side input of more than {self.bound} bytes; give it a key and use a map")
        side = F.broadcast(self.side)
        return main.crossJoin(side) if condition is None else main.join(side, condition, "inner")


@dataclass(frozen=True)
class SideMap:
    """A multimap: a key may have several values, or none."""

    side: DataFrame
    key: str = "key"
    value: str = "value"
    bound: int = BOUND

    def _right(self) -> DataFrame:
        side = self.side.select(F.col(self.key).alias("side_key"), F.col(self.value).alias("side_value"))
        return F.broadcast(side) if _small(side, self.bound) else side

    def get(self, main: DataFrame, key: Column, missing: bool = False) -> DataFrame:
        """Rows of ``main`` with ``side_value`` of their key, one for each value.

        A row without values is left out, or kept with a null where ``missing`` is true.
        """
        return main.join(self._right(), key == F.col("side_key"), "left" if missing else "inner").drop("side_key")

    def having(self, main: DataFrame, key: Column) -> DataFrame:
        """Rows of ``main`` whose key has a value."""
        return main.join(self._right(), key == F.col("side_key"), "left_semi")

    def lacking(self, main: DataFrame, key: Column) -> DataFrame:
        """Rows of ``main`` whose key has none."""
        return main.join(self._right(), key == F.col("side_key"), "left_anti")

    def keys(self) -> DataFrame:
        return self.side.select(F.col(self.key).alias("key")).distinct()


def as_side_iter(df: DataFrame, bound: int = BOUND) -> SideIter:
    _attached(df)
    return SideIter(df, bound)


def as_side_map(df: DataFrame, key: str = "key", value: str = "value", bound: int = BOUND) -> SideMap:
    _attached(df)
    for name in (key, value):
        if name not in df.columns:
            raise ValueError(f"the side input has no column {name!r}")
    key_type(df.schema[key].dataType)
    return SideMap(df, key, value, bound)


def _attached(df: object) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError("a side input must be a DataFrame")
    if df.isStreaming:
        raise ValueError("a side input must be bounded")
