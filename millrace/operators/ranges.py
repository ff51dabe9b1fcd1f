"""Range-divisible generators: elements that stand for a range of work.

As columns a range is exploded; for opaque Python work it is split into rows that are
dealt out, and each row is claimed position by position.  Spark plans splits before it
runs and steals no work later, so ranges are split small enough at the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from .transforms import _struct


@dataclass(frozen=True)
class OffsetRange:
    """Positions ``low`` to ``high`` - 1."""

    low: int
    high: int

    def __post_init__(self):
        if self.low > self.high:
            raise ValueError(f"a range from {self.low} to {self.high}")

    def size(self) -> int:
        return self.high - self.low

    def split(self, most: int) -> Iterator[OffsetRange]:
        """Ranges of at most ``most`` positions that cover this one."""
        for a in range(self.low, self.high, most):
            yield OffsetRange(a, min(a + most, self.high))


class RangeTracker:
    """Claims positions of a range, in increasing order, once each."""

    def __init__(self, of: OffsetRange):
        self.range, self.claimed = of, of.low - 1

    def start(self) -> int:
        return self.range.low

    def try_claim(self, position: int) -> bool:
        """Whether ``position`` is in the range; a position claimed before is an error."""
        if position <= self.claimed:
            raise ValueError(f"position {position} after {self.claimed}")
        if position >= self.range.high:
            self.claimed = self.range.high - 1
            return False
        self.claimed = position
        return True

    def progress(self) -> tuple[int, int]:
        """Positions done and left."""
        done = self.claimed + 1 - self.range.low
        return done, self.range.size() - done

    def is_done(self) -> bool:
        return self.claimed >= self.range.high - 1

    def try_split(self, fraction: float) -> OffsetRange | None:
        """Give away the last part of what is left; keep ``fraction`` of it, rounded up.

        A fraction outside 0..1 counts as the nearer of the two, so what is claimed is kept
        whatever it is.  A range that would lose nothing is not split.
        """
        at = self.claimed + 1
        keep = at + math.ceil((self.range.high - at) * min(max(fraction, 0.0), 1.0))
        if keep >= self.range.high:
            return None
        rest = OffsetRange(keep, self.range.high)
        self.range = OffsetRange(self.range.low, keep)
        return rest


#: Positions that one array holds while ranges are unfolded.
BLOCK = 65_536


def explode_range(df: DataFrame, low: Column, high: Column, name: str = "position") -> DataFrame:
    """A row for each position from ``low`` to ``high`` - 1; none where the range is empty.

    Ranges are unfolded block by block, so that a very long one is no array.
    """
    last = high - 1
    blocks = F.when(high > low, F.sequence(low, last, F.lit(BLOCK)))
    positions = F.sequence(F.col("block_"), F.least(F.col("block_") + (BLOCK - 1), F.col("last_")))
    cut = df.select("*", last.alias("last_"), F.explode(blocks).alias("block_"))
    return cut.select(*df.columns, F.explode(positions).alias(name))


def split_ranges(df: DataFrame, low: str, high: str, most: int, tasks: int | None = None) -> DataFrame:
    """Cut each row's range into rows of at most ``most`` positions, dealt out evenly."""
    starts = F.when(F.col(high) > F.col(low), F.sequence(F.col(low), F.col(high) - 1, F.lit(most).cast("bigint")))
    cut = (
        df.withColumn("part_", F.explode(starts))
        .withColumn(high, F.least(F.col("part_") + most, F.col(high)))
        .withColumn(low, F.col("part_"))
        .drop("part_")
    )
    return cut.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def process_ranges(
    df: DataFrame,
    restriction: Callable[[dict], OffsetRange],
    work: Callable[[dict, int], tuple[int, Iterable[object]]],
    output: object,
    most: int = 10_000,
) -> DataFrame:
    """Run opaque work over the range of each row.

    ``restriction(row)`` gives the range; ``work(row, position)`` returns the next position
    to claim and what this one yields.  Ranges are split to ``most`` positions and
    dealt out before the work starts; a position outside its part is left to the next.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    out = _struct(output)
    arrow, fields, names = to_arrow_schema(out), [f.name for f in out], df.columns

    def shaped(v):
        return v if isinstance(v, dict) else dict(zip(fields, v if len(fields) > 1 else (v,), strict=True))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, low, high = [], [], []
            for i, row in enumerate(batch.to_pylist()):
                for part in restriction(row).split(most):
                    at.append(i)
                    low.append(part.low)
                    high.append(part.high)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(index) for c in batch.columns), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                names=[*names, "low_", "high_"],
            )

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                tracker = RangeTracker(OffsetRange(row.pop("low_"), row.pop("high_")))
                position = tracker.start()
                while tracker.try_claim(position):
                    position, found = work(row, position)
                    for v in found:
                        rows.append(shaped(v))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    paired = T.StructType([*df.schema, T.StructField("low_", T.LongType()), T.StructField("high_", T.LongType())])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.mapInArrow(pair, paired).repartition(n).mapInArrow(process, out)
