"""Synthetic load: sources of a given size, and steps with delay, fan-out and filter."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import explode_range


@dataclass(frozen=True)
class SourceConfig:
    num_records: int
    key_size: int = 8
    value_size: int = 8
    initial_splits: int | None = None
    desired_split_bytes: int | None = None
    sleep_per_record_ns: int = 0
    seed: int = 0

    def splits(self) -> int:
        """Partitions: as many as asked for, or by bytes."""
        if self.num_records < 0 or self.key_size < 0 or self.value_size < 0:
            raise ValueError("sizes must not be negative")
        if self.initial_splits:
            return max(1, self.initial_splits)
        if self.desired_split_bytes:
            total = self.num_records * (self.key_size + self.value_size)
            return max(1, -(-total // self.desired_split_bytes))
        return 1


def synthetic_source(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """``key, value``: binary columns of the given sizes, alike in every run."""

    def filled(size: int, salt: int):
        if not size:
            return F.lit(bytearray())
        blocks = -(-size // 32)
        parts = [F.unhex(F.sha2(F.concat_ws(":", F.lit(config.seed), F.lit(salt + i), "id"), 256)) for i in range(blocks)]
        return F.substring(F.concat(*parts), 1, size)

    rows = spark.range(0, config.num_records, 1, config.splits())
    out = rows.select(filled(config.key_size, 0).alias("key"), filled(config.value_size, 1 << 20).alias("value"))
    return _delayed(out, config.sleep_per_record_ns) if config.sleep_per_record_ns else out


def _delayed(df: DataFrame, per_row_ns: int, per_bundle_ns: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time.sleep(per_bundle_ns / 1e9)
        for batch in batches:
            time.sleep(per_row_ns * batch.num_rows / 1e9)
            yield batch

    return df.mapInArrow(run, df.schema)


def synthetic_step(
    df: DataFrame,
    per_element_ns: int = 0,
    per_bundle_ns: int = 0,
    outputs: int = 1,
    filter_ratio: float = 0.0,
    seed: int | None = None,
) -> DataFrame:
    """Delay, drop rows with probability ``filter_ratio``, and repeat the rest ``outputs`` times."""
    if not 0 <= filter_ratio <= 1:
        raise ValueError("filter_ratio must be between 0 and 1")
    if per_element_ns or per_bundle_ns:
        df = _delayed(df, per_element_ns, per_bundle_ns)
    if filter_ratio:
        df = df.where((F.rand(seed) if seed is not None else F.rand()) >= filter_ratio)
    if outputs == 1:
        return df
    return df.select("*", F.explode(F.array_repeat(F.lit(0), outputs)).alias("repeat_")).drop("repeat_")


def synthetic_ranges(df: DataFrame, outputs: int, **step: object) -> DataFrame:
    """As ``synthetic_step``, one row for each position of the range [0, outputs)."""
    return explode_range(synthetic_step(df, **step), F.lit(0), F.lit(outputs))
