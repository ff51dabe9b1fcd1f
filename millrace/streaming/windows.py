"""Event-time windows.  Each result has ``start`` and ``end`` of its window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def timed(df: DataFrame, time: str = "ts", lateness: str | None = None) -> DataFrame:
    """Event time as a timestamp, and for streams a watermark ``lateness`` behind it."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, lateness or "0 seconds") if df.isStreaming else df


def _grouped(df: DataFrame, window: Column, keys: tuple[str, ...], aggs: dict[str, Column]) -> DataFrame:
    if not aggs:
        raise ValueError("a window needs an aggregate")
    out = df.groupBy(window.alias("window_"), *keys).agg(*[c.alias(k) for k, c in aggs.items()])
    return out.select(F.col("window_.start").alias("start"), F.col("window_.end").alias("end"), *keys, *aggs)


def fixed_windows(df: DataFrame, size: str, *keys: str, time: str = "ts", lateness: str | None = None, **aggs: Column) -> DataFrame:
    """Windows of ``size`` that do not overlap."""
    return _grouped(timed(df, time, lateness), F.window(time, size), keys, aggs)


def sliding_windows(
    df: DataFrame, size: str, every: str, *keys: str, time: str = "ts", lateness: str | None = None, **aggs: Column
) -> DataFrame:
    """Windows of ``size`` that start ``every`` so often; an element may be in several."""
    return _grouped(timed(df, time, lateness), F.window(time, size, every), keys, aggs)


def session_windows(df: DataFrame, gap: str, *keys: str, time: str = "ts", lateness: str | None = None, **aggs: Column) -> DataFrame:
    """Windows of elements less than ``gap`` apart, for each key."""
    return _grouped(timed(df, time, lateness), F.session_window(time, gap), keys, aggs)
