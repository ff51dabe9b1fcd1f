"""Text by lines: reading by glob, reading with file names, and a single-file sink."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import EmptyMatch, match_all, match_files, path_of

LINES = T.StructType([T.StructField("value", T.StringType())])


def _lines(spark: SparkSession, files: DataFrame, names: bool) -> DataFrame:
    """Lines end in a newline only; carriage returns stay.  Files are split by Spark."""
    rows = files.select(path_of(F.col("bucket"), F.col("key")).alias("path"), "bucket").distinct().collect()
    if not rows:
        kinds = [T.StructField("key", T.StringType()), *LINES] if names else list(LINES)
        return spark.createDataFrame([], T.StructType(kinds))
    read = spark.read.option("lineSep", "\n").text([_escaped(r["path"]) for r in rows])
    if not names:
        return read
    key = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    key = F.regexp_replace(key, "^[a-zA-Z0-9+.-]+:/+", "/")
    for bucket in sorted({r["bucket"] for r in rows}, key=len):
        top = "/" + bucket.partition(":")[2].lstrip("/") if ":" in bucket else bucket
        prefix = top.rstrip("/") + "/"
        key = F.when(key.startswith(prefix), F.substring(key, len(prefix) + 1, 1 << 20)).otherwise(key)
    return read.select(key.alias("key"), "value")


def _escaped(path: str) -> str:
    """A path in which Spark sees no glob."""
    return "".join("\\" + c if c in "*?[]{}" else c for c in path)


def read_text(
    spark: SparkSession, bucket: str, glob: str, empty: EmptyMatch = EmptyMatch.ALLOW
) -> DataFrame:
    """``value``: the lines of all files that match.  ``.gz`` files are inflated.

    A last line without a newline counts unless it is empty; blank lines are kept; an
    empty file has no lines.
    """
    return _lines(spark, match_files(spark, bucket, glob, empty), names=False)


def read_all(globs: DataFrame, empty: EmptyMatch = EmptyMatch.ALLOW) -> DataFrame:
    """As ``read_text`` for rows of ``key`` (bucket) and ``value`` (glob)."""
    return _lines(globs.sparkSession, match_all(globs, empty), names=False)


def read_with_filename(
    spark: SparkSession, bucket: str, glob: str, empty: EmptyMatch = EmptyMatch.ALLOW
) -> DataFrame:
    """``key, value``: each line with the key of its file."""
    return _lines(spark, match_files(spark, bucket, glob, empty), names=True)


def immediate(spark: SparkSession, filename: str) -> DataFrame:
    """The lines of a small local file, read while the plan is built; ``\\r\\n`` ends a line too."""
    with open(re.sub("^file:/+", "/", filename), encoding="utf-8", newline="") as f:
        data = f.read()
    lines = data.split("\n")
    if lines[-1] == "":
        lines.pop()
    return spark.createDataFrame([(x.removesuffix("\r"),) for x in lines], LINES)


def write_single(df: DataFrame, bucket: str, file: str, value: str = "value") -> DataFrame:
    """Write all lines to one file and return its path; without lines, no file and no row.

    Spark writes one part under a temporary name, which is then moved into place, so
    readers see the whole file or none.  One file means one writing task: the sink is for
    results, not for large outputs.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    top = bucket.rstrip("/")
    temp = f"{top}/_temporary-{uuid.uuid4().hex}"
    fs = path(temp).getFileSystem(conf)
    schema = T.StructType([T.StructField("value", T.StringType())])
    try:
        df.select(F.col(value).cast("string").alias("value")).coalesce(1).write.option("lineSep", "\n").text(temp)
        parts = [s.getPath() for s in fs.listStatus(path(temp)) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
        if not parts:
            return spark.createDataFrame([], schema)
        target = path(f"{top}/{file}")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        fs.rename(parts[0], target)
    finally:
        fs.delete(path(temp), True)
    return spark.createDataFrame([(f"{top}/{file}",)], schema)


def local_uri(folder: str) -> str:
    return "file://" + os.path.abspath(folder)
