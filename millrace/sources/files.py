"""Listing of files by glob, and reading of whole files.

A bucket is the URI of a folder in any store that Spark reads; keys are paths below it.
"""

from __future__ import annotations

import datetime
import enum
import gzip
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = T.StructType(
    [
        T.StructField("bucket", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
    ]
)


class EmptyMatch(enum.Enum):
    """What a glob without files means."""

    ALLOW_IF_WILDCARD = "allow_if_wildcard"
    ALLOW = "allow"
    DISALLOW = "disallow"


class Compression(enum.Enum):
    AUTO = "auto"
    GZIP = "gzip"
    NONE = "none"


def glob_regex(glob: str) -> re.Pattern | None:
    """The pattern as a regular expression, or None where it is malformed.

    ``*`` and ``?`` do not cross a slash, ``[a-z]`` and ``[^a-z]`` are classes, and a
    backslash takes the next character as it is.
    """
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            klass, i = _klass(glob, i)
            if klass is None:
                return None
            out.append(klass)
        else:
            out.append(re.escape(c))
    return re.compile("".join(out), re.DOTALL)


def _klass(glob: str, i: int) -> tuple[str | None, int]:
    def one(i: int) -> tuple[str | None, int]:
        if i < len(glob) and glob[i] == "\\":
            i += 1
        elif i < len(glob) and glob[i] in "-]":
            return None, i
        return (glob[i], i + 1) if i < len(glob) else (None, i)

    negated = i < len(glob) and glob[i] == "^"
    i += negated
    ranges = []
    while i < len(glob) and (glob[i] != "]" or not ranges):
        low, i = one(i)
        if low is None:
            return None, i
        high = low
        if i < len(glob) and glob[i] == "-":
            high, i = one(i + 1)
            if high is None:
                return None, i
        if low <= high:
            ranges.append(f"{re.escape(low)}-{re.escape(high)}")
        else:
            ranges.append("")
    if i >= len(glob):
        return None, i
    body = "".join(ranges)
    if not body:
        return ("[^/]" if negated else "(?!)"), i + 1
    return (f"(?!/)[^{body}]" if negated else f"(?!/)[{body}]"), i + 1


def matches(glob: str, key: str) -> bool:
    """Whether the whole of ``key`` matches; a malformed pattern matches nothing."""
    pattern = glob_regex(glob)
    return pattern is not None and pattern.fullmatch(key) is not None


def _listing(spark: SparkSession, bucket: str) -> Iterable[tuple]:
    """Every file below the bucket, by the store's own recursive listing."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(bucket)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(top).toString().rstrip("/") + "/"
    files = fs.listFiles(top, True)
    while files.hasNext():
        status = files.next()
        key = status.getPath().toString().removeprefix(prefix)
        when = datetime.datetime.fromtimestamp(status.getModificationTime() / 1000, datetime.UTC)
        yield bucket, key, status.getLen(), when


def _matched(spark: SparkSession, bucket: str, globs: Iterable[str], empty: EmptyMatch) -> list[tuple]:
    every, found = None, []
    for glob in globs:
        if not glob.strip():
            continue
        if every is None:
            every = list(_listing(spark, bucket))
        pattern = glob_regex(glob)
        hits = [f for f in every if pattern is not None and pattern.fullmatch(f[1])]
        lenient = empty is EmptyMatch.ALLOW or (empty is EmptyMatch.ALLOW_IF_WILDCARD and "*" in glob)
        if not hits and not lenient:
            raise FileNotFoundError(f"no file in {bucket} matches {glob!r}")
        found += hits
    return found


def match_files(
    spark: SparkSession, bucket: str, glob: str, empty: EmptyMatch = EmptyMatch.ALLOW_IF_WILDCARD
) -> DataFrame:
    """``bucket, key, size, last_modified`` of the files whose key matches."""
    return spark.createDataFrame(_matched(spark, bucket, [glob], empty), LISTING)


def match_all(globs: DataFrame, empty: EmptyMatch = EmptyMatch.ALLOW_IF_WILDCARD, most: int = 10_000) -> DataFrame:
    """As ``match_files`` for each row of ``key`` (bucket) and ``value`` (glob).

    Globs are a plan's parameters: the driver lists, and refuses more than ``most``.
    """
    spark = globs.sparkSession
    rows = globs.select("key", "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} globs")
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["key"], []).append(r["value"])
    found = [f for bucket, gs in by.items() for f in _matched(spark, bucket, gs, empty)]
    return spark.createDataFrame(found, LISTING)


def path_of(bucket: Column, key: Column) -> Column:
    return F.concat(F.regexp_replace(bucket, "/+$", ""), F.lit("/"), key)


def read_matches(
    files: DataFrame,
    compression: Compression = Compression.AUTO,
    directories: str = "skip",
) -> DataFrame:
    """Listed files with ``path`` and ``gzipped``; keys that end in a slash are no files.

    ``directories`` is ``skip``, or ``disallow`` to fail on such keys.
    """
    is_dir = F.col("key").rlike(r"[/\\]$")
    if directories == "disallow":
        bad = files.where(is_dir).select("key").limit(1).collect()
        if bad:
            raise IsADirectoryError(bad[0]["key"])
    gzipped = {
        Compression.AUTO: F.col("key").endswith(".gz"),
        Compression.GZIP: F.lit(True),
        Compression.NONE: F.lit(False),
    }[compression]
    return files.where(~is_dir).withColumn("path", path_of(F.col("bucket"), F.col("key"))).withColumn("gzipped", gzipped)


def read_content(blobs: DataFrame, text: bool = False) -> DataFrame:
    """Whole contents, inflated where ``gzipped``: a row for each of ``read_matches``.

    Contents are read on the executors, a file at a time.
    """
    spark = blobs.sparkSession
    listed = blobs.select("path", "key", "gzipped").collect()  # a listing: names, not contents
    kind = T.StringType() if text else T.BinaryType()
    if not listed:
        return spark.createDataFrame([], T.StructType([T.StructField("key", T.StringType()), T.StructField("content", kind)]))
    raw = spark.read.format("binaryFile").load([r["path"] for r in listed])
    # binaryFile leaves out empty files: the listing brings them back.
    names = spark.createDataFrame([(_plain(r["path"]), r["key"], bool(r["gzipped"])) for r in listed], "at string, key string, gzipped boolean")
    joined = F.broadcast(names).join(raw.select(F.regexp_replace(F.url_decode("path"), "^[a-z0-9]+:/+", "/").alias("of"), "content"), F.col("at") == F.col("of"), "left")

    @F.pandas_udf(T.BinaryType())
    def inflate(content, gzipped):
        return content.combine(gzipped, lambda c, g: gzip.decompress(c) if g and c else c)

    content = F.when(F.col("gzipped"), inflate("content", "gzipped")).otherwise(F.coalesce("content", F.lit(bytearray())))
    content = F.coalesce(content, F.lit(bytearray()))
    return joined.select("key", (F.decode(content, "utf-8") if text else content).alias("content"))


def _plain(path: str) -> str:
    return re.sub("^[a-z0-9]+:/+", "/", path)
