"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship as ship_package

__all__ = [
    "bitmap", "body", "forget", "forget_since", "fresh_path", "lower_ascii", "marked", "materialize", "shared_dir",
    "ship", "table", "without", "written",
]

#: Words of 64 bits in a bitmap: it has so many rows at most, about 8 MB.
WORDS = 1 << 18
_BIT = "cast(pmod(shiftright(hash_, 32), 64) as int)"

#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def ship(spark: SparkSession) -> None:
    """Make the package known to the workers, and keep batches of whole texts small.

    The session's bound on the bytes of a batch is lowered, never raised.
    """
    ship_package(spark)
    to_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if to_bytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    Texts with one byte for each character are ASCII, where ``lower`` does just that
    and is several times as fast.
    """
    ascii_ = F.length(text) == F.octet_length(text)
    return F.when(ascii_, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def body(text: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (as in tests) a folder of our own
    is made and registered: elsewhere executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; two runs never meet in one."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


#: Folders of the tables written by this process and not forgotten yet.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not a
    recomputation, and the rows no longer depend on how they were dealt out.  Zstandard
    is the codec because its buffers live on the heap: Snappy's direct buffers pile up
    over many small tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [p for p in _WRITTEN if p.rpartition("/")[2] != path.rpartition("/")[2]]


def written() -> int:
    """How many tables have been written so far; ``forget_since`` takes it."""
    return len(_WRITTEN)


def forget_since(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Delete the tables written after ``mark``, all but ``keep``.

    An operator's result reads the tables it wrote, so this is for results that have been
    written out themselves.
    """
    kept = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    for path in _WRITTEN[mark:]:
        if path.rpartition("/")[2] not in kept:
            _delete(spark, path)
            _WRITTEN.remove(path)


def bitmap(hashes: DataFrame) -> DataFrame:
    """``word_, bits_``: the set bits of all values of ``hash_``; bounded, so fit to broadcast."""
    return (
        hashes.groupBy(F.pmod("hash_", F.lit(WORDS)).alias("word_"))
        .agg(F.expr(f"bit_or(shiftleft(1L, {_BIT}))").alias("bits_"))
    )


def marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows``, which have ``hash_``, with ``maybe_``: false where its bit is unset.

    A false one is certain; a true one proves nothing, and an exact join must follow.
    """
    met = rows.join(F.broadcast(bits), F.pmod("hash_", F.lit(WORDS)) == F.col("word_"), "left")
    maybe = F.coalesce(F.expr(f"(shiftright(bits_, {_BIT}) & 1) = 1"), F.lit(False))
    return met.withColumn("maybe_", maybe).drop("word_", "bits_", "hash_")


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``gone``; a null key goes with a null one.

    Rows that a bitmap of ``gone`` clears go straight through; only the others are joined,
    so texts that stay are not shuffled, however long ``gone`` is.
    """
    lost = materialize(gone.select(F.col(key).alias("gone_")).distinct(), "dropped")
    # Whole rows travel in one column, so that no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row_"), F.col(key).alias("key_"), F.xxhash64(key).alias("hash_"))
    rows = marked(rows, bitmap(lost.select(F.xxhash64("gone_").alias("hash_"))))
    doubtful = rows.where("maybe_").join(lost, F.col("key_").eqNullSafe(F.col("gone_")), "left_anti")
    return rows.where("not maybe_").select("row_.*").unionByName(doubtful.select("row_.*"))
