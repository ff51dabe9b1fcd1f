"""Sharding by a keyed permutation of global row numbers.

Every row gets a global number; a Feistel permutation over exactly the numbers
0..n-1 (a generalised network on a near-square grid, cycle walking past the few
grid cells beyond n) scatters it, and position p lands in shard ``p mod shards``
at slot ``p div shards``.  Shard sizes therefore differ by one row at most, slots
have no gaps, and :func:`position` computes the place of any row number without
Spark.

The plan is one aggregation of narrow rows and one window per hash bucket:
texts are reduced to size and checksum in the scan and never shuffled.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, table

ROUNDS = 6
#: First steps of cycle walking.  The grid has fewer than 2 * sqrt(n) + 1 cells beyond n, so
#: a row that needs more is all but unheard of; it walks on through as many as there can be.
WALK = 64
#: Rows alike are numbered in runs of so many at most.
RUN = 65_536


def _network(x: str, seed: int) -> str:
    """SQL for one pass of the network over the grid of ``rows_`` by ``cols_``."""

    def mix(v: str) -> str:
        return f"xxhash64({v}, cast(i as bigint), cast({seed} as bigint))"

    steps = ", ".join(str(i) for i in range(ROUNDS))
    return (
        f"aggregate(array({steps}), named_struct('l', ({x}) div cols_, 'r', ({x}) % cols_), "
        f"(s, i) -> if(i % 2 = 0, "
        f"named_struct('l', (s.l + pmod({mix('s.r')}, rows_)) % rows_, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + pmod({mix('s.l')}, cols_)) % cols_)), "
        f"s -> s.l * cols_ + s.r)"
    )


def position(row: int, n: int, seed: int) -> int:
    """The place of row number ``row`` among ``n``, computed without Spark."""
    rows = math.isqrt(n - 1) + 1
    cols = -(-n // rows)

    def mix(v: int, i: int) -> int:
        h = 42
        for part in (v, i, seed):
            h = xxhash.xxh64(part.to_bytes(8, "little", signed=True), seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    while True:
        left, right = divmod(row, cols)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + mix(right, i) % rows) % rows
            else:
                right = (right + mix(left, i) % cols) % cols
        row = left * cols + right
        if row < n:
            return row


def shard(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 20240,
    buckets: int = 4096,
) -> DataFrame:
    """Deal all rows into ``shards`` shards whose row counts differ by one at most.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number``.
    ``size`` is the UTF-8 bytes of the text plus 8; a null text has no bytes and the
    checksum of the empty text; a null id is a value like any other.  Rows alike in
    id, size and checksum are interchangeable: they are counted before the shuffle,
    and runs of ``RUN`` of them are numbered and unfolded in buckets of their own, so
    no group of repeats meets in one task.  Texts of any length are only measured in
    the scan.  An empty table gives no rows.  Columns other than the id and the text are ignored.

    Row numbers follow (hash bucket, id, size, checksum, run), so they depend on the rows
    alone, not on files, partitions or cluster.  ``buckets`` bounds both the rows of
    one window and the table of bucket totals.
    """
    text = body(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = ["doc_id", "size", "text_crc32"]
    groups = (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("all_"))
        .withColumn("run_", F.explode(F.expr(f"sequence(0L, (all_ - 1) div {RUN})")))
        .withColumn("n_", F.expr(f"least({RUN}L, all_ - run_ * {RUN})"))
        .withColumn("bucket_", F.pmod(F.xxhash64(*key, "run_"), F.lit(buckets)))
    )
    # At most ``buckets`` rows meet in the single task of these two windows.
    totals = groups.groupBy("bucket_").agg(F.sum("n_").alias("b_"))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("bucket_").alias("of_"),
        F.coalesce(F.sum("b_").over(before), F.lit(0)).alias("start_"),
        F.sum("b_").over(Window.partitionBy()).alias("total_"),
    )
    inside = (
        Window.partitionBy("bucket_")
        .orderBy(*key, "run_")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = (
        groups.withColumn("in_", F.coalesce(F.sum("n_").over(inside), F.lit(0)))
        .join(F.broadcast(totals), F.col("bucket_") == F.col("of_"))
        .withColumn("first_", F.col("start_") + F.col("in_"))
        .withColumn("row_number", F.explode(F.expr("sequence(first_, first_ + n_ - 1)")))
        .withColumn("rows_", F.ceil(F.sqrt(F.col("total_").cast("double"))).cast("bigint"))
        .withColumn("rows_", F.expr("if(rows_ * rows_ < total_, rows_ + 1, "
                                    "if((rows_ - 1) * (rows_ - 1) >= total_, rows_ - 1, rows_))"))
        .withColumn("cols_", F.expr("(total_ + rows_ - 1) div rows_"))
    )
    step = f"(x, k) -> if(x < total_, x, {_network('x', seed)})"
    placed = numbered.withColumn("p_", F.expr(_network("row_number", seed)))
    for most in (str(WALK), "rows_ + cols_"):
        placed = placed.withColumn("p_", F.expr(f"if(p_ < total_, p_, aggregate(sequence(1L, {most}), p_, {step}))"))
    return placed.select(
        *key,
        F.lit("rows").alias("law"),
        (F.col("p_") % F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"p_ div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op4_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
