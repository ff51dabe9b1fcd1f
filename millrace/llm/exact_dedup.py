"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are split by their leading bytes; groups of one are finished, groups
whose texts have ended are groups of equal texts, and the rest is split again by
the next bytes.  A digit is a run of bytes, longer at each level, so that a text
of any length is settled after a few levels.  No digest decides equality.

One level is a partially aggregated count of (group, digit) and a join of the rows
with the groups of two or more.  A bitmap of fixed size over those groups goes
before that join: a row whose bit is unset is alone in its group, and leaves its
text and digit behind instead of taking them through the shuffle.  Set bits prove
nothing; the join compares the bytes.  The counts are written out first, so that
both sides of the join are plain exchanges and adaptive execution can split the
rows of one huge group over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, forget, lower_ascii, marked, materialize, table


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_digit: int = 512,
    growth: int = 8,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text is empty.
    The row with the largest id stays; among repeated rows of that id exactly one
    does, and a null id is the smallest.  Empty tables give no rows.  Other columns
    are ignored.

    Row numbers only name groups and break ties, and are compared within one written
    table only: scans of ``docs`` may be split differently from one job to the next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    level = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc"),
        F.lit(0).cast("bigint").alias("gid"),
        text.alias("body"),
        F.sha2(lower_ascii(text), 256).alias("sha"),
    )
    done, active, offset, width = [], None, 0, first_digit
    while True:
        rows = level.withColumn("bytes_", lower_ascii(F.col("body")).cast("binary")).select(
            *level.columns,
            F.substring("bytes_", offset + 1, width).alias("digit"),
            (F.octet_length("bytes_") <= offset + width).alias("ended"),
        )
        groups = materialize(
            rows.groupBy(
                F.col("gid").alias("g_gid"),
                F.col("digit").alias("g_digit"),
                F.col("ended").alias("g_ended"),
            )
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc", "rid")).alias("top"))
            .where("n > 1"),
            "radix-groups",
        )
        bits = bitmap(groups.select(F.xxhash64("g_gid", "g_digit", "g_ended").alias("hash_")))
        met = marked(rows.withColumn("hash_", F.xxhash64("gid", "digit", "ended")), bits)
        maybe = F.col("maybe_")
        # A row that is alone keeps a key of its own, which spreads such rows evenly.
        sent = met.select(
            "rid",
            "doc",
            "sha",
            F.when(maybe, F.col("gid")).otherwise(F.lit(-1)).alias("gid"),
            F.when(maybe, F.col("digit")).otherwise(F.col("rid").cast("string").cast("binary")).alias("digit"),
            (maybe & F.col("ended")).alias("ended"),
            F.when(maybe & ~F.col("ended"), F.col("body")).alias("body"),
        )
        joined = sent.join(
            groups,
            (F.col("gid") == F.col("g_gid"))
            & (F.col("digit") == F.col("g_digit"))
            & (F.col("ended") == F.col("g_ended")),
            "left",
        )
        single = F.col("n").isNull()
        finished = single | F.col("ended")
        settled = materialize(
            joined.select(
                "rid",
                "doc",
                "sha",
                F.col("top.rid").alias("gid"),
                F.when(~finished, F.col("body")).alias("body"),
                finished.alias("finished"),
                F.when(single, F.col("doc")).otherwise(F.col("top.doc")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).alias("group_size"),
            ),
            "radix-level",
        )
        forget(groups)
        done.append(
            settled.where("finished").select(
                F.col("doc").alias("doc_id"),
                "keep_id",
                "group_size",
                F.col("sha").alias("text_sha256"),
                F.struct(F.lit(len(done)).alias("level"), "rid").alias("row_"),
                F.struct(F.lit(len(done)).alias("level"), "gid").alias("group_"),
            )
        )
        active = settled.where("not finished")
        if active.isEmpty():
            break
        level = active.select("rid", "doc", "gid", "body", "sha")
        offset, width = offset + width, width * growth
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # Almost every group has one row of its largest id; where rows repeat it, one is chosen.
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    ties = materialize(
        out.where(top & (F.col("group_size") > 1))
        .groupBy(F.col("group_").alias("of_"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_").alias("first_"))
        .where("n > 1"),
        "radix-ties",
    )
    met = top & (F.col("group_") == F.col("of_"))
    return out.join(ties, met, "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        (top & (F.col("first_").isNull() | (F.col("first_") == F.col("row_")))).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH t AS (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""
