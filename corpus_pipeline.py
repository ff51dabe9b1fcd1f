"""The corpus pipeline: five operators in a row, each on what the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``; the last returns the packed pieces.

A stage that compares rows first writes them out, each with a name of its own, and drops
rows by that name.  So ids may repeat or be missing: every row is judged and kept or
dropped by itself, with all its columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import forget_since, lower_ascii, materialize, table, without, written
from millrace.llm.decontamination import decontaminate
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.packing import pack
from millrace.llm.simhash import near_groups
from millrace.llm.toxicity import THRESHOLD, filter_toxic, train

#: Not expressible in SQL: tokens, a trained model and graph components are part of it.
ORACLE_SQL = None


def named(docs: DataFrame) -> DataFrame:
    """``row_, tie_, rid_, text``, written out: whole rows with a name that no other row has.

    ``tie_`` orders rows of one id by their text and then by their other columns, so that
    which of them stays does not depend on how the table lies; ``rid_`` is the name.
    """

    def hashable(kind: T.DataType) -> bool:
        return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()

    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    rest = [F.col(f"`{f.name}`") for f in docs.schema if hashable(f.dataType)]
    return materialize(
        docs.select(
            F.struct("*").alias("row_"),
            F.struct(F.xxhash64(text).alias("text"), F.xxhash64(*rest).alias("all")).alias("tie_"),
            F.monotonically_increasing_id().alias("rid_"),
        ),
        "named",
    )


def judged(rows: DataFrame, *before: Column) -> DataFrame:
    """``name_, text`` of named rows: names sort by ``before``, then the tie, then alone."""
    fields = [c.alias(f"by{i}") for i, c in enumerate(before)]
    return rows.select(F.struct(*fields, "tie_", "rid_").alias("name_"), F.col("row_.text").alias("text"))


def less(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The whole rows whose name is not in ``gone``."""
    return without(rows, gone, "rid_").select("row_.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, in one pass over the texts."""
    return filter_toxic(docs, train(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id; a missing id is the least.

    Where rows repeat that id, the one with the largest tie stays.
    """
    rows = named(docs)
    found = exact_dedup(judged(rows, F.col("row_.doc_id")), id_col="name_")
    return less(rows, found.where("not kept").select("doc_id.rid_"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id; a missing id comes last.

    Where rows repeat that id, the one with the smallest tie stays.
    """
    rows = named(docs)
    found = near_groups(judged(rows, F.col("row_.doc_id").isNull(), F.col("row_.doc_id")), id_col="name_")
    return less(rows, found.where("doc_id != component_id").select("doc_id.rid_"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark."""
    rows = named(docs)
    found = decontaminate(judged(rows), table(spark, sf_dir, "benchmark"), id_col="name_")
    return less(rows, found.where("contaminated").select("doc_id.rid_"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again.

    What a stage read and wrote for itself is deleted once its result is written.
    """
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        forget_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
