import pytest
from pyspark.sql import types as T

#: Columns that clash with names the operators use inside.
EXTRA = ["rid", "n", "w", "text_", "gid", "body", "bucket_", "least", "fp", "held_out", "row"]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from ``(id, text)`` pairs, with columns of clashing names."""

    def build(rows, extra=True, partitions=3, id_type=None):
        fields = [T.StructField("doc_id", id_type or T.LongType()), T.StructField("text", T.StringType())]
        names = EXTRA if extra else []
        fields += [T.StructField(n, T.StringType()) for n in names]
        data = [(i, t, *["x"] * len(names)) for i, t in rows]
        return spark.createDataFrame(data, T.StructType(fields)).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, white space, very long, ties in all but case, repeated rows, other scripts."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "Hello World, hello world again and again"),
        (5, "hello world, hello world again and again"), (5, "hello world, hello world again and again"),
        (6, long), (7, long + " end"), (8, "É è Ç straße İstanbul 日本語 and 東京"), (9, "é è ç straße İstanbul 日本語 and 東京"),
        (10, "a"), (11, "A"), (None, "hello world, hello world again and again"), (None, None), (12, "x" * 3000),
        (13, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
        (14, "One-Two three four five, six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    ]
