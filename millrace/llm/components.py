"""Connected components of a link table, by alternating stars.

Every round rewires each node to the smallest node it sees, first from larger
neighbours and then from smaller ones, until the links are stars around the
smallest node of each component.  Links never leave the executors; each half
round is an aggregation and a join of two written tables, so that adaptive
execution can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round over links (a, b) with a > b."""
    if large:
        seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = links
    least = materialize(
        seen.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")),
        "star-least",
    )
    met = seen.join(least, F.col("a") == F.col("n"))
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links(a, b)``; root is its component's least node.

    Loops and repeated links are allowed; an empty table gives no rows.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links.distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = links.agg(mark.alias("x")).first()["x"]
    while True:
        wide = materialize(_star(links, large=True), "links")
        forget(links)
        links = materialize(_star(wide, large=False), "links")
        forget(wide)
        now = links.agg(mark.alias("x")).first()["x"]
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
