"""Connected components of links, by alternating large and small stars.

Each round hangs every node onto the smallest node it has seen, first on the
side of the larger neighbours, then of the smaller ones. The number of links
never grows, hubs are reduced by partial minima, and every round ends in a
written table, so nothing is gathered and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustfold.functions.storage import durable


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a, b) with a > b."""
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node of its component.

    ``links`` has two columns of one integer type. Direction, repeats and
    loops don't matter; rows with a null are left out; no links give no rows.
    """
    a, b = links.columns
    links = durable(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
        .filter("x is not null and y is not null and a > b").select("a", "b").distinct(),
        "links",
    )
    mark = _mark(links)
    while mark[0]:
        links = durable(_round(links), "stars")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
