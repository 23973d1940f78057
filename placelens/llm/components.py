"""Connected components of a table of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.llm.common import discard, materialise


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("low"))


def _is_settled(links: DataFrame) -> bool:
    """Every node has one link downwards or only links from above."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        links.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    sums = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sums.filter("down + up > 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to
    the least of them, until every node hangs on its root: rounds grow with the
    logarithm of the longest path. Each round is stored, minima combine before
    the shuffle, only a yes or no reaches the driver, and a round's table goes once
    the next is stored. `links` should be stored.
    """
    now = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _lowest(both).select("u", F.least("u", "low").alias("low"))
        # Large star: each larger neighbour of u is linked to the least around u.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        # Small star: each smaller neighbour of u, and u, is linked to the least of them.
        joined = large.join(_lowest(large), "u")
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))
        small = joined.select(F.explode(pairs).alias("p")).select("p.u", "p.v").filter("u != v")
        now = materialise(small.distinct())
        if last is not None:
            discard(last)
        if _is_settled(now):
            break
        last = now
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
