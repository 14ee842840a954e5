"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage


def _is_star_forest(links: DataFrame) -> bool:
    """True if every vertex has one link upwards and no root is linked further."""
    counts = links.groupBy("u").count()
    inner = links.select(F.col("v").alias("u")).distinct().join(links.select("u").distinct(), "u")
    several = counts.filter("count > 1").select("u")
    return inner.union(several).isEmpty()


def connect(links: DataFrame) -> DataFrame:
    """Rows (``u``, ``v``): every linked vertex but the roots, with the smallest vertex it can reach.

    ``links`` has ``u`` and ``v`` in any order; links from a vertex to itself and repeated links don't
    matter. Each round writes its links to the shared folder; the rounds grow with the logarithm of the
    longest path. Minima are aggregated before the shuffle, so a vertex may have any number of links.
    """
    links = cut_lineage(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while not _is_star_forest(links):
        both = links.union(links.select("v", "u"))
        nearest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(nearest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
    return links
