"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node of links (src, dst) that has a link to another.

    Every round reconnects each node's neighbours to the smallest node around it and writes the links
    to the shared folder; rounds grow with the logarithm of a component's size. Loops and repeats are
    harmless; no links give no rows. Fails if most_rounds do not suffice.
    """
    links = materialise(links.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    known = None
    for _ in range(most_rounds):
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("sum")).first()
        if (state["n"], state["sum"]) == known or not state["n"]:
            return links.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(links.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
        known = (state["n"], state["sum"])
        both = links.union(links.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("least"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(least.select("src", "least"))
        links = materialise(small.filter("src <> dst").distinct())
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
