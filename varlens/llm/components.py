"""Connected components by alternating large-star and small-star, as DataFrame joins.

Each operation gives every node's neighbours a link to the smallest node it sees; the two in turn
leave stars around the smallest node of each component after a number of rounds that grows with the
logarithm of the nodes. A node's smallest neighbour is a map-side combined minimum; links go back to
it by a join that adaptive execution splits where one node has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.session import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``u, v`` links of longs -> one row (u, v) for each node but the smallest of its component, v."""
    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), f"{label}-0")
    mark, step = _mark(now), 0
    while True:
        step += 1
        new = scratch.save(_small_star(_large_star(now)), f"{label}-{step}")
        new_mark = _mark(new)
        if new_mark == mark:
            return new
        scratch.drop(f"{label}-{step - 1}")
        now, mark = new, new_mark
