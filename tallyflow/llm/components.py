"""Connected components of a distributed list of links, by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.session import materialize

ROWS_A_TASK = 50_000


def tasks_for(rows: int, each: int = ROWS_A_TASK) -> int:
    """Tasks for a table of counted size; many tasks for few rows only cost time."""
    return 1 + rows // each


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that occurs in a link; the root is the least node.

    Each round links every node to the least node it knows of (large star, then
    small star), so trees get flat in about log(diameter) rounds; each round
    writes its links to the shared folder, which cuts the lineage. It ends when
    every node has one link, to a node that has none.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "links")
    tasks = tasks_for(edges.count())
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
            edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        )
        ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).coalesce(tasks)
        if ends.filter("out > 1 or (out = 1 and into = 1)").isEmpty():
            break
        # Large star: greater neighbours of a node get linked to the least node around it.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).coalesce(tasks)
        large = both.join(least, "u").coalesce(tasks).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours of a node, and the node, get linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least, "u").coalesce(tasks).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(small.coalesce(tasks), "links")
    flat = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return flat.union(flat.select(F.col("root").alias("node"), "root").distinct().coalesce(tasks))
