"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum (combined before its shuffle) and a join, so no task holds a node's whole neighbourhood.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v): each node hands its (larger, or not larger) neighbours to the smallest it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, save: Callable[[DataFrame, str], DataFrame], drop: Callable[..., None] = lambda *_: None, most: int = 100) -> DataFrame:
    """(node, component) for every node of edges (u, v) of one orderable type; a component is named by its smallest node.

    save(df, name) writes a table and reads it again, which cuts the lineage; drop(name) removes it. Null ends and loops
    (u = v) don't connect; a node with loops alone isn't returned. Repeated edges do no harm; no edges give no rows.
    """
    current, name = save(edges.toDF("u", "v").where("u <> v").distinct(), "cc0"), "cc0"
    mark = None
    for i in range(1, most + 1):
        following = save(_star(_star(current, True), False), f"cc{i}")
        drop(name)
        current, name = following, f"cc{i}"
        row = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not row["n"] or tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
