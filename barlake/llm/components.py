"""Connected components of an edge table, by hooking nodes to smaller neighbours and jumping along the pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.native import sided
from barlake.llm.tables import counted


def _jumped(parents: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(node, root) for pointers (node, root) to smaller nodes, each followed to its end."""
    while n:
        up = sided(parents.select(F.col("node").alias("root"), F.col("root").alias("_up")), n)
        step = parents.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved"))
        step, n, moved = counted(step, "pointers", F.count_if("_moved"))
        parents = step.select("node", "root")
        if not moved:
            break
    return parents, n


def _through(table: DataFrame, column: str, roots: DataFrame, n: int) -> DataFrame:
    """table with `column` replaced by its root, where it has one."""
    to = sided(roots.select(F.col("node").alias(column), F.col("root").alias("_to")), n)
    return table.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) for every node of edges (u, v) but the roots themselves, and their number; root is the least node of its component.

    In each round every node points to its least smaller neighbour, pointers are followed to their ends, and edges
    whose ends have met go. Each round is a written table, of which the driver sees counts. A table of at most SMALL_ROWS rows is broadcast, a
    larger one is shuffled.
    """
    none = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    edges, left = counted(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    total, n = none, 0
    while left:
        parents, k = counted(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "pointers")
        roots, k = _jumped(parents, k)
        total, n = counted(_through(total, "root", roots, k).unionByName(roots), "roots") if n else (roots, k)
        met = _through(_through(edges, "u", roots, k), "v", roots, k).where("u != v")
        edges, left = counted(met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return total, n


def grown(roots: DataFrame, n: int, edges: DataFrame) -> tuple[DataFrame, int]:
    """components with further edges (u, v): only the roots that the edges join are looked at."""
    moved, k = components(_through(_through(edges, "u", roots, n), "v", roots, n))
    return counted(_through(roots, "root", moved, k).unionByName(moved), "roots") if k else (roots, n)
