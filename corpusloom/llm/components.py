"""Connected components of an edge list, distributed (large-star / small-star rounds).

Every round moves each edge a bounded number of times and aggregates by
minimum, with partial sums on the map side, so that a hub of a third of all
nodes is no more than many rows of one key (which adaptive execution splits in
the joins).  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, release

MAX_ROUNDS = 60
#: Edges a task takes; a short list is not dealt to thousands of tasks that each write files.
TASK_EDGES, LEAST_TASKS = 20_000, 8


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step; edges are (u, v) with u > v."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): of each node in an edge (a, b), the smallest node it reaches."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = cut(edges), None
    most, n = partitions(edges.sparkSession), edges.count()
    for _ in range(MAX_ROUNDS):
        tasks = min(most, max(LEAST_TASKS, n // TASK_EDGES + 1))
        new = cut(_star(_star(edges.coalesce(tasks), True, tasks), False, tasks))
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        edges = new
        if seen == mark or not seen[0]:
            break
        mark, n = seen, seen[0]
    else:
        raise RuntimeError("components did not settle")
    release(edges.sparkSession)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
