"""Connected components of an edge list, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainsift.llm.common import discard, written

ROW_BYTES = 16  # of two ids


def components(edges: DataFrame, src: str = "u", dst: str = "v", most: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable from every id that has an edge.

    Each round hooks every component to its smallest neighbour, shortens these pointers twice by joins and
    contracts the edges, which at least halves what is left; no edges, labels or components reach the driver.
    Rounds are written to the shared folder, so lost executors cost one round at most. most: how many rows edges has at
    most, where that is known; small rounds go into few files.
    """
    edges = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where("u < v").distinct()
    edges = written(edges, "cc-edges", most_bytes=None if most is None else most * ROW_BYTES)
    left = edges.count()
    ends = 2 * left * ROW_BYTES
    labels = written(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("component")), "cc-labels", most_bytes=ends)
    while left:
        hook = edges.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("p"))
        for _ in range(2):
            up = hook.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"))
        hook = written(hook, "cc-hooks", most_bytes=left * ROW_BYTES)
        moved = labels.join(hook.withColumnRenamed("c", "component"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        moved = written(moved, "cc-labels", most_bytes=ends)
        a, b = hook.select(F.col("c").alias("u"), F.col("p").alias("pu")), hook.select(F.col("c").alias("v"), F.col("p").alias("pv"))
        less = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y"))
        less = written(less.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "cc-edges", most_bytes=left * ROW_BYTES)
        for old in (labels, edges, hook):
            discard(old)
        labels, edges, left = moved, less, less.count()
    discard(edges)
    return labels
