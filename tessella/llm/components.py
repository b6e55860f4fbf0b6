"""Connected components of an edge table, by contraction: nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node) for every node with an edge. Self-loops and null ends are no edges.

    Each round every node takes its least neighbour's name or keeps its own, edges take the new names, and loops and repeats go.
    Hubs are no problem: least names are pre-aggregated before the shuffle.
    """
    live = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    names: DataFrame | None = None
    while live.head(1):
        both = live.union(live.select("v", "u"))
        step = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")), "step")
        if names is None:
            names = step.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            old = names
            names = written(
                old.join(step, old.component == step.u, "left").select("node", F.coalesce("to", "component").alias("component")), "names"
            )
        x, y = step.withColumnRenamed("u", "xu").withColumnRenamed("to", "x"), step.withColumnRenamed("u", "yu").withColumnRenamed("to", "y")
        new = live.join(x, live.u == x.xu).join(y, live.v == y.yu).select(F.col("x").alias("u"), F.col("y").alias("v")).where("u <> v").distinct()
        before, live = live, written(new, "edges")
        forget(before)
    return names if names is not None else live.select(F.col("u").alias("node"), F.col("v").alias("component"))
