"""Connected components of a graph that no machine holds: alternating large-star and small-star rounds.

Each round replaces a node's edges by edges to the smallest node near it; stars with the component's smallest node
as their centre are what is left.  Every step is a shuffle with sums by key; nothing is gathered per component, and the
edges of a hub are not gathered at the hub (``join_sums``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwise.llm.common import discard, join_sums, materialize

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node that an edge touches; the label is the component's smallest node.

    Null ends are left out; loops and repeated edges are harmless; no edges give an empty table."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    e = materialize(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct())
    state = _state(e)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_sums(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")), least, ["u"], state[0])
        large = materialize(large.where(F.col("v") != F.col("m")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        pairs = join_sums(large, lowest, ["hi"], state[0])
        small = pairs.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where(F.col("hi") != F.col("lo")).unionAll(lowest.select("hi", F.col("m").alias("lo"))).distinct()
        old, e = e, materialize(small)
        discard(old, large)
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
