"""Connected components of edge tables by alternating stars; every step is an aggregate with map-side minima and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component: its smallest reachable node) for every node of edges (a, b: long). Loops and repeats are harmless.

    Large star: each neighbour above a node points to the least of the node's neighbourhood. Small star: likewise for
    those below. They end in stars around the least nodes. Hubs are never collected: minima are pre-aggregated.

    Cases: rows with a null end are no edges; a node without another neighbour than itself is not returned; an empty
    table gives an empty table; extra columns are ignored.
    """

    def least(e):
        return e.groupBy("a").agg(F.min("b").alias("_m"))

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, name)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("_m", "a"))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        large = materialize(large, name)
        small = large.join(least(large), "a")
        small = small.select("a", F.col("_m").alias("b")).unionByName(small.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))).distinct()
        old, e = e, materialize(small, name)
        discard(old, large)
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
