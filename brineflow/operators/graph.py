"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow import runtime


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (``a``, ``b``); a component is named by its smallest node.

    Alternating stars: every node first hands its larger neighbours, then its
    smaller ones, to the smallest of its neighbourhood. The depth of the graph
    shrinks with each pair of steps; each step is a minimum per node, merged
    before it is shuffled, and a join that Spark splits where one node has many
    edges. Rows with a null end are left out; a loop makes a component of one.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    # a: the larger end, b: the smaller.
    cur = runtime.save(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _fingerprint(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Larger neighbours go to the smallest of the neighbourhood.
        large = cur.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = runtime.save(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = runtime.save(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        runtime.drop(large)
        after = _fingerprint(nxt)
        if after == before:
            break
        runtime.drop(cur)
        cur, before = nxt, after
    members = nxt.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = nxt.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.join(members.select("node").unionByName(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return members.unionByName(roots).unionByName(alone)
