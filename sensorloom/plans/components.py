"""Connected components of a graph of any size, as a loop of joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.plans.scratch import dropped, written


#: So many edges at most are finished by one task at once: a few megabytes there, whatever the graph's size was.
FEW_EDGES = 20_000


def _finished(edges: pd.DataFrame) -> pd.DataFrame:
    """``node, into`` of a small rest of the graph, by union-find."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(edges["src"], edges["dst"], strict=True):
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return pd.DataFrame({"node": list(parent), "into": [root(x) for x in parent]})


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node, component`` for every node of ``edges(src, dst)``; a component is named by its smallest node.

    Each round merges every node into the first of its closed neighbourhood and joins the edges to the
    merged nodes. Rounds take nodes by name and by a hash in turn: the first ends stars around their
    smallest node at once, the second halves long chains. The last ``FEW_EDGES`` are finished by one task, which
    saves rounds and changes nothing else. A loop beyond ``max_rounds`` raises.
    """
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left = written(edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    merged: list[DataFrame] = []
    while (n_left := left.count()) > 0:
        if n_left <= FEW_EDGES:
            kind = left.schema["src"].dataType.simpleString()
            merged.append(written(left.groupBy(F.lit("all")).applyInPandas(_finished, f"node {kind}, into {kind}")))
            break
        if len(merged) >= max_rounds:
            raise RuntimeError(f"no stable components after {max_rounds} rounds")
        turn = len(merged)
        first = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c: F.xxhash64(F.col(c), F.lit(turn)))
        both = left.union(left.select("dst", "src"))
        near = both.groupBy("src").agg(F.min(F.struct(first("dst").alias("o"), F.col("dst").alias("n"))).alias("near"))
        own = F.struct(first("src").alias("o"), F.col("src").alias("n"))
        to = written(near.select(F.col("src").alias("node"), F.least("near", own)["n"].alias("into")))
        merged.append(to)
        a, b = to.select(F.col("node").alias("src"), F.col("into").alias("a")), to.select(F.col("node").alias("dst"), F.col("into").alias("b"))
        ends = left.join(a, "src").join(b, "dst").where(F.col("a") != F.col("b"))
        former, left = left, written(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        dropped(former)
    found = names.select("node", F.col("node").alias("at"))
    for to in merged:
        found = found.join(to.select(F.col("node").alias("at"), "into"), "at", "left").select("node", F.coalesce("into", "at").alias("at"))
    if len(merged) > 1:
        found = written(found)
        dropped(*merged)
    dropped(left)
    least = found.groupBy("at").agg(F.min("node").alias("component"))
    return found.join(least, "at").select("node", "component")
