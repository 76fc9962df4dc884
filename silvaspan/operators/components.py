"""Connected components of an edge table: alternating large-star and small-star rounds, or one bounded task for few edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from silvaspan.operators.skew import counted_join, spread_join
from silvaspan.scratch import Scratch


def _print_of(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


#: Up to this many distinct edges one task finds the components; the rounds of a larger graph give the same rows.
LOCAL = 1 << 16

#: A graph of at most HELD nodes and more than two edges a node is thinned first, by tasks of DENSE edges a node.
HELD, DENSE = 1 << 18, 8


def _thinned(now: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v) that join the same nodes: each task reads its edges once and keeps those that link two of its components, so fewer than there are nodes."""

    def run(batches):
        root: dict = {}
        for pdf in batches:
            kept = []
            for u, v in zip(pdf["u"], pdf["v"]):
                a, b = root.setdefault(u, u), root.setdefault(v, v)
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                if a != b:
                    root[a] = b
                    kept.append((u, v))
            # An estimate of the nodes was too low: what is held is let go, and some more edges are kept.
            if len(root) > 2 * HELD:
                root = {}
            yield pd.DataFrame(kept, columns=["u", "v"])

    return now.select("u", "v").repartition(tasks).mapInPandas(run, now.select("u", "v").schema)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, component) of a bounded number of edges (u, v), by linking the larger root below the smaller."""
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in zip(pdf["u"], pdf["v"]):
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": list(root), "component": [find(x) for x in list(root)]})


def _without_leaves(now: DataFrame) -> DataFrame:
    """Distinct edges (u, v), u > v, with ``leaf``: the end that no other edge touches, the larger of two, null if there is none."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ends = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).where("n = 1")
    ends = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").alias("leaf"))
    return now.select("u", "v").unionByName(ends, allowMissingColumns=True).groupBy("u", "v").agg(F.max("leaf").alias("leaf"))


def _hung_up(found: DataFrame, peels: list[tuple[DataFrame, int]], scratch: Scratch) -> DataFrame:
    """(node, component) with the leaves that were taken away, the last first; components are named by their smallest node at the end."""
    if not peels:
        return found
    for hung, n in reversed(peels):
        rows = hung.select("leaf", F.when(F.col("leaf") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("node"))
        rows = scratch.save(counted_join(rows, found, "node", scratch, n, "left"), "hung")
        # A node whose edges all went is named by itself.
        bare = rows.where("component is null").select("node", F.col("node").alias("component")).distinct()
        found = found.unionByName(bare).unionByName(rows.select(F.col("leaf").alias("node"), F.coalesce("component", "node").alias("component")))
    found = scratch.save(found, "named")
    low = scratch.save(found.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    return spread_join(found, low, "component", "n", found.count()).select("node", F.col("least").alias("component"))


def components_of_edges(edges: DataFrame, left: str | Column = "a", right: str | Column = "b", local: int | None = None) -> DataFrame:
    """(node, component) for every node that an edge touches; component is the smallest node reachable.

    Self-loops, repeated edges, either direction and nulls are allowed: an edge with a null end counts
    as no edge. An empty table gives an empty result. Each round costs two shuffles of the remaining
    edges, every star keeps at most one row per node, and the number of rounds grows with the
    logarithm of the longest path.

    A graph of many edges and few nodes is thinned first: every task keeps the edges that join what its others do not.
    As long as at least half of the edges end in a node that no other edge touches, these leaves are taken away first and get the
    component of their neighbour at the end, so that of a forest only the inner nodes go through the rounds.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    a, b = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a.alias("_a"), b.alias("_b"))
    pairs = pairs.where("_a is not null and _b is not null")
    now = scratch.save(pairs.select("u", "v").distinct(), "edges")
    loops, now = now.where("u = v").select("u"), now.where("u <> v")
    before, most = _print_of(now), LOCAL if local is None else local
    while before[0] > most:
        # Ends on either side, so at least as many as there are nodes.
        nodes = sum(now.agg(F.approx_count_distinct("u"), F.approx_count_distinct("v")).first())
        if nodes > HELD or before[0] <= 2 * nodes:
            break
        thin = scratch.save(_thinned(now, max(1, before[0] // (DENSE * nodes))), "thin")
        fewer = _print_of(thin)
        if fewer[0] >= before[0]:
            break
        now, before = thin, fewer
    peels = []
    while before[0] > most:
        peeled = scratch.save(_without_leaves(now), "peeled")
        n = peeled.where("leaf is not null").count()
        if 2 * n < before[0]:
            break
        peels.append((peeled.where("leaf is not null"), n))
        now = peeled.where("leaf is null").select("u", "v")
        before = _print_of(now)
    if before[0] <= most:
        kind = now.schema["u"].dataType.simpleString()
        found = now.groupBy(F.lit(0).alias("all")).applyInPandas(_joined, f"node {kind}, component {kind}")
        found = _hung_up(scratch.save(found, "local"), peels, scratch)
        alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
        return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = scratch.save(small, "small")
        scratch.drop(now)
        now, after = new, _print_of(new)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = _hung_up(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), peels, scratch)
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))
