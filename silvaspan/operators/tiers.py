"""Levels of detail: cut sizes, tier selection, pendant-subtree clusters, quotient edges and their checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from silvaspan.operators.ordering import carry_each

GAMMA = 2.0
SMALL_COMPONENT = 64


def cut_sizes(index: DataFrame, *keys: str) -> DataFrame:
    """(keys, depth, visible): nodes shown when everything deeper than depth is folded, R(d) = sum of n[k <= d] + n[d + 1]."""
    hist = index.groupBy(*keys, "depth").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(*keys).orderBy("depth")
    return hist.select(*keys, "depth", (F.sum("n").over(by.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.lead("n").over(by), F.lit(0))).alias("visible"))


def select_cuts(sizes: DataFrame, *keys: str, gamma: float = GAMMA) -> DataFrame:
    """(keys, cuts): from cut 0 on, the next cut is the one whose size is nearest to gamma times the last in log space.

    Ties go to the smaller depth, sizes grow strictly, a plateau stands for the deepest cut, and a
    last-but-one cut that shows as much as the last is dropped. One fold over an array that is as long as
    the forest is deep; many forests (keys) are one job.
    """
    if not (isinstance(gamma, (int, float)) and math.isfinite(gamma) and gamma > 1):
        raise ValueError("gamma is a finite number above 1")
    sizes = sizes.withColumn("_all", F.lit(1)) if not keys else sizes
    own = keys or ("_all",)
    rows = sizes.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(F.col("depth").cast("int").alias("d"), F.col("visible").cast("double").alias("r")))).alias("a"))
    rows = rows.withColumn("top", F.element_at("a", -1))
    # Two picks in a row at least multiply the size by gamma, which bounds the turns of the fold.
    rows = rows.withColumn("turns", F.greatest(F.lit(1), F.ceil(2 * F.log(F.col("top.r")) / math.log(gamma)).cast("int") + 4))
    rows = rows.withColumn("s", F.expr(f"""
        aggregate(sequence(1, turns), named_struct('cuts', array(0), 'r', a[0].r), (s, k) ->
          element_at(transform(
            array(array_min(transform(filter(a, x -> x.r > s.r), x -> struct(greatest(x.r / ({gamma}D * s.r), {gamma}D * s.r / x.r) AS e, x.d AS d, x.r AS r)))),
            b -> IF(b IS NULL, s, named_struct('cuts', concat(s.cuts, array(b.d)), 'r', b.r))), 1))"""))
    # The last pick shows as much as the deepest cut, which stands for it.
    cuts = F.expr("concat(slice(s.cuts, 1, size(s.cuts) - 1), array(top.d))")
    return rows.select(*keys, cuts.alias("cuts"))


def clusters_at(index: DataFrame, cuts: DataFrame) -> DataFrame:
    """(level, cut, cluster_id, representative, node_id) for rows of cuts (level, cut): prefix nodes alone, each deeper branch one cluster.

    A node below the cut belongs to its ancestor at depth cut + 1: in preorder the last such node before it. The
    preorder is cut into spans, so a forest of one giant component is many tasks. Rows with their path (node_id, depth, path) name that
    ancestor themselves and need no order.
    """
    if "path" in index.columns:
        rows = index.select("node_id", "depth", "path").crossJoin(F.broadcast(cuts.select("level", "cut"))).withColumn("anchor", F.get("path", F.col("cut") + 1))
        return _named(rows)
    # A row per tier, at most as many as the forest is deep: all tiers are carried along one order of the nodes.
    tiers = cuts.select("level", "cut").collect()
    if not tiers:
        return _named(index.select("node_id", "depth").crossJoin(cuts.select("level", "cut")).withColumn("anchor", F.lit(None).cast("string")))
    rows = carry_each(index.select("node_id", "depth", "dfs_start"), "dfs_start", {f"a{k}": F.when(F.col("depth") == t["cut"] + 1, F.col("node_id")) for k, t in enumerate(tiers)})
    each = F.explode(F.array(*(F.struct(F.lit(t["level"]).cast(cuts.schema["level"].dataType).alias("level"), F.lit(t["cut"]).cast(cuts.schema["cut"].dataType).alias("cut"), F.col(f"a{k}").alias("anchor")) for k, t in enumerate(tiers))))
    return _named(rows.select("node_id", "depth", each.alias("t")).select("node_id", "depth", "t.*"))


def _named(rows: DataFrame) -> DataFrame:
    rep = F.when(F.col("depth") <= F.col("cut"), F.col("node_id")).otherwise(F.col("anchor"))
    rows = rows.select("level", "cut", "node_id", rep.alias("representative"))
    return rows.select("level", "cut", F.concat(F.lit("lod_"), F.col("level").cast("string"), F.lit("_"), F.col("representative")).alias("cluster_id"), "representative", "node_id")


def presentation_depths(index: DataFrame, small: int = SMALL_COMPONENT) -> DataFrame:
    """The index with depth 0 for all nodes of components of at most ``small`` nodes, so that no tier folds them; 0 turns this off."""
    size = F.count(F.lit(1)).over(W.partitionBy("component"))
    return index.withColumn("depth", F.when((size <= small) & (F.lit(small) > 0), F.lit(0)).otherwise(F.col("depth")).cast("long"))


def levels_of(cuts: DataFrame) -> DataFrame:
    """(level, cut) from one row of cuts."""
    return cuts.select(F.posexplode("cuts").alias("level", "cut"))


def quotient_edges(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, source, target, distance): edges between representatives of different clusters."""
    a = clusters.select("level", F.col("node_id").alias("source"), F.col("representative").alias("s"))
    b = clusters.select("level", F.col("node_id").alias("target"), F.col("representative").alias("t"))
    return edges.join(a, "source").join(b, ["level", "target"]).where("s <> t").select("level", F.col("s").alias("source"), F.col("t").alias("target"), "distance")


def shown_edges(index: DataFrame, cuts: DataFrame, edges: DataFrame) -> DataFrame:
    """The quotient edges (level, source, target, distance) of the tiers of cuts (level, cut), without their clusters, for edges from parents to children.

    What a tier folds is one cluster from depth cut + 1 on, so it shows the edges to nodes of at most that depth, and their ends stand for themselves.
    """
    rows = edges.join(index.select(F.col("node_id").alias("target"), "depth"), "target").crossJoin(F.broadcast(cuts.select("level", "cut")))
    return rows.where(F.col("depth") <= F.col("cut") + 1).select("level", "source", "target", "distance")


def quotient_faults(quotient: DataFrame, clusters: DataFrame) -> DataFrame:
    """(level, fault, n): parallel quotient edges, and clusters of several members with more than one edge."""
    ends = quotient.select("level", F.explode(F.array("source", "target")).alias("representative"))
    size = clusters.groupBy("level", "representative").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wide = ends.join(size, ["level", "representative"]).groupBy("level", "representative").count().where("count > 1").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    twice = quotient.groupBy("level", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).count().where("count > 1").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return twice.select("level", F.lit("parallel").alias("fault"), "n").unionByName(wide.select("level", F.lit("several edges").alias("fault"), "n"))


def consecutive_ratios(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with the value before, its ratio and its jump."""
    before = F.lag(value).over(W.orderBy(order))
    return df.withColumn("before", before).withColumn("ratio", F.try_divide(F.col(value).cast("double"), F.col("before"))).withColumn("jump", F.col(value) - F.col("before"))


def runs(df: DataFrame, order: str, value: str) -> DataFrame:
    """(value, start, length): runs of equal values in order."""
    grp = F.row_number().over(W.orderBy(order)) - F.row_number().over(W.partitionBy(value).orderBy(order))
    return df.withColumn("_g", grp).groupBy(value, "_g").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def tier_growth(clusters: DataFrame) -> DataFrame:
    """(level, cut, clusters, members, before, ratio, jump) of every tier."""
    sizes = clusters.groupBy("level", "cut").agg(F.countDistinct("cluster_id").alias("clusters"), F.count(F.lit(1)).alias("members"))
    return consecutive_ratios(sizes, "level", "clusters")


def growth_totals(growth: DataFrame, n_nodes: int) -> DataFrame:
    """One row of tier_growth: tiers, sum of clusters, its share of the nodes, membership rows, largest jump and ratio."""
    return growth.agg(
        F.count(F.lit(1)).alias("tiers"), F.sum("clusters").alias("clusters"), F.round(F.sum("clusters") / F.lit(n_nodes), 6).alias("per_node"), F.sum("members").alias("members"),
        F.max("jump").alias("largest_jump"), F.round(F.max("ratio"), 6).alias("largest_ratio"),
    )


def compare_policies(sizes: DataFrame, *keys: str, gamma: float = GAMMA) -> DataFrame:
    """(keys, policy, cuts): what-if cuts from cut_sizes: the first size of at least gamma times the last (threshold), the nearer of the two
    sizes about that (nearest, ties to the smaller depth), and depths that double (doubling, eleven before the last at most). All end at the deepest cut."""
    sizes = sizes.withColumn("_all", F.lit(1)) if not keys else sizes
    rows = sizes.groupBy(*(keys or ("_all",))).agg(F.array_sort(F.collect_list(F.struct(F.col("depth").cast("int").alias("d"), F.col("visible").cast("double").alias("r")))).alias("a")).withColumn("top", F.element_at("a", -1))
    upper = f"array_min(transform(filter(a, x -> x.d > s.d AND x.r >= {gamma}D * s.r), x -> x.d))"
    nearer = f"""array_min(transform(filter(a, x -> x.d > s.d AND x.r > s.r AND x.d <= u), x -> struct(abs(x.r - {gamma}D * s.r) AS e, x.d AS d))).d"""
    steps = "sequence(1, greatest(1, cast(ceil(2 * log2(top.r) / log2(" + f"{gamma}D" + ")) as int) + 4))"

    def fold(pick: str) -> str:
        return f"""aggregate({steps}, named_struct('cuts', array(0), 'd', 0, 'r', a[0].r, 'go', true), (s, k) -> IF(NOT s.go OR {gamma}D * s.r > top.r, named_struct('cuts', s.cuts, 'd', s.d, 'r', s.r, 'go', false),
            element_at(transform(array({upper}), u -> element_at(transform(array({pick}), c -> IF(c IS NULL OR c >= top.d, named_struct('cuts', s.cuts, 'd', s.d, 'r', s.r, 'go', false), named_struct('cuts', concat(s.cuts, array(c)), 'd', c, 'r', a[c].r, 'go', true))), 1)), 1)), s -> s.cuts)"""

    doubling = "concat(array(0), filter(transform(sequence(0, 9), k -> cast(power(2, k) as int)), x -> x < top.d))"
    cuts = F.array(*(F.struct(F.lit(n).alias("policy"), F.expr(f"array_distinct(concat({e}, array(top.d)))").alias("cuts")) for n, e in (("threshold", fold("u")), ("nearest", fold(nearer)), ("doubling", doubling))))
    return rows.select(*keys, F.explode(cuts).alias("x")).select(*keys, "x.policy", "x.cuts")


def validate_tiers(clusters: DataFrame, index: DataFrame) -> DataFrame:
    """(check, n): nodes in no or several clusters of a tier, clusters that no coarser one holds whole, representatives at a wrong depth."""
    levels = clusters.select("level").distinct()
    expected = index.select("node_id").crossJoin(F.broadcast(levels))
    counted = clusters.groupBy("level", "node_id").agg(F.count(F.lit(1)).alias("n"))
    partition = expected.join(counted, ["level", "node_id"], "left").where("coalesce(n, 0) <> 1").agg(F.count(F.lit(1)).alias("n"))
    coarse = clusters.select((F.col("level") + 1).alias("level"), "node_id", F.col("cluster_id").alias("above"))
    nested = clusters.join(coarse, ["level", "node_id"]).groupBy("level", "cluster_id").agg(F.countDistinct("above").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n"))
    depth = index.select(F.col("node_id").alias("representative"), "depth")
    wrong = clusters.where("node_id <> representative").join(depth, "representative").where("depth <> cut + 1").agg(F.count(F.lit(1)).alias("n"))
    out = partition.select(F.lit("partition").alias("check"), "n")
    return out.unionByName(nested.select(F.lit("refinement").alias("check"), "n")).unionByName(wrong.select(F.lit("representative depth").alias("check"), "n"))


def reduction_report(clusters: DataFrame, quotient: DataFrame, n_edges: int) -> DataFrame:
    """(level, nodes, edges, proxies, materialization, node_factor, node_reduction, edge_reduction, primitive_reduction): what each tier shows of the whole, which has n_edges edges.

    materialization: shown nodes over all; node_factor: its inverse; primitives are nodes and edges together.
    """
    size = clusters.groupBy("level", "cluster_id").agg(F.count(F.lit(1)).alias("m"))
    nodes = size.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("m") > 1).alias("proxies"), F.sum("m").alias("all"))
    edges = quotient.groupBy("level").agg(F.count(F.lit(1)).alias("edges"))
    rows = nodes.join(edges, "level", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    shown = F.col("nodes") + F.col("edges")
    return rows.select(
        "level", "nodes", "edges", "proxies", F.round(F.col("nodes") / F.col("all"), 6).alias("materialization"), F.round(F.col("all") / F.col("nodes"), 6).alias("node_factor"),
        F.round(1 - F.col("nodes") / F.col("all"), 6).alias("node_reduction"), F.round(1 - F.try_divide("edges", F.lit(n_edges)), 6).alias("edge_reduction"), F.round(1 - F.try_divide(shown, F.col("all") + F.lit(n_edges)), 6).alias("primitive_reduction"),
    )
