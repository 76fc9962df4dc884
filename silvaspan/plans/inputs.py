"""Derived inputs of the registered queries, all computed by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from silvaspan.operators.forest import forest_paths, index_forest
from silvaspan.operators.tiers import clusters_at
from silvaspan.sources.tables import table


def forest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, roots): regions, their nations, their customers and their orders."""
    region, nation, customer, orders = (table(spark, sf, t) for t in ("region", "nation", "customer", "orders"))

    def ident(letter: str, c: str):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    edges = nation.select(ident("R", "n_regionkey").alias("source"), ident("N", "n_nationkey").alias("target"), F.lit(1.0).alias("distance"))
    edges = edges.unionByName(customer.select(ident("N", "c_nationkey").alias("source"), ident("C", "c_custkey").alias("target"), F.lit(1.0).alias("distance")))
    edges = edges.unionByName(orders.select(ident("C", "o_custkey").alias("source"), ident("O", "o_orderkey").alias("target"), (F.floor("o_totalprice") % 100).cast("double").alias("distance")))
    edges = edges.select(F.concat_ws("_", F.lit("e"), "source", "target", F.lit("1")).alias("edge_id"), "source", "target", "distance")
    roots = region.select(ident("R", "r_regionkey").alias("node_id"), F.col("r_regionkey").cast("long").alias("root_pos"))
    nodes = roots.select("node_id").unionByName(edges.select(F.col("target").alias("node_id")))
    return nodes, edges, roots


def index(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, roots = forest(spark, sf)
    return index_forest(edges, roots)


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """(node_id, depth, path) of every node, for what needs no order; the whole index where the forest is too deep for paths."""
    _, edges, roots = forest(spark, sf)
    found = forest_paths(edges, roots)
    return index(spark, sf) if found is None else found


def owners(rows: DataFrame) -> DataFrame:
    """(node_id, component, parent) from the paths of all nodes, or from the index."""
    if "path" not in rows.columns:
        return rows.select("node_id", "component", "parent")
    return rows.select("node_id", F.get("path", F.lit(0)).alias("component"), F.get("path", F.size("path") - 2).alias("parent"))


def cut_levels(spark: SparkSession) -> DataFrame:
    """The three tiers of the four-level forest."""
    return spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "level int, cut int")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters_at(paths(spark, sf), cut_levels(spark))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as profiles of six loci; the seventh is missing in some rows."""
    part = table(spark, sf, "part")
    word = F.split("p_name", " ")
    loci = [F.col("p_brand"), F.col("p_type"), (F.col("p_size") % 5 + 1).cast("string"), F.get(word, F.lit(0)), (F.floor("p_retailprice") % 7 + 1).cast("string"), (F.col("p_partkey") % 3 + 1).cast("string")]
    missing = F.when(F.col("p_partkey") % 11 == 0, F.lit("0")).otherwise(F.lit("1"))
    return part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("isolate_id"), F.col("p_partkey").alias("input_pos"), F.array(*(F.coalesce(x, F.lit("none")) for x in loci), missing).alias("alleles"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the forest on a plane, with a category for customers and orders."""
    region, nation, customer, orders = (table(spark, sf, t) for t in ("region", "nation", "customer", "orders"))

    def placed(df: DataFrame, letter: str, key: str, x, y, segment) -> DataFrame:
        return df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("node_id"), x.cast("double").alias("x"), y.cast("double").alias("y"), segment.cast("string").alias("segment"))

    rows = placed(customer, "C", "c_custkey", F.col("c_custkey") % 97, F.col("c_acctbal"), F.col("c_mktsegment"))
    rows = rows.unionByName(placed(orders, "O", "o_orderkey", F.col("o_orderkey") % 89, F.floor("o_totalprice") % 9000, F.col("o_orderpriority")))
    rows = rows.unionByName(placed(nation, "N", "n_nationkey", F.col("n_nationkey") * 3.5, F.col("n_nationkey") * 300.0, F.lit(None)))
    return rows.unionByName(placed(region, "R", "r_regionkey", F.col("r_regionkey") * 20.0, F.lit(5000.0), F.lit(None)))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One box per nation."""
    nation = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    return nation.select(k.alias("request_id"), (k * 3).cast("double").alias("x0"), (k * 3 + 20).cast("double").alias("x1"), (k * 100.0).alias("y0"), (k * 100.0 + 3000).alias("y1"))
