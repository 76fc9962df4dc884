"""Annotations attached to what a read shows: direct records, observations, cluster values, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from silvaspan.functions.labels import coerce
from silvaspan.operators.reads import filter_annotations
from silvaspan.operators.summaries import aggregate_cluster


def direct_annotations(records: DataFrame, members: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """(node_id, key, value) from records (id, key, value): ids of isolates become their normalised ids.

    The same isolate under two ids is an error. Values of declared types (key, type) are coerced, others stay.
    """
    rows = records.select("id", "key", "value")
    if members is None:
        rows = rows.withColumn("node_id", F.col("id"))
    else:
        known = members.select(F.col("isolate_id").alias("id"), "isolate_norm").distinct()
        rows = rows.join(known, "id", "left").withColumn("node_id", F.coalesce("isolate_norm", "id"))
        if rows.groupBy("node_id").agg(F.count_distinct("id").alias("n")).where("n > 1").limit(1).count():
            raise ValueError("direct records name the same isolate twice")
    if declared is None:
        return rows.select("node_id", "key", "value")
    typed = rows.join(declared.select("key", "type"), "key", "left")
    return typed.select("node_id", "key", F.coalesce(coerce("value", "type"), F.when(F.col("type").isNull(), F.col("value"))).alias("value"))


def filter_observations(observations: DataFrame, accepted: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """The observations (node_id, ...) that match; a node without any is gone."""
    return filter_annotations(observations, accepted, ranges)


def nodes_with_observations(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """nodes with at least one kept observation."""
    return nodes.join(kept.select("node_id").distinct(), "node_id", "left_semi")


def bounds(positions: DataFrame, index: DataFrame | None = None, component: str | None = None) -> DataFrame:
    """One row (x0, x1, y0, y1): the box of all positions, or of one component, which has to exist."""
    if component is not None:
        own = index.where(F.col("component") == component).select("node_id")
        if not own.limit(1).count():
            raise ValueError(f"no component {component}")
        positions = positions.join(own, "node_id", "left_semi")
    return positions.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def cluster_observations(clusters: DataFrame, isolates: DataFrame, annotations: DataFrame) -> DataFrame:
    """(cluster_id, node_id, data, reference): per member its isolates' data, else its own annotation, else ``{}``.

    isolates: (node_id, isolate_id, data); annotations: (node_id, data); data are JSON texts.
    """
    rows = clusters.select("cluster_id", "node_id").join(isolates.select("node_id", "isolate_id", F.col("data").alias("own")), "node_id", "left").join(annotations.select("node_id", F.col("data").alias("other")), "node_id", "left")
    reference = F.when(F.col("isolate_id").isNotNull(), F.concat(F.lit("isolate:"), "isolate_id")).otherwise(F.concat(F.lit("node:"), "node_id"))
    return rows.select("cluster_id", "node_id", F.coalesce("own", "other", F.lit("{}")).alias("data"), reference.alias("reference"))


def observation_counts(observations: DataFrame) -> DataFrame:
    """(cluster_id, data, n, reference): equal observations of a cluster counted, with the smallest reference."""
    return observations.groupBy("cluster_id", "data").agg(F.count(F.lit(1)).alias("n"), F.min("reference").alias("reference"))


def suppress_known(counts: DataFrame, known: DataFrame) -> DataFrame:
    """counts with ``cached``; data of references that the caller knows (reference) is left out."""
    rows = counts.join(known.select("reference", F.lit(True).alias("cached")).distinct(), "reference", "left")
    return rows.select("cluster_id", F.when(F.col("cached").isNull(), F.col("data")).alias("data"), "n", "reference", F.coalesce("cached", F.lit(False)).alias("cached"))


def cluster_annotations(clusters: DataFrame, cells: DataFrame, types: DataFrame) -> DataFrame:
    """(level, cluster_id, key, value) for all tiers in one job: means of numbers, most frequent texts of others."""
    members = clusters.select("level", "cluster_id", "node_id").join(cells.select("node_id", "key", "value"), "node_id")
    return aggregate_cluster(members, types, "level").select("level", "cluster_id", "key", "value")


def attach_metadata(nodes: DataFrame, annotations: DataFrame, cluster_values: DataFrame, isolates: DataFrame, counts: DataFrame, index: DataFrame) -> DataFrame:
    """nodes (node_id, cluster_id, is_representative, members) with data, isolates, distribution and tree interval.

    A representative gets its cluster's data and distribution, another node its own data; a node alone in
    its cluster gets its isolates. Lists are sorted and as long as one node's isolates or one cluster's kinds of observations.
    """
    own = annotations.select("node_id", F.col("data").alias("node_data"))
    other = cluster_values.select("cluster_id", F.col("data").alias("cluster_data"))
    lists = isolates.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("isolate_id", "data"))).alias("isolate_list"))
    kinds = counts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("data", "n", "reference"))).alias("kinds"))
    rows = nodes.join(own, "node_id", "left").join(other, "cluster_id", "left").join(lists, "node_id", "left").join(kinds, "cluster_id", "left")
    rows = rows.join(index.select("node_id", "component", "parent", "depth", "dfs_start", "dfs_end"), "node_id", "left")
    shown = F.col("is_representative")
    return rows.select(
        "node_id", "cluster_id", "is_representative", "members", F.when(shown, F.col("cluster_data")).otherwise(F.col("node_data")).alias("data"),
        F.coalesce(F.when(F.col("members") == 1, F.col("isolate_list")), F.array()).alias("isolates"), F.coalesce(F.when(shown, F.col("kinds")), F.array()).alias("distribution"),
        "component", "parent", "depth", "dfs_start", "dfs_end",
    )
