"""Summaries of annotations over clusters: means, modes, counts and joint distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from silvaspan.functions.labels import blank_to_null
from silvaspan.scratch import Scratch

MISSING = "Missing"
OTHER = "Other"


def aggregate_cluster(values: DataFrame, types: DataFrame, *more: str) -> DataFrame:
    """(more, cluster_id, key, value) from the same columns: the mean of numbers; of others the most frequent text, ties to the smallest. types has a row per field."""
    rows, by = values.where("value is not null"), [*more, "cluster_id", "key"]
    # Few rows, but Spark does not know it, and with one field the join has no key left: without the broadcast the values are paired with every part of types.
    typed = lambda is_: rows.join(F.broadcast(types.where(f"type {is_} 'number'").select("key")), "key")
    means = typed("=").groupBy(*by).agg(F.round(F.avg(F.col("value").try_cast("double")), 6).cast("string").alias("value"))
    counts = typed("<>").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy(*by).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return means.unionByName(modes)


def sum_counts(counts: DataFrame, *keys: str) -> DataFrame:
    """Category counts (…, n) added over members, positive sums only."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def observation_distribution(cells: DataFrame) -> DataFrame:
    """(cluster_id, observation, n, reference) from (cluster_id, row_pos, key, value): equal rows counted, with the first as reference."""
    rows = cells.where("value is not null").groupBy("cluster_id", "row_pos").agg(F.to_json(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("observation"))
    return rows.groupBy("cluster_id", "observation").agg(F.count(F.lit(1)).alias("n"), F.min("row_pos").alias("reference"))


def category_distribution(observations: DataFrame, fields: list[str], *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, category, n): blank values are Missing; several fields combine to an ordered JSON list."""
    parts = [F.coalesce(blank_to_null(F.col(f).cast("string")), F.lit(MISSING)) for f in fields]
    category = parts[0] if len(parts) == 1 else F.to_json(F.array(*parts))
    return observations.groupBy(*keys, category.alias("category")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def with_percentage(dist: DataFrame, *keys: str) -> DataFrame:
    """dist with the share of each row in its total, in percent; null for an empty total. Totals are summed up apart."""
    share = F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.col("_total")), 6)
    if not keys:
        return dist.crossJoin(F.broadcast(dist.agg(F.sum("n").alias("_total")))).withColumn("percentage", share).drop("_total")
    return dist.join(dist.groupBy(*keys).agg(F.sum("n").alias("_total")), list(keys)).withColumn("percentage", share).drop("_total")


def distribution_report(whole: DataFrame, subset: DataFrame, fields: list[str], node: str | None = None) -> DataFrame:
    """(category, n, subset_n, percentage, subset_percentage): the subset keeps all categories of the whole.

    With the column that names nodes, also observations, nodes, subset_observations and subset_nodes, the same in every row. Shares of an
    empty subset are null, and an empty whole has no rows.
    """
    a = with_percentage(category_distribution(whole, fields))
    b = category_distribution(subset, fields).select("category", F.col("n").alias("subset_n"))
    rows = a.join(b, "category", "left").withColumn("subset_n", F.coalesce("subset_n", F.lit(0)))
    total = b.agg(F.sum("subset_n").alias("_total"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("subset_percentage", F.round(F.try_divide(F.lit(100.0) * F.col("subset_n"), F.col("_total")), 6)).drop("_total")
    for df, name in ((whole, ""), (subset, "subset_")) if node else ():
        rows = rows.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(f"{name}observations"), F.count_distinct(node).alias(f"{name}nodes"))))
    return rows


def top_categories(dist: DataFrame, k: int = 12, separate: list[str] | None = None, other: list[str] | None = None) -> DataFrame:
    """(category, n) with at most k categories: separate ones first in key order (k - 1 at most), then the most frequent; the rest is Other.

    The named ones are a top-k of the sums; all others are one sum, so categories are never ranked in one task.
    """
    kept = sorted(separate or [])[: k - 1]
    rows = Scratch(dist.sparkSession, "categories").save(sum_counts(dist, "category"), "sums")
    room = k if not other and rows.count() <= k else k - 1
    asked = F.col("category").isin(kept) if kept else F.lit(False)
    free = rows.where(~F.col("category").isin(other)) if other else rows
    named = free.orderBy(asked.desc(), F.when(asked, F.lit(0)).otherwise(-F.col("n")), "category").limit(room).select("category", "n")
    rest = rows.join(F.broadcast(named.select("category")), "category", "left_anti").agg(F.sum("n").alias("n")).where("n is not null")
    return named.unionByName(rest.select(F.lit(OTHER).alias("category"), "n")).groupBy("category").agg(F.sum("n").alias("n"))


def field_cardinality(cells: DataFrame, approximate: bool = False) -> DataFrame:
    """(key, distinct_values): distinct non-blank values of each field."""
    value = blank_to_null("value")
    return cells.groupBy("key").agg((F.approx_count_distinct(value) if approximate else F.count_distinct(value)).alias("distinct_values"))


def cluster_geometry(clusters: DataFrame, positions: DataFrame) -> DataFrame:
    """(level, cluster_id, representative, members, x, y, radius, bounds): the box of the members, and their largest distance from the representative."""
    rep = positions.select(F.col("node_id").alias("representative"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    rows = clusters.join(positions.select("node_id", "x", "y"), "node_id").join(rep, "representative")
    return rows.groupBy("level", "cluster_id", "representative").agg(
        F.count(F.lit(1)).alias("members"), F.first("rx").alias("x"), F.first("ry").alias("y"), F.max(F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))).alias("radius"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )


def owning_clusters(clusters: DataFrame) -> DataFrame:
    """(node_id, cluster_id): the finest cluster that a node has alone, else the first that holds it."""
    size = clusters.groupBy("level", "cluster_id").agg(F.count(F.lit(1)).alias("m"))
    rows = clusters.join(size, ["level", "cluster_id"])
    return rows.groupBy("node_id").agg(F.min_by("cluster_id", F.struct(F.when(F.col("m") == 1, 0).otherwise(1), F.when(F.col("m") == 1, -F.col("level")).otherwise(F.col("level")), F.col("cluster_id"))).alias("cluster_id"))
