"""Annotation tables: cells as rows, type inference, joins to nodes, merging and validation.

Cells are long: (row_pos, join_id, key, value), value trimmed with blanks as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from silvaspan.functions.labels import blank_to_null, is_boolean_literal, is_number_literal, reject_reserved, slugify, to_category_text, value_type


def cells_of(rows: DataFrame, join_column: str, row_pos: str, keys: list[str]) -> DataFrame:
    """One row per cell; rows with a blank join value are skipped."""
    reject_reserved(rows)
    if join_column not in rows.columns:
        raise ValueError(f"no column {join_column}")
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), blank_to_null(F.col(k).cast("string")).alias("value")) for k in keys))
    out = rows.select(F.col(row_pos).alias("row_pos"), blank_to_null(F.col(join_column).cast("string")).alias("join_id"), F.explode(pairs).alias("x"))
    return out.where("join_id is not null").select("row_pos", "join_id", "x.key", "x.value")


def infer_types(cells: DataFrame) -> DataFrame:
    """(key, type): boolean or number if all values are, null if all are blank, else string."""
    v = F.col("value")
    got = cells.groupBy("key").agg(F.count(v).alias("n"), F.bool_and(is_boolean_literal(v)).alias("b"), F.bool_and(is_number_literal(v)).alias("d"))
    return got.select("key", F.when(F.col("n") == 0, "null").when(F.col("b"), "boolean").when(F.col("d"), "number").otherwise("string").alias("type"))


def infer_schema(cells: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(key, type) over single values: null yields to any type, a conflict is string; declared types win."""
    kinds = cells.groupBy("key").agg(F.collect_set(value_type("value")).alias("k")).withColumn("k", F.array_remove("k", "null"))
    found = kinds.select("key", F.when(F.size("k") == 0, "null").when(F.size("k") == 1, F.get("k", F.lit(0))).otherwise("string").alias("type"))
    if declared is None:
        return found
    own = declared.select("key", F.col("type").alias("told"))
    return found.join(own, "key", "full_outer").select("key", F.coalesce("told", "type").alias("type"))


def join_annotations(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row_pos, join_id, node_id): the node of the exact id, else of the slug, else null. nodes are the ids that may be named; repeated ones count once."""
    ids_of = nodes.select("node_id").distinct()
    raw = ids_of.select(F.col("node_id").alias("join_id"), F.col("node_id").alias("by_raw"))
    slug = ids_of.select(F.col("node_id").alias("slug"), F.col("node_id").alias("by_slug"))
    rows = ids.withColumn("slug", slugify("join_id"))
    return rows.join(raw, "join_id", "left").join(slug, "slug", "left").select("row_pos", "join_id", F.coalesce("by_raw", "by_slug").alias("node_id"))


def annotation_warnings(joined: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, n): rows without a node, nodes without a row."""
    lost = joined.where("node_id is null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("row without node").alias("kind"), "n")
    bare = nodes.select("node_id").join(joined.select("node_id"), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return lost.unionByName(bare.select(F.lit("node without row").alias("kind"), "n"))


def annotation_misses(joined: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, row_pos, subject): every row without a node, by its number and id, and every node without a row."""
    lost = joined.where("node_id is null").select(F.lit("row without node").alias("kind"), F.col("row_pos").cast("long").alias("row_pos"), F.col("join_id").alias("subject"))
    bare = nodes.select("node_id").distinct().join(joined.select("node_id"), "node_id", "left_anti")
    return lost.unionByName(bare.select(F.lit("node without row").alias("kind"), F.lit(None).cast("long").alias("row_pos"), F.col("node_id").alias("subject")))


def attach_isolates(members: DataFrame, cells: DataFrame) -> DataFrame:
    """(node_id, isolate_id, data): the map of every isolate, empty without a row; isolates with several rows are listed by ``isolate_faults``."""
    data = cells.where("value is not null").groupBy(F.col("join_id").alias("isolate_norm")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("data"))
    empty = F.create_map().cast("map<string,string>")
    return members.join(data, "isolate_norm", "left").select("node_id", "isolate_id", F.coalesce("data", empty).alias("data"))


def isolate_faults(members: DataFrame, ids: DataFrame) -> DataFrame:
    """(fault, isolate_norm): isolates with several rows, rows of unknown isolates."""
    per = ids.groupBy(F.col("join_id").alias("isolate_norm")).agg(F.count(F.lit(1)).alias("n"))
    twice = per.where("n > 1").select(F.lit("several rows").alias("fault"), "isolate_norm")
    return twice.unionByName(per.join(members, "isolate_norm", "left_anti").select(F.lit("unknown isolate").alias("fault"), "isolate_norm"))


def merge_annotations(direct: DataFrame, table: DataFrame) -> DataFrame:
    """(node_id, key, value): direct values win field by field, a present null too."""
    d = direct.select("node_id", "key", F.col("value").alias("dv"), F.lit(True).alias("has"))
    return table.join(d, ["node_id", "key"], "full_outer").select("node_id", "key", F.when(F.col("has"), F.col("dv")).otherwise(F.col("value")).alias("value"))


def aggregate_rows(cells: DataFrame, types: DataFrame) -> DataFrame:
    """(node_id, key, value, rows, categories) from cells with node_id: distinct texts in first-seen order joined by ``;``, and counts per text."""
    # A row per field. With one field the join loses its key, and rows would meet every part of the types.
    rows = cells.join(F.broadcast(types), "key").where("value is not null").select("node_id", "key", "row_pos", to_category_text("value", "type").alias("text"))
    each = rows.groupBy("node_id", "key", "text").agg(F.min("row_pos").alias("first"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "text", "n")))
    return each.groupBy("node_id", "key").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), ";").alias("value"), F.sum("n").alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("text", "n")))).alias("categories"))


def declared_overrides(cells: DataFrame, types: DataFrame) -> DataFrame:
    """(node_id, key, value): the mean of declared numbers; a declared boolean with conflicting rows is null."""
    rows = cells.join(types.where("type in ('number', 'boolean')"), "key").where("value is not null")
    number = F.avg(F.when(F.col("type") == "number", F.col("value").try_cast("double")))
    low, high = F.min(F.lower("value")), F.max(F.lower("value"))
    return rows.groupBy("node_id", "key", "type").agg(F.when(F.col("type") == "number", number.cast("string")).when(low == high, low).alias("value")).select("node_id", "key", "value")


def validate_annotations(cells: DataFrame, nodes: DataFrame, types: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(violation, subject): unknown nodes, undeclared keys, values of another type, isolates in two nodes, members of unknown nodes, and nodes with an empty membership: a row of members without an isolate."""
    out = cells.join(nodes, "node_id", "left_anti").select(F.lit("unknown node").alias("violation"), F.col("node_id").alias("subject"))
    out = out.unionByName(cells.join(types, "key", "left_anti").select(F.lit("undeclared key").alias("violation"), F.col("key").alias("subject")))
    bad = F.when(F.col("type") == "number", ~is_number_literal("value")).when(F.col("type") == "boolean", ~is_boolean_literal("value")).otherwise(F.lit(False))
    out = out.unionByName(cells.where("value is not null").join(types, "key").where(bad).select(F.lit("type mismatch").alias("violation"), F.concat_ws("/", "node_id", "key").alias("subject")))
    if members is not None:
        twice = members.where("isolate_id is not null").groupBy("isolate_id").agg(F.countDistinct("node_id").alias("n")).where("n > 1")
        out = out.unionByName(twice.select(F.lit("isolate in two nodes").alias("violation"), F.col("isolate_id").alias("subject")))
        subject = F.col("node_id").alias("subject")
        out = out.unionByName(members.where("isolate_id is null").select(F.lit("empty membership").alias("violation"), subject))
        out = out.unionByName(members.join(nodes, "node_id", "left_anti").select(F.lit("membership of unknown node").alias("violation"), subject))
    return out.distinct()


def number_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``k``, counting rows of equal keys from 1."""
    return df.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
