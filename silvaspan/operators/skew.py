"""Joins and orders in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from silvaspan.scratch import Scratch

#: A key with more than one in HEAVY of all rows is heavy, so fewer than HEAVY keys are.
HEAVY = 64
#: Up to this many rows a join is left to Spark: no key of them is too much for one task.
FEW = 1 << 20


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key and in column ``n`` how many of the ``total`` rows of left hold it.

    Heavy keys are fewer than ``HEAVY``, whatever the size of the tables: their rows of right are broadcast,
    and the rows of left that hold them stay where they are. All others meet by a shuffle. left is
    read twice, so it should be a stored table; ``how`` is inner or left; null keys of left find nothing.
    """
    heavy = right.where(F.col(n) * HEAVY > total)
    light = right.where(F.col(n) * HEAVY <= total)
    near = left.join(F.broadcast(heavy), key)
    far = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return near.unionByName(far)


def counted_join(left: DataFrame, right: DataFrame, key: str, scratch: Scratch, total: int, how: str = "inner") -> DataFrame:
    """The same where the rows of each key are still to be counted; right has one row per key. Up to ``FEW`` rows it is a plain join."""
    if total <= FEW:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return spread_join(left, scratch.save(right.join(counts, key), "counted"), key, "_n", total, how).drop("_n")


def with_place(df: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """A stored table of df with ``name``: how many rows stand before each in the order of the columns, which tell rows apart.

    Rows are dealt by ranges and sorted there; what ranges pass on is a count each.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    dealt = scratch.save(dealt, "dealt")
    part = F.shiftright("_m", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # A row for each range: as many as tasks.
    base = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = dealt.withColumn("_part", part).join(F.broadcast(base), "_part")
    return placed.withColumn(name, F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_base")


def with_next(df: DataFrame, key: str, order: str, name: str, scratch: Scratch) -> DataFrame:
    """A stored table of df with ``name``, the value of ``order`` in the next row of the same key, and ``first``: whether none is before.

    A key is cut into the spans of it that stand in one range of (key, order); a span passes on one row, so a key with any number of rows
    is many tasks. (key, order) tells rows apart.
    """
    dealt = scratch.save(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy(key, "_part").orderBy(order)
    rows = scratch.save(dealt.withColumn(name, F.lead(order).over(inside)).withColumn("_k", F.row_number().over(inside)), "inside")
    spans = dealt.groupBy(key, "_part").agg(F.min(order).alias("_from"))
    by = W.partitionBy(key).orderBy("_part")
    spans = spans.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.lead("_from").over(by).alias("_next"), (F.row_number().over(by) == 1).alias("_first"))
    edge = rows.where(F.col(name).isNull() | (F.col("_k") == 1)).join(spans, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p")), "left")
    edge = edge.withColumn(name, F.coalesce(name, "_next")).withColumn("first", (F.col("_k") == 1) & F.col("_first")).select(*df.columns, name, "first")
    return edge.unionByName(rows.where(F.col(name).isNotNull() & (F.col("_k") > 1)).select(*df.columns, name, F.lit(False).alias("first")))
