"""Values carried along an order, and running sums, without one task for the whole order.

Rows are cut into spans of an order; inside a span a window does the work, and what a span passes on to the
next is one row per span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from silvaspan.scratch import Scratch

#: Rows of the order in one span.
SPAN = 1 << 16


def carry_last(df: DataFrame, at: str, value: Column, name: str, *keys: str, span: int = SPAN, inclusive: bool = True) -> DataFrame:
    """df with ``name``: the last value that is not null at or before each row (before it, if not inclusive) in the order of the long ``at``.

    The order runs through all of df, or through each group of equal keys.
    """
    return carry_each(df, at, {name: value}, *keys, span=span, inclusive=inclusive)


def carry_each(df: DataFrame, at: str, values: dict[str, Column], *keys: str, span: int = SPAN, inclusive: bool = True) -> DataFrame:
    """df with a column for each of values, carried as ``carry_last`` does, all along one order."""
    rows = df.withColumn("_span", F.expr(f"{at} div {span}")).withColumns({f"_v_{n}": v for n, v in values.items()})
    ends = rows.groupBy(*keys, "_span").agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(at))).alias(f"_end_{n}") for n in values))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_span", *(F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_carried_{n}") for n in values))
    inside = W.partitionBy(*keys, "_span").orderBy(at).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values}).join(carried, [*keys, "_span"], "left")
    return out.withColumns({n: F.coalesce(n, f"_carried_{n}") for n in values}).drop("_span", *(f"{c}_{n}" for n in values for c in ("_v", "_carried")))


def carry_max(df: DataFrame, at: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """df with ``name``: the largest value before each row in the order of the long ``at`` (ties: larger values first); null for the first."""
    rows = df.withColumn("_span", F.expr(f"{at} div {span}"))
    ends = rows.groupBy("_span").agg(F.max(value).alias("_end"))
    carried = ends.select("_span", F.max("_end").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    inside = W.partitionBy("_span").orderBy(at, F.col(value).desc()).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn(name, F.max(value).over(inside)).join(carried, "_span", "left")
    return out.withColumn(name, F.greatest(name, "_carried")).drop("_span", "_carried")


def sum_before(df: DataFrame, order: list[str], value: str, name: str, span: int = SPAN) -> DataFrame:
    """df with ``name``: the sum of the values of all rows before, in the order of the named columns, which tell rows apart."""
    scratch = Scratch(df.sparkSession, "sums")
    rows = scratch.save(df, "rows")
    by = [F.col(c).asc_nulls_last() for c in order]
    n = rows.count()
    if n <= span:
        return rows.withColumn(name, F.coalesce(F.sum(value).over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    dealt = scratch.save(rows.repartitionByRange(n // span + 1, *by).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(base, "_part").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_part", "_base")
