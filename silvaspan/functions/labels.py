"""Column expressions for labels, cells and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: ids that a parser makes up for unnamed inner nodes.
GENERATED = r"^union_[0-9]+(?:_[0-9]+)*$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slugify(c: str | Column) -> Column:
    """Runs of other characters than letters, digits and underscore become one underscore; lower case, no underscore at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(c), "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", ""))


def is_generated_junction(c: str | Column) -> Column:
    return _c(c).rlike(GENERATED)


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit(""))


def is_boolean_literal(c: str | Column) -> Column:
    return F.lower(_c(c)).isin("true", "false")


def is_number_literal(c: str | Column) -> Column:
    """A finite decimal number; one that starts with 0 and a digit is text."""
    c = _c(c)
    shape = c.rlike(r"^[+-]?([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$") & ~c.rlike("^0[0-9]")
    return shape & F.coalesce(F.abs(as_number(c)) < float("inf"), F.lit(False))


def as_number(c: str | Column) -> Column:
    return F.replace(_c(c), F.lit("_"), F.lit("")).try_cast("double")


def value_type(c: str | Column) -> Column:
    """boolean, number, string or null of one cell."""
    c = _c(c)
    return F.when(c.isNull(), "null").when(is_boolean_literal(c), "boolean").when(is_number_literal(c), "number").otherwise("string")


def to_category_text(c: str | Column, kind: str | Column) -> Column:
    """The text under which a cell of a column of this type is counted: True and False, whole numbers without a fraction."""
    c, kind, number = _c(c), _c(kind), as_number(c)
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(kind == "boolean", F.initcap(F.lower(c))).when(kind == "number", F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))).otherwise(c)


def coerce(c: str | Column, kind: str | Column) -> Column:
    """The text of a value under a declared type: true or false, numbers as they are counted, null where it does not fit."""
    c, kind = _c(c), _c(kind)
    fits = F.when(kind == "boolean", is_boolean_literal(c)).when(kind == "number", is_number_literal(c)).otherwise(kind == "string")
    return F.when(fits, F.when(kind == "boolean", F.lower(c)).otherwise(to_category_text(c, kind)))


def percent_encode(c: str | Column) -> Column:
    return F.replace(F.url_encode(_c(c)), F.lit("+"), F.lit("%20"))


def percent_decode(c: str | Column) -> Column:
    return F.url_decode(F.replace(_c(c), F.lit("+"), F.lit("%2B")))


def category_key(field: str | Column, category: str | Column) -> Column:
    """The flat key under which the count of a category is exported."""
    return F.concat(F.lit("__category_count__"), percent_encode(field), F.lit("__value__"), percent_encode(category))


def decode_category_key(c: str | Column) -> tuple[Column, Column]:
    """(field, category) of a flat key; null where it is none."""
    c = _c(c)
    shape = r"^__category_count__(.*?)__value__(.*)$"
    is_key = c.rlike(shape)
    return F.when(is_key, percent_decode(F.regexp_extract(c, shape, 1))), F.when(is_key, percent_decode(F.regexp_extract(c, shape, 2)))


def reject_reserved(df: DataFrame) -> DataFrame:
    """df, or an error if a column bears a reserved name."""
    taken = [c for c in df.columns if c == "profile_count" or c.startswith("__category_count__")]
    if taken:
        raise ValueError(f"reserved column names: {taken}")
    return df


def normalize_distance(c: str | Column) -> tuple[Column, Column]:
    """(distance, fault) of a branch length's text: negative ones are clamped to 0, which is a warning; text that is no finite number is an error."""
    c = _c(c)
    number = F.when(is_number_literal(F.regexp_replace(c, "^0+(?=[0-9])", "")), as_number(c))
    fault = F.when(c.isNull(), F.lit(None).cast("string")).when(number.isNull(), "error: invalid branch length").when(number < 0, "warning: negative branch length")
    return F.greatest(number, F.lit(0.0)), fault


def aggregate_status(status: str | Column) -> Column:
    """The status of a group: pending if empty, failed or degraded if any is, ready if all are, else refining."""
    s = _c(status)
    return F.when(F.count(s) == 0, "pending").when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "degraded"), "degraded").when(F.bool_and(s == "ready"), "ready").otherwise("refining")


def pad_bounds(x0: Column, x1: Column, ratio: float) -> tuple[Column, Column]:
    """Bounds widened by a share of their length on both sides."""
    return x0 - (x1 - x0) * ratio, x1 + (x1 - x0) * ratio


def pad_world(x0: Column, x1: Column, ratio: float, least: float = 1.0) -> tuple[Column, Column]:
    """Bounds of the whole world with a margin of a share of their length, or of ``least`` where they are a point."""
    margin = F.greatest((x1 - x0) * ratio, F.lit(least))
    return x0 - margin, x1 + margin


def centered_bounds(x0: Column, x1: Column, fraction: float) -> tuple[Column, Column]:
    """The middle part of the bounds."""
    return (x0 + x1) / 2 - (x1 - x0) * fraction / 2, (x0 + x1) / 2 + (x1 - x0) * fraction / 2
