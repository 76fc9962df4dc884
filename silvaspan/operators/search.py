"""Search over ids, annotation values and isolates, through stored lists of three-character pieces.

A text is cut into all its pieces of three characters (the last two are filled up), and the index holds for every piece the texts with it.
A query of three or more characters reads the list of its rarest piece alone, a shorter one those of the pieces that it
begins; what is found is then tested exactly. Ids and values are compared in lower case, isolates by Unicode case folding, so the
two have pieces of their own.

Scores: 100 for an id or isolate equal to the query, 60 for one that starts with it, 40 for one that holds it, 20 for a node's
first value, in the order of its fields, that holds it. Nodes have the first of their best matches: ids before values before isolates,
isolates by id. Generated junctions are found by their isolates only; exported counts are no values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from silvaspan.functions.labels import is_generated_junction
from silvaspan.operators.reads import ordered_slice
from silvaspan.operators.skew import with_place
from silvaspan.scratch import Scratch

#: Parts into which the pieces are dealt; a search reads those of its own pieces. Entries of one part of the texts.
PARTS, ENTRIES = 64, 1 << 20
MOST = 500
_FILL = "￿￿"
_SPACE = " \t\n\x0b\x0c\r"


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def fold_case(c: str | Column) -> Column:
    """Text by Unicode case folding."""
    return _folded(c)


def _pieces(text: Column, last: Column) -> Column:
    filled = F.concat(text, F.lit(_FILL))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(filled, i, F.lit(3))))


def _part(folding: Column, piece: Column) -> Column:
    return F.pmod(F.xxhash64(folding, piece), F.lit(PARTS)).cast("int")


def search_tables(ids: DataFrame, cells: DataFrame, isolates: DataFrame) -> dict[str, DataFrame]:
    """entries (entry, kind, node_id, pos, key, text, folded, part), pieces (piece, folding, entry, part) and sizes (piece, folding, n), to be written as a version's tables.

    ids: (node_id); cells: (node_id, key, value) and optionally pos, the place of the field; isolates: (node_id, isolate_id).
    """
    scratch = Scratch(ids.sparkSession, "search")
    cells = cells if "pos" in cells.columns else cells.withColumn("pos", F.lit(0))
    blank = F.lit("")
    rows = ids.where(~is_generated_junction("node_id")).select(F.lit(0).alias("kind"), "node_id", F.lit(0).alias("pos"), blank.alias("key"), F.col("node_id").alias("text"), F.lower("node_id").alias("folded"))
    kept = cells.where(~is_generated_junction("node_id") & F.col("value").isNotNull() & (F.col("key") != "profile_count") & ~F.startswith("key", F.lit("__category_count__")))
    rows = rows.unionByName(kept.select(F.lit(1).alias("kind"), "node_id", F.col("pos").cast("int").alias("pos"), "key", F.col("value").alias("text"), F.lower("value").alias("folded")))
    rows = rows.unionByName(isolates.where("isolate_id is not null").select(F.lit(2).alias("kind"), "node_id", F.lit(0).alias("pos"), blank.alias("key"), F.col("isolate_id").alias("text"), fold_case("isolate_id").alias("folded")))
    placed = with_place(rows.where("folded <> ''"), ["kind", "node_id", "pos", "key", "text"], "entry", scratch)
    entries = scratch.save(placed.withColumn("part", F.expr(f"entry div {ENTRIES}")), "entries")
    pieces = entries.select(F.explode(_pieces(F.col("folded"), F.length("folded"))).alias("piece"), (F.col("kind") == 2).alias("folding"), "entry")
    pieces = pieces.withColumn("part", _part(F.col("folding"), F.col("piece")))
    return {"entries": entries, "pieces": pieces, "sizes": piece_sizes(pieces)}


def piece_sizes(pieces: DataFrame) -> DataFrame:
    """(piece, folding, n): how many texts hold each piece."""
    return pieces.groupBy("piece", "folding").agg(F.count(F.lit(1)).alias("n"))


def write_search(tables: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Stores the tables, the first two by parts, so that a search reads the parts that it needs; returns the stored ones."""
    spark = tables["entries"].sparkSession
    tables["entries"].write.partitionBy("part").parquet(f"{root}/entries")
    # A piece that most texts hold is spread: ranges are cut by entry too.
    tables["pieces"].repartitionByRange("part", "folding", "piece", "entry").write.partitionBy("part").parquet(f"{root}/pieces")
    stored = {name: spark.read.schema(tables[name].schema).parquet(f"{root}/{name}") for name in ("entries", "pieces")}
    # Counted from the stored pieces, so that no text is cut up once more.
    sizes = piece_sizes(stored["pieces"])
    sizes.write.parquet(f"{root}/sizes")
    return stored | {"sizes": spark.read.schema(sizes.schema).parquet(f"{root}/sizes")}


def search(tables: dict[str, DataFrame], requests: DataFrame, limit: int = 25, owners: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """(request_id, node_id, score, matched, total, and the columns of locations): the best matches of every request (request_id, query, and optionally component).

    total counts all matches, before the limit. owners: (node_id, component), for requests that name a component. locations: (node_id, ...).
    A query without other characters than white space finds nothing.
    """
    spark = requests.sparkSession
    scratch = Scratch(spark, "found")
    asked = requests if "component" in requests.columns else requests.withColumn("component", F.lit(None).cast("string"))
    asked = asked.select("request_id", F.col("component").alias("_component"), F.trim("query", F.lit(_SPACE)).alias("q")).where("q <> ''")
    needles = F.array(F.struct(F.lit(False).alias("folding"), F.lower("q").alias("needle")), F.struct(F.lit(True).alias("folding"), fold_case("q").alias("needle")))
    asked = scratch.save(asked.select("request_id", "_component", F.inline(needles)), "asked")
    sizes = tables["sizes"]
    long = asked.where(F.length("needle") >= 3).withColumn("piece", F.explode(_pieces(F.col("needle"), F.length("needle") - 2)))
    long = long.join(sizes, ["piece", "folding"], "left").groupBy("request_id", "_component", "folding", "needle").agg(F.min_by("piece", F.coalesce("n", F.lit(0))).alias("piece"))
    starts = sizes.select("piece", "folding", F.explode(F.array(F.left("piece", F.lit(1)), F.left("piece", F.lit(2)))).alias("needle"))
    short = asked.where(F.length("needle") < 3).join(starts, ["folding", "needle"]).select("request_id", "_component", "folding", "needle", "piece")
    chosen = scratch.save(long.unionByName(short).withColumn("part", _part(F.col("folding"), F.col("piece"))), "chosen")

    # PARTS numbers at most.
    parts = [r[0] for r in chosen.select("part").distinct().collect()]
    read = tables["pieces"].where(F.col("part").isin(parts)).drop("part")
    some = scratch.save(chosen.drop("part").join(read, ["folding", "piece"]).select("request_id", "_component", "folding", "needle", "entry").distinct(), "some")
    # As many numbers as the texts have parts of ENTRIES.
    parts = [r[0] for r in some.select(F.expr(f"entry div {ENTRIES}")).distinct().collect()]
    hits = some.join(tables["entries"].where(F.col("part").isin(parts)).drop("part"), "entry").where(F.contains("folded", F.col("needle")))
    if owners is not None:
        home = hits.where("_component is not null").join(owners.select("node_id", "component"), "node_id").where("component = _component").drop("component")
        hits = hits.where("_component is null").unionByName(home)
    score = F.when(F.col("kind") == 1, 20).when(F.col("folded") == F.col("needle"), 100).when(F.startswith("folded", F.col("needle")), 60).otherwise(40)
    order = F.struct((-score).alias("s"), "kind", "pos", "key", "text")
    best = hits.groupBy("request_id", "node_id").agg(F.min(order).alias("m"))
    matched = F.when(F.col("m.kind") == 1, F.concat_ws(" ", "node_id", "m.text")).otherwise(F.col("m.text"))
    found = best.select("request_id", "node_id", (-F.col("m.s")).alias("score"), matched.alias("matched"))
    top = ordered_slice(found, ["request_id"], [F.col("score").desc(), F.col("node_id")], min(limit, MOST)).drop("truncated")
    return top if locations is None else top.join(locations, "node_id", "left").select("request_id", "node_id", "score", "matched", "total", *(c for c in locations.columns if c != "node_id"))
