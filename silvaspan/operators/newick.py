"""Newick documents as a distributed job: text to tokens, tokens to nodes and edges, by windows over the tokens of each document.

docs: (doc_id, content). A document may hold several trees, ended by semicolons. Quoted labels, comments
in brackets, branch lengths, labelled inner nodes, trailing commas and empty children are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from silvaspan.functions.labels import normalize_distance, slugify
from silvaspan.scratch import Scratch

#: Characters of documents whose tokens one task sorts; a longer document is one task.
CHARS = 1 << 19
_TOKEN = r"'(?:[^']|'')*'|\[[^\]]*\]|[(),:;]|[^\s'\[\](),:;]+|['\[\]]"


def tokens_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, tok, kind, tree, depth, inside): comments dropped; depth counts open parentheses before a token, inside is 1 + depth for an opening."""
    raw = docs.select("doc_id", F.posexplode(F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0))).alias("pos", "tok"))
    kind = F.when(F.col("tok").isin("(", ")", ",", ":", ";"), F.col("tok")).when(F.col("tok").isin("'", "[", "]"), "?").otherwise("label")
    rows = raw.where("not (tok like '[%' and length(tok) > 1)").withColumn("kind", kind)
    by = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("tree", F.coalesce(F.sum(F.when(F.col("kind") == ";", 1).otherwise(0)).over(by), F.lit(0)))
    step = F.when(F.col("kind") == "(", 1).when(F.col("kind") == ")", -1).otherwise(0)
    in_tree = W.partitionBy("doc_id", "tree").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("depth", F.coalesce(F.sum(step).over(in_tree), F.lit(0)))


def _enclosed(nodes: DataFrame, value: str, name: str) -> DataFrame:
    """nodes with ``name``: the value of the next closing parenthesis that owns a node's depth, the node that encloses it; null at the top."""
    sides = F.array_compact(F.array(F.struct(F.col("at").alias("group"), F.lit(False).alias("close")), F.when(F.col("inner"), F.struct(F.col("owns").alias("group"), F.lit(True).alias("close")))))
    # From the end, so that what encloses a node is carried on and not looked for.
    before = W.partitionBy("doc_id", "tree", "group").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, -1)
    rows = nodes.select("*", F.inline(sides)).withColumn(name, F.last(F.when(F.col("close"), F.col(value)), ignorenulls=True).over(before))
    return rows.where("not close").drop("close", "group")


def parse_forests(docs: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """nodes (doc_id, node_id, label, explicit), edges (doc_id, edge_id, source, target, distance), roots, warnings and errors (doc_id, message).

    Documents with an error give no nodes; with ``strict``, so do documents with anything behind their first tree. A node's parent is the next closing parenthesis of its own
    depth; an inner node is its closing parenthesis.
    """
    scratch = Scratch(docs.sparkSession, "newick")
    docs = scratch.save(docs.select("doc_id", "content"), "docs")
    chars = docs.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    # Dealt by document once for each stored table: every window below is inside a document, so its task sorts the rows of CHARS characters, however many there are.
    deal = lambda df: df.repartition(chars // CHARS + 1, "doc_id")
    by_tree = W.partitionBy("doc_id", "tree").orderBy("pos")
    after = [F.lead(c, k).over(by_tree).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("kind", "tok")]
    toks = scratch.save(tokens_of(deal(docs)).select("*", F.lag("kind").over(by_tree).alias("before"), *after), "tokens")
    # A node starts at a label that follows an opening or a comma (a leaf), at a closing parenthesis (an inner node), or stands empty.
    leaf = (F.col("kind") == "label") & (F.col("before").isNull() | F.col("before").isin("(", ","))
    inner = F.col("kind") == ")"
    bare = (F.col("kind") == ":") & (F.col("before").isNull() | F.col("before").isin("(", ","))
    opening = F.col("kind") == "("
    label = F.when(leaf, F.col("tok")).when(inner & (F.col("kind1") == "label"), F.col("tok1"))
    length = F.when(bare, F.col("tok1")).when(leaf & (F.col("kind1") == ":"), F.coalesce("tok2", F.lit(""))).when(inner & (F.col("kind1") == ":"), F.coalesce("tok2", F.lit(""))).when(inner & (F.col("kind1") == "label") & (F.col("kind2") == ":"), F.coalesce("tok3", F.lit("")))
    own_depth = F.when(inner, F.col("depth") - 1).otherwise(F.col("depth"))
    owns = F.when(inner, F.col("depth")).when(opening, F.col("depth") + 1)
    nodes = deal(toks.where(leaf | inner | bare | opening)).select("doc_id", "tree", "pos", inner.alias("inner"), opening.alias("open"), own_depth.alias("at"), label.alias("label"), length.alias("length"), owns.alias("owns"))
    nodes = nodes.withColumn("label", F.when(F.startswith("label", F.lit("'")), F.replace(F.expr("substring(label, 2, length(label) - 2)"), F.lit("''"), F.lit("'"))).otherwise(F.col("label")))
    # Preorder of an inner node: its opening parenthesis, the last one before it at its depth.
    opened = F.last(F.when(F.col("open"), F.col("pos")), ignorenulls=True).over(W.partitionBy("doc_id", "tree", "owns").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    nodes = nodes.withColumn("first_pos", F.coalesce(F.when(F.col("inner"), opened), F.col("pos"))).where("not open").drop("open")
    placed = _enclosed(nodes, "pos", "parent_pos")
    slug = F.nullif(slugify("label"), F.lit(""))
    pre = F.row_number().over(W.partitionBy("doc_id", "tree").orderBy("first_pos"))
    made = F.sum(F.when(F.col("slug").isNull() & ~F.col("inner"), 1).otherwise(0)).over(W.partitionBy("doc_id", "tree").orderBy("first_pos").rowsBetween(W.unboundedPreceding, 0))
    trees = F.sum(F.when(F.col("pre") == 1, 1).otherwise(0)).over(W.partitionBy("doc_id"))
    named = placed.withColumn("slug", slug).withColumn("pre", pre).withColumn("made", made).withColumn("trees", trees)
    base = F.when(F.col("slug").isNotNull(), F.col("slug")).when(F.col("inner"), F.concat(F.lit("union_"), F.col("pre").cast("string"))).otherwise(F.concat(F.lit("leaf_"), F.col("made").cast("string")))
    base = F.when(F.col("slug").isNull() & (F.col("trees") > 1), F.concat(F.lit("c"), (F.col("tree") + 1).cast("string"), F.lit("_"), base)).otherwise(base)
    named = named.withColumn("base", base).withColumn("k", F.row_number().over(W.partitionBy("doc_id", "base").orderBy("tree", "first_pos")))
    named = named.withColumn("node_id", F.when(F.col("k") > 1, F.concat_ws("_", "base", F.col("k").cast("string"))).otherwise(F.col("base")))
    distance, fault = normalize_distance("length")
    named = named.withColumn("distance", distance).withColumn("fault", F.when(F.col("length") == "", "error: invalid branch length").otherwise(fault))
    named = scratch.save(named, "nodes")

    total = toks.groupBy("doc_id", "tree").agg(F.sum(F.when(F.col("kind") == "(", 1).when(F.col("kind") == ")", -1).otherwise(0)).alias("open"), F.min(F.when(F.col("kind") == ")", F.col("depth"))).alias("low"), F.max(F.col("kind") == "?").alias("odd"), F.max(F.col("kind") != ";").alias("some"))
    errors = total.where("open > 0").select("doc_id", F.lit("Missing ')'").alias("message"))
    errors = errors.unionByName(total.where("open < 0 or low < 1").select("doc_id", F.lit("Unexpected content after tree").alias("message")))
    errors = errors.unionByName(total.where("odd").select("doc_id", F.lit("Unterminated quote or comment").alias("message")))
    last = named.groupBy("doc_id", "tree").agg(F.max("pos").alias("end"), F.count_if(F.col("parent_pos").isNull()).alias("tops"))
    errors = errors.unionByName(last.join(total, ["doc_id", "tree"]).where("tops > 1 and open = 0").select("doc_id", F.lit("Unexpected content after tree").alias("message")))
    stray = toks.where("kind = 'label' and before in (')', 'label')").where("kind1 = 'label' or before = 'label'")
    errors = errors.unionByName(stray.select("doc_id", F.lit("Unexpected content after label").alias("message")))
    errors = errors.unionByName(named.where("fault like 'error%'").select("doc_id", F.lit("Invalid branch length").alias("message")))
    errors = errors.unionByName(docs.join(total.where("some").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("Empty input").alias("message")))
    if strict:
        errors = errors.unionByName(toks.where("tree > 0").select("doc_id", F.lit("Unexpected content after tree").alias("message")))
    errors = scratch.save(errors.distinct(), "errors")
    good = deal(named).join(errors, "doc_id", "left_anti")
    edges = _enclosed(good, "node_id", "source").where("source is not null").select("doc_id", "source", F.col("node_id").alias("target"), "distance")
    edges = edges.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "source", "target").orderBy("distance")))
    edges = edges.select("doc_id", F.concat(F.lit("e_"), F.concat_ws("_", "source", "target", F.col("k").cast("string"))).alias("edge_id"), "source", "target", "distance")
    warnings = good.where("k > 1 and slug is not null").select("doc_id", F.concat(F.lit("Duplicate label "), "base").alias("message"))
    warnings = warnings.unionByName(good.where("fault like 'warning%'").select("doc_id", F.concat(F.lit("Negative branch length at "), "node_id").alias("message")))
    warnings = warnings.unionByName(good.where("trees > 1").groupBy("doc_id").agg(F.max("trees").alias("n")).select("doc_id", F.concat(F.lit("Forest of "), F.col("n").cast("string"), F.lit(" components")).alias("message")))
    nodes = good.select("doc_id", "node_id", "label", F.col("slug").isNotNull().alias("explicit"))
    roots = good.where("parent_pos is null").select("doc_id", "node_id", F.col("tree").alias("root_pos"))
    return {"nodes": nodes, "edges": edges, "roots": roots, "warnings": warnings, "errors": errors}
