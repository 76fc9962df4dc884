"""Registered queries of composed views, overlays, deltas and reports, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from silvaspan.operators import annotations, bundles, profiles, reads
from silvaspan.plans import inputs
from silvaspan.plans.more import _id, _nation_forest
from silvaspan.plans.registry import _GROUPS, _LOCI, _POS, _SLUG, INDEX, query
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

#: A view of nations with their customers' clusters, the first of which were expanded: base nodes are nations and a proxy for the customers of each; patches hold members, and an
#: edge to the nation that stands for the one to the proxy.
_VIEW = """n AS (SELECT n_nationkey AS k FROM nation), b AS (SELECT 'N' || k AS node_id, NULL AS cluster_id, FALSE AS proxy, 2 * k AS pos FROM n UNION ALL SELECT 'P' || k, 'c' || k, TRUE, 2 * k + 1 FROM n),
    m AS (SELECT 'C' || c_custkey AS node_id, 'c' || c_nationkey AS cluster_id, c_custkey AS pos, c_nationkey AS k, c_nationkey % 4 AS patch FROM customer WHERE c_nationkey % 4 < 2),
    v AS (SELECT b.node_id, b.cluster_id, b.proxy, 0 AS new, 0 AS patch, b.pos FROM b WHERE cluster_id IS NULL OR cluster_id NOT IN (SELECT cluster_id FROM m) UNION ALL SELECT node_id, cluster_id, FALSE, 1, patch, pos FROM m),
    shown AS (SELECT *, (SELECT count(*) FROM v) > 90 AS partial FROM v ORDER BY CASE WHEN node_id = (SELECT max(node_id) FROM m) THEN 0 ELSE 1 END, new, patch, pos, node_id LIMIT 90),
    e AS (SELECT 'base' || k AS edge_id, 'N' || k AS source, 'P' || k AS target FROM n WHERE 'c' || k NOT IN (SELECT cluster_id FROM m) UNION ALL SELECT 'new' || node_id, 'N' || k, node_id FROM m)"""


def _view(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k, none = F.col("n_nationkey"), F.lit(None).cast("string")
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer").where("c_nationkey % 4 < 2")
    base = nation.select(_id("N", "n_nationkey").alias("node_id"), none.alias("cluster_id"), F.lit(False).alias("proxy"), (2 * k).cast("long").alias("pos"))
    base = base.unionByName(nation.select(_id("P", "n_nationkey").alias("node_id"), _id("c", "n_nationkey").alias("cluster_id"), F.lit(True).alias("proxy"), (2 * k + 1).cast("long").alias("pos")))
    links = nation.select(_id("base", "n_nationkey").alias("edge_id"), _id("N", "n_nationkey").alias("source"), _id("P", "n_nationkey").alias("target"))
    patch = (F.col("c_nationkey") % 4).cast("int").alias("patch")
    members = customer.select(_id("C", "c_custkey").alias("node_id"), _id("c", "c_nationkey").alias("cluster_id"), F.lit(False).alias("proxy"), F.col("c_custkey").alias("pos"), patch)
    # A patch also brings the proxies of its neighbours, which are there already.
    members = members.unionByName(nation.where("n_nationkey % 4 = 3").select(_id("P", "n_nationkey").alias("node_id"), _id("c", "n_nationkey").alias("cluster_id"), F.lit(True).alias("proxy"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("patch")))
    inner = customer.select(_id("newC", "c_custkey").alias("edge_id"), _id("N", "c_nationkey").alias("source"), _id("C", "c_custkey").alias("target"), patch, F.lit(False).alias("boundary"))
    met = nation.where("n_nationkey % 4 < 2").select(_id("met", "n_nationkey").alias("edge_id"), _id("P", "n_nationkey").alias("source"), _id("N", "n_nationkey").alias("target"), (k % 4).cast("int").alias("patch"), F.lit(True).alias("boundary"))
    first = customer.agg(F.max(_id("C", "c_custkey"))).first()[0]
    return reads.compose_expansion((base, links), (members, inner.unionByName(met)), 90, first)


@query(f"WITH {_VIEW} SELECT node_id, cluster_id, proxy, partial FROM shown")
def composed_view(spark: SparkSession, sf: str) -> DataFrame:
    """A view of at most 90 nodes after half of its clusters were expanded: members instead of their proxies, one node first."""
    return _view(spark, sf)[0].select("node_id", "cluster_id", "proxy", "partial")


@query(f"WITH {_VIEW} SELECT edge_id, e.source, e.target FROM e JOIN shown s ON s.node_id = e.source JOIN shown t ON t.node_id = e.target")
def composed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of that view: those to expanded proxies went with their boundary edges, and both ends are shown."""
    return _view(spark, sf)[1].select("edge_id", "source", "target")


_LINKS = """c AS (SELECT 'C' || a.c_custkey AS source, 'C' || b.c_custkey AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1), v AS (SELECT DISTINCT node_id FROM hit WHERE NOT (node_id LIKE 'C%' AND CAST(substr(node_id, 2) AS BIGINT) % 13 = 0) AND NOT (node_id LIKE 'C%' AND CAST(substr(node_id, 2) AS BIGINT) % 17 = 0)),
    w AS (SELECT c.* FROM c JOIN t a ON a.node_id = source JOIN t b ON b.node_id = target WHERE a.a0 = b.a0 AND source IN (SELECT node_id FROM v) AND target IN (SELECT node_id FROM v))"""


def _overlay(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customer, number = table(spark, sf, "customer"), F.substring("node_id", 2, 20).try_cast("long")
    links = customer.select(F.col("c_custkey").alias("a")).join(customer.select((F.col("c_custkey") - 1).alias("a"), F.col("c_custkey").alias("b")), "a").select(_id("C", "a").alias("source"), _id("C", "b").alias("target"))
    is_customer = F.startswith("node_id", F.lit("C"))
    seen = reads.points_in_boxes(inputs.requests(spark, sf), inputs.positions(spark, sf)).select("node_id", (is_customer & (number % 13 == 0)).alias("grouped"), (is_customer & (number % 17 == 0)).alias("folded"))
    return links, reads.visible_connections(links, seen, inputs.index(spark, sf))


@query(f"{INDEX}, {_POS}, {_LINKS} SELECT source, target FROM w")
def overlay_in_view(spark: SparkSession, sf: str) -> DataFrame:
    """Links between neighbouring customer keys of one tree with both ends in some box, neither of them a group or a fold."""
    return _overlay(spark, sf)[1]


@query(f"{INDEX}, {_POS}, {_LINKS} SELECT (SELECT count(*) FROM c) AS total, count(*) AS visible FROM w")
def overlay_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many of those links there are and how many are shown."""
    return reads.connection_counts(*_overlay(spark, sf))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'known ' || c_mktsegment ELSE c_mktsegment END AS c_mktsegment FROM customer")
def merged_delta(spark: SparkSession, sf: str) -> DataFrame:
    """What the caller has after a read without the values that it knew: those, and the values that came."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    known = customer.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.concat(F.lit("known "), "c_mktsegment"))
    return reads.merge_delta(reads.delta_annotations(customer, known, "c_custkey"), known, "c_custkey")


@query(f"""WITH n AS (SELECT {_SLUG.format("c_name")} AS node_id FROM customer WHERE c_custkey % 5 <> 0), r AS (SELECT c_custkey AS row_pos, CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_name ELSE c_name END AS join_id FROM customer)
    SELECT 'row without node' AS kind, row_pos, join_id AS subject FROM r WHERE {_SLUG.format("join_id")} NOT IN (SELECT node_id FROM n) UNION ALL SELECT 'node without row', NULL, node_id FROM n WHERE node_id NOT IN (SELECT {_SLUG.format("join_id")} FROM r)""")
def annotation_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of customer names without a node, by number, and nodes without a row."""
    from silvaspan.functions import labels

    customer = table(spark, sf, "customer")
    nodes = customer.where("c_custkey % 5 <> 0").select(labels.slugify("c_name").alias("node_id"))
    ids = customer.select(F.col("c_custkey").alias("row_pos"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), F.col("c_name"))).otherwise(F.col("c_name")).alias("join_id"))
    return annotations.annotation_misses(annotations.join_annotations(ids, nodes), nodes)


@query(f"{_GROUPS} SELECT node_id AS id, array_to_string({_LOCI.replace(_LOCI, 'a')}, chr(9)) AS line FROM g")
def distinct_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One exported line per distinct profile."""
    return profiles.export_profiles(profiles.drop_incomplete_loci(inputs.profiles(spark, sf)), distinct=True)


@query(f"""{INDEX} SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, count(*) FILTER (WHERE parent IS NULL) AS roots, (SELECT count(*) FROM (SELECT 'x' WHERE EXISTS (SELECT 1 FROM t WHERE node_id NOT LIKE 'C%'))) AS warnings, CAST(NULL AS DOUBLE) AS cutoff, 'given' AS strategy FROM t""")
def preparation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a prepared forest."""
    found = _nation_forest(spark, sf)
    return bundles.preparation_summary(found, bundles.prepare(found, inputs.positions(spark, sf))).select("nodes", "edges", "roots", "warnings", "cutoff", "strategy")
