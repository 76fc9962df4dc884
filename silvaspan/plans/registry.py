"""All registered queries of the library's own operators, each with SQL over the same tables where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from silvaspan.functions import labels
from silvaspan.operators import annotations, components, forest, newick, patristic, profiles, quality, reads, search, stats, summaries, tiers
from silvaspan.plans import inputs
from silvaspan.scratch import Scratch
from silvaspan.sources import versions
from silvaspan.sources.tables import table

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


#: The forest of the tables and its index, in SQL.
EDGES = """edges AS (
    SELECT 'R' || n_regionkey AS source, 'N' || n_nationkey AS target, CAST(1 AS DOUBLE) AS distance FROM nation
    UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, CAST(1 AS DOUBLE) FROM customer
    UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) FROM orders)"""
INDEX = f"""WITH {EDGES},
    t AS (SELECT 'R' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS depth, CAST(0 AS DOUBLE) AS distance, 'R' || r_regionkey AS a0, CAST(NULL AS VARCHAR) AS a1, CAST(NULL AS VARCHAR) AS a2, CAST(NULL AS VARCHAR) AS a3 FROM region
          UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 1, 1, 'R' || n_regionkey, 'N' || n_nationkey, NULL, NULL FROM nation
          UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 2, 1, 'R' || n_regionkey, 'N' || n_nationkey, 'C' || c_custkey, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
          UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 3, CAST(floor(o_totalprice) AS BIGINT) % 100, 'R' || n_regionkey, 'N' || n_nationkey, 'C' || c_custkey, 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    sz AS (SELECT a AS node_id, count(*) AS size FROM (SELECT a0 AS a FROM t UNION ALL SELECT a1 FROM t WHERE depth >= 1 UNION ALL SELECT a2 FROM t WHERE depth >= 2 UNION ALL SELECT a3 FROM t WHERE depth >= 3) GROUP BY a),
    idx AS (SELECT t.*, a0 AS component, row_number() OVER w - 1 AS dfs_start, row_number() OVER w - 1 + size AS dfs_end FROM t JOIN sz USING (node_id) WINDOW w AS (ORDER BY concat_ws(chr(1), a0, a1, a2, a3))),
    cuts AS (SELECT CAST(v AS INTEGER) AS level, CAST(v AS INTEGER) AS cut FROM (VALUES (0), (1), (2)) AS c(v)),
    cl AS (SELECT level, cut, node_id, depth, CASE WHEN depth <= cut THEN node_id WHEN cut = 0 THEN a1 WHEN cut = 1 THEN a2 ELSE a3 END AS representative FROM t, cuts),
    qe AS (SELECT level, parent AS source, node_id AS target, distance FROM t, cuts WHERE depth >= 1 AND depth <= cut + 1)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_order_status(spark, sf_dir)


@query(f"""{INDEX} SELECT 'lod_0_' || representative AS cluster_id, o_orderstatus AS status, count(*) AS n FROM cl JOIN orders ON node_id = 'O' || o_orderkey WHERE level = 0 GROUP BY ALL""")
def cluster_order_status(spark: SparkSession, sf: str) -> DataFrame:
    """Per coarse cluster, the orders of each status below it."""
    status = table(spark, sf, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node_id"), F.col("o_orderstatus").alias("status"))
    rows = inputs.clusters(spark, sf).where("level = 0").join(status, "node_id")
    return summaries.category_distribution(rows, ["status"], "cluster_id").withColumnRenamed("category", "status")


@query(f"{INDEX} SELECT node_id, component, parent, depth, dfs_start, dfs_end FROM idx")
def forest_index(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.index(spark, sf)


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS depth FROM orders WHERE o_orderkey = 0
    UNION ALL SELECT o.o_orderkey, t.depth + 1 FROM t JOIN orders o ON o.o_orderkey > 0 AND (o.o_orderkey - 1) // 2 = t.k) SELECT depth, count(*) AS nodes FROM t GROUP BY depth""")
def heap_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Depth histogram of the balanced tree over the order keys, by pointer jumping."""
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") > 0, F.expr("(o_orderkey - 1) div 2")).alias("parent"))
    return forest.depths_of(parents, Scratch(spark, "heap")).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"{INDEX} SELECT a0 AS component, count(*) AS nodes FROM t GROUP BY a0")
def forest_components(spark: SparkSession, sf: str) -> DataFrame:
    """Component sizes; a component is named by its root here."""
    nodes, edges, roots = inputs.forest(spark, sf)
    comps = forest.components_of(nodes, edges)
    named = comps.join(roots, "node_id").select("component", F.col("node_id").alias("root"))
    return comps.join(named, "component").groupBy(F.col("root").alias("component")).agg(F.count(F.lit(1)).alias("nodes"))


@query("""SELECT error, n FROM (SELECT 'self loop' AS error, (SELECT count(*) FROM nation WHERE n_nationkey = 0) AS n
    UNION ALL SELECT 'unknown endpoint', (SELECT 2 * count(*) FROM nation WHERE n_nationkey = 1)
    UNION ALL SELECT 'duplicate node id', (SELECT count(*) FROM region WHERE r_regionkey = 0)
    UNION ALL SELECT 'cycle', (SELECT count(*) FROM customer WHERE c_custkey % 4 = 1)) WHERE n > 0""")
def forest_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of the forest after a self-loop, an edge between unknown nodes, a repeated node, and edges from regions to a quarter of their customers."""
    nodes, edges, roots = inputs.forest(spark, sf)
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer").where("c_custkey % 4 = 1")
    loop = nation.where("n_nationkey = 0").select(F.lit("loop").alias("edge_id"), F.lit("N0").alias("source"), F.lit("N0").alias("target"), F.lit(1.0).alias("distance"))
    lost = nation.where("n_nationkey = 1").select(F.lit("lost").alias("edge_id"), F.lit("X1").alias("source"), F.lit("X2").alias("target"), F.lit(1.0).alias("distance"))
    again = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("edge_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("target"), F.lit(1.0).alias("distance"))
    return forest.validate_forest(nodes.unionByName(nodes.where("node_id = 'R0'")), edges.unionByName(loop).unionByName(lost).unionByName(again), roots)


@query(f"{INDEX}, h AS (SELECT depth, count(*) AS n FROM t GROUP BY depth) SELECT depth, CAST(sum(n) OVER (ORDER BY depth) + coalesce(lead(n) OVER (ORDER BY depth), 0) AS BIGINT) AS visible FROM h")
def cut_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.cut_sizes(inputs.index(spark, sf))


@query(f"""{INDEX}, h AS (SELECT a0 AS component, depth, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT component, depth, sum(n) OVER w + coalesce(lead(n) OVER w, 0) AS r FROM h WINDOW w AS (PARTITION BY component ORDER BY depth)),
    s0 AS (SELECT component, r AS r0 FROM r WHERE depth = 0), top AS (SELECT component, max(depth) AS d, max(r) AS m FROM r GROUP BY component),
    p1 AS (SELECT component, arg_min(depth, (e, depth)) AS d1, min(e) AS e1, arg_min(r, (e, depth)) AS r1 FROM (SELECT r.*, greatest(r / (2.0 * r0), 2.0 * r0 / r) AS e FROM r JOIN s0 USING (component) WHERE r > r0) GROUP BY component),
    p2 AS (SELECT component, arg_min(depth, (e, depth)) AS d2, arg_min(r, (e, depth)) AS r2 FROM (SELECT r.*, greatest(r / (2.0 * r1), 2.0 * r1 / r) AS e FROM r JOIN p1 USING (component) WHERE r > r1) GROUP BY component),
    p3 AS (SELECT component, arg_min(depth, (e, depth)) AS d3 FROM (SELECT r.*, greatest(r / (2.0 * r2), 2.0 * r2 / r) AS e FROM r JOIN p2 USING (component) WHERE r > r2) GROUP BY component)
    SELECT component, array_to_string(list_append(list_filter([0, d1, d2, d3], lambda x: x IS NOT NULL)[1:-2], d), ',') AS cuts FROM top LEFT JOIN p1 USING (component) LEFT JOIN p2 USING (component) LEFT JOIN p3 USING (component)""")
def tier_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Selected cuts of each component."""
    cuts = tiers.select_cuts(tiers.cut_sizes(inputs.index(spark, sf), "component"), "component")
    return cuts.select("component", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


@query(f"{INDEX} SELECT level, 'lod_' || level || '_' || representative AS cluster_id, count(*) AS members FROM cl GROUP BY ALL")
def tier_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.clusters(spark, sf).groupBy("level", "cluster_id").agg(F.count(F.lit(1)).alias("members"))


@query(f"""{INDEX} SELECT level, source, target, distance FROM qe""")
def quotient_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, _ = inputs.forest(spark, sf)
    return tiers.quotient_edges(inputs.clusters(spark, sf), edges)


@query(f"{INDEX}, g AS (SELECT level, cut, count(DISTINCT representative) AS clusters, count(*) AS members FROM cl GROUP BY ALL) SELECT level, cut, clusters, members, lag(clusters) OVER (ORDER BY level) AS before, clusters / lag(clusters) OVER (ORDER BY level) AS ratio, clusters - lag(clusters) OVER (ORDER BY level) AS jump FROM g")
def tier_growth(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.tier_growth(inputs.clusters(spark, sf))


@query(f"""{INDEX}, s AS (SELECT level, representative, count(*) AS m FROM cl GROUP BY ALL), q AS (SELECT level, count(*) AS edges FROM qe GROUP BY level),
    r AS (SELECT level, count(*) AS nodes, any_value(edges) AS edges, count(*) FILTER (WHERE m > 1) AS proxies, sum(m) AS n, (SELECT count(*) FROM edges) AS e FROM s JOIN q USING (level) GROUP BY level)
    SELECT level, nodes, edges, proxies, round(nodes / n, 6) AS materialization, round(n / nodes, 6) AS node_factor, round(1 - nodes / n, 6) AS node_reduction, round(1 - edges / e, 6) AS edge_reduction, round(1 - (nodes + edges) / (n + e), 6) AS primitive_reduction FROM r""")
def reduction_report(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, _ = inputs.forest(spark, sf)
    clusters = inputs.clusters(spark, sf)
    return tiers.reduction_report(clusters, tiers.quotient_edges(clusters, edges), edges.count())


@query(f"""{INDEX}, ends AS (SELECT c.level, e.source, e.target, c.representative AS a, d.representative AS b FROM edges e JOIN cl c ON c.node_id = e.source JOIN cl d ON d.node_id = e.target AND d.level = c.level),
    per AS (SELECT level, node_id, count(*) AS k FROM cl GROUP BY ALL), m AS (SELECT level, representative, count(*) AS m FROM cl GROUP BY ALL), inn AS (SELECT level, a AS representative, count(*) AS i FROM ends WHERE a = b GROUP BY ALL),
    want AS (SELECT DISTINCT level, a AS source, b AS target FROM ends WHERE a <> b), have AS (SELECT DISTINCT level, source, target FROM qe)
    SELECT level, 'uncovered' AS "check", (SELECT count(*) FROM t) - count(*) AS n FROM per GROUP BY level UNION ALL SELECT level, 'overlapping', count(*) FILTER (WHERE k > 1) FROM per GROUP BY level
    UNION ALL SELECT m.level, 'disconnected', count(*) FILTER (WHERE coalesce(i, 0) <> m - 1) FROM m LEFT JOIN inn ON m.level = inn.level AND m.representative = inn.representative GROUP BY m.level
    UNION ALL SELECT level, 'missing', (SELECT count(*) FROM (SELECT * FROM want WHERE level = cuts.level EXCEPT SELECT * FROM have WHERE level = cuts.level)) FROM cuts
    UNION ALL SELECT level, 'unsupported', (SELECT count(*) FROM (SELECT * FROM have WHERE level = cuts.level EXCEPT SELECT * FROM want WHERE level = cuts.level)) FROM cuts""")
def fidelity_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every check of every tier, without a mismatch."""
    _, edges, _ = inputs.forest(spark, sf)
    index = inputs.paths(spark, sf)
    clusters = tiers.clusters_at(index, inputs.cut_levels(spark))
    return quality.fidelity_ledger(index, edges, clusters, tiers.quotient_edges(clusters, edges))


@query(f"""{INDEX}, c AS (SELECT level, representative, count(*) AS m FROM cl GROUP BY ALL)
    SELECT level, 'uncovered' AS "check", (SELECT count(*) FROM t WHERE node_id LIKE 'O%' AND CAST(substr(node_id, 2) AS BIGINT) % 10 = 0) AS n FROM cuts UNION ALL SELECT level, 'overlapping', (SELECT count(*) FROM nation WHERE n_nationkey % 4 = 1) FROM cuts
    UNION ALL SELECT level, 'unsupported', (SELECT count(*) FROM region) + CASE level WHEN 2 THEN (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) ELSE 0 END FROM cuts UNION ALL SELECT level, 'missing', count(*) FILTER (WHERE target LIKE 'N%' AND CAST(substr(target, 2) AS BIGINT) % 3 = 0) + CASE level WHEN 0 THEN (SELECT count(*) FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey IN (SELECT c_nationkey FROM customer)) ELSE 0 END FROM qe GROUP BY level
    UNION ALL SELECT level, 'unplaced', (SELECT count(*) FROM customer WHERE c_custkey % 6 = 0) FROM cuts UNION ALL SELECT level, 'truncated', count(*) FILTER (WHERE representative LIKE 'R%') FROM c GROUP BY level""")
def fidelity_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What the ledger finds where nodes are lost or in two clusters, edges lost or made up, places missing, and clusters not read."""
    _, edges, _ = inputs.forest(spark, sf)
    scratch = Scratch(spark, "faults")
    index = scratch.save(inputs.paths(spark, sf), "index")
    clusters = scratch.save(tiers.clusters_at(index, inputs.cut_levels(spark)), "clusters")
    number = F.substring("node_id", 2, 20).cast("long")
    lost = F.startswith("node_id", F.lit("O")) & (number % 10 == 0)
    twice = clusters.where(F.startswith("node_id", F.lit("N")) & (number % 4 == 1)).withColumn("cluster_id", F.concat(F.lit("again_"), "cluster_id"))
    quotient = tiers.quotient_edges(clusters, edges)
    made = clusters.where("node_id like 'R%'").select("level", F.lit("nobody").alias("source"), F.col("node_id").alias("target"), F.lit(1.0).alias("distance"))
    quotient = quotient.where(~(F.startswith("target", F.lit("N")) & (F.substring("target", 2, 20).cast("long") % 3 == 0))).unionByName(made, allowMissingColumns=True)
    places = inputs.positions(spark, sf).withColumn("x", F.when(F.startswith("node_id", F.lit("C")) & (number % 6 == 0), F.lit(float("inf"))).otherwise(F.col("x")))
    sizes = clusters.groupBy("level", "cluster_id", "representative").agg(F.count(F.lit(1)).alias("members"))
    damaged = clusters.where(~lost)
    found = quality.fidelity_ledger(index, edges, damaged.unionByName(twice), quotient, places, sizes.where("representative not like 'R%'").select("level", "cluster_id", "members").unionByName(twice.select("level", "cluster_id", F.lit(1).cast("long").alias("members"))))
    return found.where("check in ('uncovered', 'overlapping', 'unsupported', 'missing', 'unplaced', 'truncated')")


@query(f"{INDEX} SELECT node_id, dfs_start AS root_pos FROM idx WHERE parent IS NULL OR distance > 50")
def distance_cut_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Roots after a cut at distance 50."""
    _, edges, _ = inputs.forest(spark, sf)
    return forest.cut_forest(edges, inputs.index(spark, sf), 50.0)[1]


@query(f"""{INDEX}, f AS (SELECT * FROM idx WHERE (node_id LIKE 'N%' AND CAST(substr(node_id, 2) AS BIGINT) % 3 = 0) OR (node_id LIKE 'C%' AND CAST(substr(node_id, 2) AS BIGINT) % 2 = 0)),
    outer_f AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.dfs_start < f.dfs_start AND f.dfs_start < g.dfs_end))
    SELECT o.node_id AS fold, count(i.node_id) AS hidden FROM outer_f o LEFT JOIN idx i ON i.dfs_start > o.dfs_start AND i.dfs_start < o.dfs_end GROUP BY o.node_id""")
def folded_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes hidden by each outer fold, folds being every third nation and every second customer."""
    index = inputs.index(spark, sf)
    number = F.substring("node_id", 2, 20).try_cast("long")
    folds = index.where((F.startswith("node_id", F.lit("N")) & (number % 3 == 0)) | (F.startswith("node_id", F.lit("C")) & (number % 2 == 0)))
    shown = reads.apply_folds(index, folds)
    hidden = shown.where("hidden_by is not null").groupBy(F.col("hidden_by").alias("fold")).agg(F.count(F.lit(1)).alias("hidden"))
    roots = shown.where("hidden is not null").select(F.col("node_id").alias("fold"))
    return roots.join(hidden, "fold", "left").select("fold", F.coalesce("hidden", F.lit(0)).alias("hidden"))


@query("""WITH RECURSIVE e AS (SELECT 'C' || o_custkey AS u, 'O' || o_orderkey AS v FROM orders UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation),
    b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), r AS (SELECT 'R' || r_regionkey AS root, r_regionkey AS pos FROM region WHERE r_regionkey <> (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) UNION ALL SELECT 'N0', n_regionkey FROM nation WHERE n_nationkey = 0),
    t AS (SELECT root AS component, pos, root AS node_id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS depth, [root] AS path FROM r UNION ALL SELECT component, pos, b.v, b.u, t.depth + 1, list_append(path, b.v) FROM t JOIN b ON b.u = t.node_id AND b.v IS DISTINCT FROM t.parent),
    s AS (SELECT a AS node_id, count(*) AS size FROM (SELECT unnest(path) AS a FROM t) GROUP BY a), o AS (SELECT *, row_number() OVER (ORDER BY pos, path) - 1 AS dfs_start FROM t)
    SELECT node_id, component, parent, depth, dfs_start, dfs_start + size AS dfs_end FROM o JOIN s USING (node_id)""")
def rerooted_depths(spark: SparkSession, sf: str) -> DataFrame:
    """The index of the whole forest after the component of nation 0 is hung up at that nation: its intervals are turned, the others stay."""
    index = Scratch(spark, "rerooted").save(inputs.index(spark, sf), "index")
    return forest.rerooted_index(index, "N0").select("node_id", "component", "parent", "depth", "dfs_start", "dfs_end")


@query("SELECT o_custkey AS doc_id, 'C' || o_custkey AS source, 'O' || o_orderkey AS target, CAST(o_orderkey % 10 AS DOUBLE) / 4 AS distance FROM orders")
def newick_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of customers to their orders after they are written as Newick text, one document per customer, and parsed again."""
    leaf = F.concat(F.lit("'o"), F.col("o_orderkey").cast("string"), F.lit("':"), (F.col("o_orderkey") % 10 / 4).cast("string"))
    docs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(leaf)), ",").alias("kids"))
    docs = docs.select("doc_id", F.concat(F.lit("("), "kids", F.lit(")C"), F.col("doc_id").cast("string"), F.lit(" [note; (x)];")).alias("content"))
    return newick.parse_forests(docs)["edges"].select("doc_id", F.upper("source").alias("source"), F.upper("target").alias("target"), "distance")


_SLUG = "lower(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'))"


@query(f"""WITH n AS (SELECT {_SLUG.format("c_name")} AS node_id FROM customer WHERE c_custkey % 5 <> 0), r AS (SELECT c_custkey AS row_pos, CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_name ELSE c_name END AS join_id FROM customer)
    SELECT CASE WHEN node_id IS NULL THEN 'unmatched' ELSE 'matched' END AS state, count(*) AS n FROM r LEFT JOIN n ON {_SLUG.format("join_id")} = node_id GROUP BY ALL
    UNION ALL SELECT 'bare', (SELECT count(*) FROM n WHERE node_id NOT IN (SELECT {_SLUG.format("join_id")} FROM r))""")
def annotation_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names joined to nodes by id or slug, with both kinds of misses."""
    customer = table(spark, sf, "customer")
    nodes = customer.where("c_custkey % 5 <> 0").select(labels.slugify("c_name").alias("node_id"))
    ids = customer.select(F.col("c_custkey").alias("row_pos"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), F.col("c_name"))).otherwise(F.col("c_name")).alias("join_id"))
    got = annotations.join_annotations(ids, nodes)
    state = got.groupBy(F.when(F.col("node_id").isNull(), "unmatched").otherwise("matched").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    bare = annotations.annotation_warnings(got, nodes).where("kind = 'node without row'").select(F.lit("bare").alias("state"), "n")
    return state.unionByName(bare)


def _customer_cells(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").withColumn("flag", F.when(F.col("c_custkey") % 2 == 0, "TRUE").otherwise(F.lit("false"))).withColumn("empty", F.lit(" ")).withColumn("code", F.concat(F.lit("0"), F.col("c_custkey").cast("string")))
    customer = customer.withColumn("node", F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).withColumn("score", F.col("c_custkey") % 4)
    return annotations.cells_of(customer, "node", "c_custkey", ["c_mktsegment", "score", "flag", "empty", "code"])


@query("""WITH c AS (SELECT unnest(['c_mktsegment', 'score', 'flag', 'empty', 'code']) AS key, unnest([c_mktsegment, CAST(c_custkey % 4 AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'false' END, NULL, '0' || c_custkey]) AS v FROM customer)
    SELECT key, CASE WHEN count(v) = 0 THEN 'null' WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'boolean' WHEN bool_and(regexp_full_match(v, '[+-]?[0-9.]+') AND NOT regexp_matches(v, '^0[0-9]')) THEN 'number' ELSE 'string' END AS type FROM c GROUP BY key""")
def annotation_types(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.infer_types(_customer_cells(spark, sf))


@query("""WITH c AS (SELECT 'N' || c_nationkey AS node_id, c_custkey, 'c_mktsegment' AS key, c_mktsegment AS text FROM customer UNION ALL SELECT 'N' || c_nationkey, c_custkey, 'score', CAST(c_custkey % 4 AS VARCHAR) FROM customer
        UNION ALL SELECT 'N' || c_nationkey, c_custkey, 'flag', CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END FROM customer),
    e AS (SELECT node_id, key, text, min(c_custkey) AS first, count(*) AS n FROM c WHERE text IS NOT NULL GROUP BY ALL)
    SELECT node_id, key, string_agg(text, ';' ORDER BY first) AS value, CAST(sum(n) AS BIGINT) AS rows, string_agg(text || '=' || n, ',' ORDER BY text) AS categories FROM e GROUP BY node_id, key""")
def aggregated_annotations(spark: SparkSession, sf: str) -> DataFrame:
    cells = _customer_cells(spark, sf).withColumnRenamed("join_id", "node_id").where("key in ('c_mktsegment', 'score', 'flag')")
    counted = F.transform(F.array_sort(F.map_entries("categories")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return annotations.aggregate_rows(cells, annotations.infer_types(cells)).withColumn("categories", F.array_join(counted, ","))


@query("""SELECT 'N' || c_nationkey AS cluster_id, 'score' AS key, round(avg(c_custkey % 4), 4) AS number, CAST(NULL AS VARCHAR) AS text FROM customer GROUP BY c_nationkey
    UNION ALL SELECT cluster_id, 'c_mktsegment', NULL, text FROM (SELECT 'N' || c_nationkey AS cluster_id, c_mktsegment AS text, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE k = 1""")
def cluster_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score and most frequent segment of the customers of each nation."""
    cells = _customer_cells(spark, sf).where("key in ('c_mktsegment', 'score')").withColumnRenamed("join_id", "cluster_id")
    got = summaries.aggregate_cluster(cells, annotations.infer_types(cells))
    return got.select("cluster_id", "key", F.when(F.col("key") == "score", F.round(F.col("value").try_cast("double"), 4)).alias("number"), F.when(F.col("key") != "score", F.col("value")).alias("text"))


@query("""SELECT 'N' || c_nationkey AS cluster_id, '[{"key":"c_mktsegment","value":"' || c_mktsegment || '"},{"key":"score","value":"' || c_custkey % 4 || '"}]' AS observation,
    count(*) AS n, min(c_custkey) AS reference FROM customer GROUP BY c_nationkey, c_mktsegment, c_custkey % 4""")
def observation_distribution(spark: SparkSession, sf: str) -> DataFrame:
    cells = _customer_cells(spark, sf).where("key in ('c_mktsegment', 'score')").withColumnRenamed("join_id", "cluster_id")
    return summaries.observation_distribution(cells)


@query("""WITH d AS (SELECT coalesce(nullif(trim(CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END), ''), 'Missing') AS category, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS subset_n FROM orders GROUP BY ALL)
    SELECT category, n, subset_n, round(100.0 * n / sum(n) OVER (), 6) AS percentage, round(100.0 * subset_n / sum(subset_n) OVER (), 6) AS subset_percentage, (SELECT count(*) FROM orders) AS observations, (SELECT count(DISTINCT o_custkey) FROM orders) AS nodes,
        (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS subset_observations, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS subset_nodes FROM d""")
def category_report(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority")))
    return summaries.distribution_report(orders, orders.where("o_orderstatus = 'F'"), ["p"], "o_custkey")


@query("""SELECT '["' || CASE WHEN o_orderkey % 9 = 0 THEN 'Missing' ELSE o_orderpriority END || '","' || o_orderstatus || '"]' AS category, count(*) AS n FROM orders GROUP BY ALL""")
def combined_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by priority and status together, in the order of the fields; blanks are Missing."""
    orders = table(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))
    return summaries.category_distribution(orders, ["p", "o_orderstatus"])


@query("""WITH d AS (SELECT p_brand || '/' || p_size % 3 AS category, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS k, count(*) OVER () AS c FROM d)
    SELECT CASE WHEN c > 12 AND k > 11 THEN 'Other' ELSE category END AS category, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("b", F.concat("p_brand", F.lit("/"), (F.col("p_size") % 3).cast("string")))
    return summaries.top_categories(summaries.category_distribution(part, ["b"]))


@query("SELECT 'c_mktsegment' AS key, count(DISTINCT c_mktsegment) AS distinct_values FROM customer UNION ALL SELECT 'score', count(DISTINCT c_custkey % 4) FROM customer UNION ALL SELECT 'flag', count(DISTINCT c_custkey % 2) FROM customer UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'code', count(DISTINCT c_custkey) FROM customer")
def field_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.field_cardinality(_customer_cells(spark, sf))


_LOCI = "[p_brand, p_type, CAST(p_size % 5 + 1 AS VARCHAR), split_part(p_name, ' ', 1), CAST(CAST(floor(p_retailprice) AS BIGINT) % 7 + 1 AS VARCHAR), CAST(p_partkey % 3 + 1 AS VARCHAR)]"
_GROUPS = f"WITH g AS (SELECT {_LOCI} AS a, min('p' || p_partkey) AS node_id, min(p_partkey) AS first_pos, count(*) AS members FROM part GROUP BY ALL)"


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.group_profiles(profiles.drop_incomplete_loci(inputs.profiles(spark, sf)))


@query(f"{_GROUPS} SELECT node_id, first_pos, members, array_to_string(a, '|') AS alleles FROM g")
def profile_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Equal profiles after the incomplete locus is dropped."""
    return _groups(spark, sf).withColumn("alleles", F.array_join("alleles", "|"))


@query(f"""{_GROUPS}, p AS (SELECT x.node_id AS source, y.node_id AS target, list_sum(list_transform(range(1, 7), lambda i: CAST(x.a[i] <> y.a[i] AS INTEGER))) AS distance FROM g x JOIN g y ON x.node_id < y.node_id
        AND (x.a[1] = y.a[1] OR x.a[2] = y.a[2] OR x.a[3] = y.a[3]))
    SELECT source, target, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= 2""")
def allelic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct profiles that differ in at most two loci."""
    return profiles.allelic_pairs(_groups(spark, sf), 2)


@query(f"""{_GROUPS}, p AS (SELECT x.node_id, list_sum(list_transform(range(1, 7), lambda i: CAST(x.a[i] <> y.a[i] AS INTEGER))) AS distance FROM g x JOIN g y ON x.node_id <> y.node_id
        AND (x.a[1] = y.a[1] OR x.a[2] = y.a[2] OR x.a[3] = y.a[3]))
    SELECT node_id, CAST(distance AS INTEGER) AS distance, count(*) AS n FROM p WHERE distance <= 2 GROUP BY ALL""")
def variant_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.lv_counts(profiles.allelic_pairs(_groups(spark, sf), 2))


#: Components of the profiles at each number of differing loci, by passing the least id through groups of equal projections: edges of weight t
#: are the components at t - 1 less those at t.
_PARTS = f"""WITH RECURSIVE {_GROUPS.removeprefix("WITH ")}, masks AS (SELECT m FROM range(1, 64) AS r(m)), keys AS (SELECT 6 - bit_count(m) AS t, node_id, m || '|' || array_to_string(list_transform(range(1, 7), lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN a[i] ELSE '' END), '|') AS k FROM g, masks WHERE m < 63),
    p AS (SELECT 0 AS i, t, node_id, node_id AS c FROM g, (SELECT DISTINCT t FROM keys)
          UNION ALL SELECT i + 1, t, node_id, min(best) FROM (SELECT p.i, p.t, p.node_id, min(p.c) OVER (PARTITION BY p.i, p.t, keys.k) AS best FROM p JOIN keys ON keys.t = p.t AND keys.node_id = p.node_id) WHERE i < 24 GROUP BY i, t, node_id),
    parts AS (SELECT t, count(DISTINCT c) AS parts FROM p WHERE i = 24 GROUP BY t UNION ALL SELECT 0, count(*) FROM g UNION ALL SELECT 6, 1)"""
_WEIGHTS = "SELECT CAST(b.t AS INTEGER) AS distance, a.parts - b.parts AS n FROM parts a JOIN parts b ON b.t = a.t + 1 WHERE a.parts > b.parts"


@query(f"{_PARTS} {_WEIGHTS}")
def spanning_tree_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight histogram of the full spanning tree, which all minimum spanning trees share."""
    return profiles.weight_histogram(profiles.spanning_forest(_groups(spark, sf)))


@query(f"{_PARTS} {_WEIGHTS} AND b.t <= 2")
def bounded_forest_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight histogram of the spanning forest of edges of at most two differing loci."""
    return profiles.weight_histogram(profiles.spanning_forest(_groups(spark, sf), 2))


@query(f"""SELECT 'rows' AS measure, count(*) AS n FROM part UNION ALL SELECT 'loci', 7 UNION ALL SELECT 'kept loci', 6
    UNION ALL SELECT 'distinct profiles', (SELECT count(*) FROM ({_GROUPS} SELECT * FROM g)) UNION ALL SELECT 'pairs at zero', (SELECT CAST(sum(members * (members - 1) // 2) AS BIGINT) FROM ({_GROUPS} SELECT * FROM g))
    UNION ALL SELECT 'id collisions', 0 UNION ALL SELECT 'empty ids', 0""")
def profile_audit(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.audit_profiles(inputs.profiles(spark, sf))


@query("""WITH o AS (SELECT o_custkey, c_nationkey, n_regionkey, 'O' || o_orderkey AS node_id, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS d FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE CAST(floor(o_totalprice) AS BIGINT) % 100 <= 8)
    SELECT x.node_id AS source, y.node_id AS target, x.d + y.d + CASE WHEN x.o_custkey = y.o_custkey THEN 0 WHEN x.c_nationkey = y.c_nationkey THEN 2 ELSE 4 END AS distance FROM o x JOIN o y ON x.n_regionkey = y.n_regionkey AND x.node_id < y.node_id
    WHERE x.d + y.d + CASE WHEN x.o_custkey = y.o_custkey THEN 0 WHEN x.c_nationkey = y.c_nationkey THEN 2 ELSE 4 END <= 8""")
def patristic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of orders whose path, over customers, nations and regions, is at most 8 long."""
    _, edges, _ = inputs.forest(spark, sf)
    return patristic.patristic_pairs(edges, edges.where("target like 'O%'").select(F.col("target").alias("node_id")), 8)


_POS = """p AS (SELECT 'C' || c_custkey AS node_id, CAST(c_custkey % 97 AS DOUBLE) AS x, c_acctbal AS y, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'O' || o_orderkey, CAST(o_orderkey % 89 AS DOUBLE), CAST(CAST(floor(o_totalprice) AS BIGINT) % 9000 AS DOUBLE), o_orderpriority FROM orders
    UNION ALL SELECT 'N' || n_nationkey, n_nationkey * CAST(3.5 AS DOUBLE), n_nationkey * CAST(300 AS DOUBLE), NULL FROM nation UNION ALL SELECT 'R' || r_regionkey, r_regionkey * CAST(20 AS DOUBLE), CAST(5000 AS DOUBLE), NULL FROM region),
    rq AS (SELECT n_nationkey AS request_id, n_nationkey * CAST(3 AS DOUBLE) AS x0, n_nationkey * CAST(3 AS DOUBLE) + 20 AS x1, n_nationkey * CAST(100 AS DOUBLE) AS y0, n_nationkey * CAST(100 AS DOUBLE) + 3000 AS y1 FROM nation),
    hit AS (SELECT rq.request_id, p.* FROM rq JOIN p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"""


_REGION = """s AS (SELECT * FROM h WHERE r <= cap), k AS (SELECT request_id, count(*) AS nodes, max(total) AS total, round(avg(y), 4) AS mean FROM s GROUP BY request_id),
    g AS (SELECT request_id, segment, count(*) AS n FROM s WHERE segment IS NOT NULL GROUP BY ALL), m AS (SELECT request_id, arg_min(segment, (-n, segment)) AS mode, string_agg(segment || '=' || n, ',' ORDER BY segment) AS counts FROM g GROUP BY request_id),
    i AS (SELECT a.request_id, count(*) AS edges FROM edges e JOIN s a ON a.node_id = e.source JOIN s b ON b.node_id = e.target AND b.request_id = a.request_id GROUP BY a.request_id)
    SELECT rq.request_id, coalesce(nodes, 0) AS nodes, coalesce(total, 0) AS total, coalesce(total > nodes, FALSE) AS truncated, coalesce(edges, 0) AS edges, mean, mode, counts FROM rq LEFT JOIN k USING (request_id) LEFT JOIN m USING (request_id) LEFT JOIN i ON i.request_id = rq.request_id"""


def _region(got: DataFrame) -> DataFrame:
    counts = F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return got.withColumn("mean", F.round("mean", 4)).withColumn("counts", F.array_join(counts, ","))


@query(f"WITH {EDGES}, {_POS}, h AS (SELECT *, 1 AS r, 1 AS cap, count(*) OVER (PARTITION BY request_id) AS total FROM hit), {_REGION}")
def region_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes, inner edges, mean, mode and counts of each requested box."""
    _, edges, _ = inputs.forest(spark, sf)
    return _region(reads.read_region(inputs.requests(spark, sf), inputs.positions(spark, sf), edges, "y", "segment"))


@query(f"""{INDEX}, {_POS}, home AS (SELECT hit.*, 30 AS cap FROM hit JOIN t ON t.node_id = hit.node_id WHERE request_id % 2 = 0 OR a0 = 'R' || request_id % 5), h AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY node_id) AS r, count(*) OVER (PARTITION BY request_id) AS total FROM home), {_REGION}""")
def capped_region_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the first 30 nodes of each box, for every second one of one tree only, with totals before the limit."""
    _, edges, _ = inputs.forest(spark, sf)
    asked = inputs.requests(spark, sf).withColumn("component", F.when(F.col("request_id") % 2 == 1, F.concat(F.lit("R"), (F.col("request_id") % 5).cast("string"))))
    return _region(reads.read_region(asked, inputs.positions(spark, sf), edges, "y", "segment", 30, inputs.index(spark, sf)))


_SHOWN = """k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY node_id) AS r, count(*) OVER (PARTITION BY request_id) AS total FROM hit), ins AS (SELECT request_id, node_id, total FROM k WHERE r <= 20),
    near AS (SELECT request_id, target AS node_id FROM ins JOIN edges ON source = node_id UNION SELECT request_id, source FROM ins JOIN edges ON target = node_id),
    beyond AS (SELECT n.request_id, count(*) AS more FROM near n JOIN rq ON rq.request_id = n.request_id JOIN p ON p.node_id = n.node_id WHERE NOT (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) GROUP BY n.request_id),
    shown AS (SELECT ins.request_id, node_id, TRUE AS inside, total + coalesce(more, 0) AS total, total > 20 AS truncated FROM ins LEFT JOIN beyond ON beyond.request_id = ins.request_id UNION ALL SELECT request_id, node_id, FALSE, NULL, NULL FROM near WHERE (request_id, node_id) NOT IN (SELECT (request_id, node_id) FROM ins))"""


@query(f"WITH {EDGES}, {_POS}, {_SHOWN} SELECT * FROM shown")
def viewport_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 nodes in each box, with totals before the cut and beyond the box, and all their neighbours."""
    _, edges, _ = inputs.forest(spark, sf)
    shown, _ = reads.viewport_detail(inputs.requests(spark, sf), inputs.positions(spark, sf), edges, 20)
    return shown.select("request_id", "node_id", "inside", "total", "truncated")


@query(f"WITH {EDGES}, {_POS}, {_SHOWN} SELECT s.request_id, source, target, distance FROM edges JOIN shown s ON s.node_id = source JOIN shown u ON u.node_id = target AND u.request_id = s.request_id WHERE s.inside OR u.inside")
def viewport_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges between the shown nodes of each box that touch a node inside."""
    _, edges, _ = inputs.forest(spark, sf)
    _, links = reads.viewport_detail(inputs.requests(spark, sf), inputs.positions(spark, sf), edges, 20)
    return links.select("request_id", "source", "target", "distance")


#: What each tier shows in each box: clusters that overlap it, and for the finest tier the nodes in it with all their neighbours.
_TIER_COUNTS = f"""{INDEX}, {_POS}, b AS (SELECT level, representative, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM cl JOIN p USING (node_id) GROUP BY ALL),
    near AS (SELECT request_id, node_id FROM hit UNION SELECT request_id, target FROM hit JOIN edges ON source = node_id UNION SELECT request_id, source FROM hit JOIN edges ON target = node_id),
    tc AS (SELECT request_id, cuts.level, (SELECT count(*) FROM b WHERE b.level = cuts.level AND bx0 <= x1 AND bx1 >= x0 AND by0 <= y1 AND by1 >= y0) AS n FROM rq, cuts WHERE cuts.level < 2
        UNION ALL SELECT rq.request_id, 2, count(node_id) FROM rq LEFT JOIN near USING (request_id) GROUP BY rq.request_id)"""


def _tier_counts(spark: SparkSession, sf: str, ceiling: int | None = None, apart: bool = False) -> DataFrame:
    _, edges, _ = inputs.forest(spark, sf)
    positions = inputs.positions(spark, sf)
    boxed = Scratch(spark, "boxed").save(summaries.cluster_geometry(inputs.clusters(spark, sf), positions), "boxed")
    return reads.representation_counts(inputs.requests(spark, sf), boxed, positions, edges, ceiling, apart)


@query(f"""{_TIER_COUNTS} SELECT request_id, CAST(level AS INTEGER) AS level, n FROM tc WHERE level < 2 UNION ALL SELECT request_id, -1, n FROM tc WHERE level = 2
    UNION ALL SELECT request_id, 2, (SELECT count(*) FROM b WHERE b.level = 2 AND bx0 <= x1 AND bx1 >= x0 AND by0 <= y1 AND by1 >= y0) FROM rq""")
def tier_counts_by_box(spark: SparkSession, sf: str) -> DataFrame:
    """How many clusters of each tier each box would show, and as level -1 how many nodes with their neighbours."""
    return _tier_counts(spark, sf, apart=True)


@query(f"{_TIER_COUNTS} SELECT request_id, CAST(level AS INTEGER) AS level, n FROM tc WHERE level <= 1")
def tier_counts_below_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """The same up to tier 1: the finest tier is not counted."""
    return _tier_counts(spark, sf, 1)


@query(f"""{_TIER_COUNTS}, ask AS (SELECT n_nationkey AS request_id, n_nationkey % 3 AS preferred, 30.0 * (1 + n_nationkey % 5) * (SELECT count(*) FROM orders) / 1500 AS target, CASE WHEN n_nationkey % 4 < 3 THEN n_nationkey % 4 END AS previous FROM nation),
    e AS (SELECT tc.request_id, level, preferred, target, previous, n * power(2, greatest(0, level - preferred)) AS cost FROM tc JOIN ask USING (request_id)),
    g AS (SELECT request_id, coalesce(max(level) FILTER (WHERE cost <= target), min(level)) AS chosen, max(level) FILTER (WHERE level = previous AND cost <= 1.15 * target) AS kept, max(level) FILTER (WHERE level > previous AND cost <= 0.85 * target) AS finer FROM e GROUP BY request_id)
    SELECT ask.request_id, CAST(coalesce(CASE WHEN kept IS NULL OR chosen = kept THEN chosen WHEN chosen < kept THEN kept ELSE coalesce(finer, kept) END, preferred) AS INTEGER) AS level FROM ask LEFT JOIN g USING (request_id)""")
def chosen_tiers_by_box(spark: SparkSession, sf: str) -> DataFrame:
    """The tier of each box by what the tiers would show there, a target and a previous tier."""
    k, n = F.col("n_nationkey"), table(spark, sf, "orders").count()
    asked = table(spark, sf, "nation").select(k.alias("request_id"), (k % 3).alias("preferred"), (F.lit(30.0) * (1 + k % 5) * n / 1500).alias("target"), F.when(k % 4 < 3, k % 4).alias("previous"))
    return reads.choose_tier(_tier_counts(spark, sf), asked)


#: Texts that can be found: (kind, node, place of the field, shown text, folded text), as fixed by the requests below.
_TEXTS = """texts AS (SELECT 0 AS kind, 'C' || c_custkey AS node_id, 0 AS pos, 'C' || c_custkey AS text FROM customer UNION ALL SELECT 1, 'C' || c_custkey, 0, c_name FROM customer UNION ALL SELECT 1, 'C' || c_custkey, 1, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0
        UNION ALL SELECT 2, CASE WHEN c_nationkey % 2 = 0 THEN 'union_1_' || c_nationkey ELSE 'N' || c_nationkey END, 0, 'ISO-c' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN 'ß' ELSE '' END FROM customer),
    ask AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS request_id, unnest(['C1', ' u ', 'build', 'iso-C12', 'SS', 'union_1', '  ', 'c11']) AS query, unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'R0']) AS component),
    hits AS (SELECT request_id, texts.*, CASE kind WHEN 1 THEN 20 ELSE CASE WHEN f = q THEN 100 WHEN starts_with(f, q) THEN 60 ELSE 40 END END AS score, component FROM (SELECT *, CASE WHEN kind = 2 THEN replace(lower(text), 'ß', 'ss') ELSE lower(text) END AS f FROM texts) AS texts, (SELECT *, lower(trim(query)) AS q FROM ask) AS ask WHERE q <> '' AND contains(f, q)),
    ranked AS (SELECT request_id, node_id, score, CASE kind WHEN 1 THEN node_id || ' ' || text ELSE text END AS matched, row_number() OVER (PARTITION BY request_id, node_id ORDER BY score DESC, kind, pos, text) AS k FROM hits WHERE component IS NULL OR node_id IN (SELECT node_id FROM t WHERE a0 = component)),
    top AS (SELECT request_id, node_id, score, matched, count(*) OVER (PARTITION BY request_id) AS total, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, node_id) AS r FROM ranked WHERE k = 1)"""


def _search(spark: SparkSession, sf: str) -> DataFrame:
    customer, key = table(spark, sf, "customer"), F.col("c_custkey")
    node = F.concat(F.lit("C"), key.cast("string"))
    cell = lambda pos, name, value: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("key"), value.alias("value"))
    fields = F.array(cell(0, "z", F.col("c_name")), cell(1, "a", F.when(key % 3 != 0, F.col("c_mktsegment"))), cell(2, "profile_count", F.lit("1")))
    cells = customer.select(node.alias("node_id"), F.inline(fields))
    nation = F.col("c_nationkey").cast("string")
    isolates = customer.select(F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("union_1_"), nation)).otherwise(F.concat(F.lit("N"), nation)).alias("node_id"), F.concat(F.lit("ISO-c"), key.cast("string"), F.when(key % 5 == 0, "ß").otherwise("")).alias("isolate_id"))
    ids = customer.select(node.alias("node_id")).unionByName(isolates.where("node_id like 'union%'").select("node_id").distinct())
    tables = search.write_search(search.search_tables(ids, cells, isolates), Scratch(spark, "index").root)
    asked = [(1, "C1", None), (2, " u ", None), (3, "build", None), (4, "iso-C12", None), (5, "SS", None), (6, "union_1", None), (7, "  ", None), (8, "c11", "R0")]
    return search.search(tables, spark.createDataFrame(asked, "request_id int, query string, component string"), 25, inputs.owners(inputs.paths(spark, sf)), inputs.positions(spark, sf))


@query(f"{INDEX}, {_POS}, {_TEXTS} SELECT request_id, top.node_id, score, matched, total, x, y FROM top LEFT JOIN p USING (node_id) WHERE r <= 25 AND request_id NOT IN (2, 3)")
def search_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The best 25 nodes for queries over ids, isolates and values, with their places: a top-k report; one query asks in one tree only."""
    return _search(spark, sf).where("request_id not in (2, 3)").select("request_id", "node_id", "score", "matched", "total", "x", "y")


@query(f"{INDEX}, {_POS}, {_TEXTS} SELECT request_id, node_id, score, matched, total FROM top WHERE r <= 25 AND request_id IN (2, 3)")
def search_values(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 nodes for queries that values hold, of several values of a node the first: a top-k report."""
    return _search(spark, sf).where("request_id in (2, 3)").select("request_id", "node_id", "score", "matched", "total")


@query(f"{INDEX} SELECT component, count(*) AS nodes, min(dfs_start) AS dfs_start FROM idx GROUP BY component HAVING min(dfs_start) > 0 ORDER BY dfs_start LIMIT 3")
def component_page(spark: SparkSession, sf: str) -> DataFrame:
    """Three components behind the first: one page."""
    found = reads.component_boxes(inputs.index(spark, sf), inputs.positions(spark, sf))
    return reads.component_page(found, 0, 3)[0].select("component", "nodes", "dfs_start")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def robust_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.robust_summary(table(spark, sf, "events"), ["event_type"], "value")


@query("SELECT event_type, count(*) AS frames, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max, count(*) FILTER (WHERE value > 16.7) AS over_budget, count(*) FILTER (WHERE value > 33.3) AS over_33, count(*) FILTER (WHERE value > 50) AS over_50, round(count(*) FILTER (WHERE value > 16.7) / count(*), 6) AS share_over FROM events WHERE value >= 0 GROUP BY event_type")
def frame_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.frame_stats(table(spark, sf, "events"), ["event_type"], "value", 16.7)


@query("""WITH e AS (SELECT event_type, value, user_id % 10 = 0 AS w, CASE user_id % 7 WHEN 0 THEN 'failure' WHEN 1 THEN 'timeout' WHEN 2 THEN 'invalid' ELSE 'success' END AS s FROM events)
    SELECT event_type, count(*) FILTER (WHERE w) AS warm_ups, count(*) FILTER (WHERE NOT w) AS measured, count(*) FILTER (WHERE NOT w AND s = 'success') AS successes, count(*) FILTER (WHERE NOT w AND s = 'failure') AS failures, count(*) FILTER (WHERE NOT w AND s = 'timeout') AS timeouts, count(*) FILTER (WHERE NOT w AND s = 'invalid') AS invalid,
        round(quantile_cont(value, 0.5) FILTER (WHERE NOT w AND s = 'success'), 6) AS median, round(quantile_cont(value, 0.25) FILTER (WHERE NOT w AND s = 'success'), 6) AS p25, round(quantile_cont(value, 0.75) FILTER (WHERE NOT w AND s = 'success'), 6) AS p75 FROM e GROUP BY event_type""")
def condition_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.condition_summary(_states(spark, sf), ["event_type"], "w", "s", "value")


def _states(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id") % 7
    return table(spark, sf, "events").withColumn("w", F.col("user_id") % 10 == 0).withColumn("s", F.when(u == 0, "failure").when(u == 1, "timeout").when(u == 2, "invalid").otherwise("success"))


@query("""WITH a AS (SELECT event_type, round(median(value), 6) AS m FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, round(median(value), 6) AS m FROM events WHERE user_id % 2 = 1 GROUP BY 1)
    SELECT coalesce(a.event_type, b.event_type) AS event_type, a.m AS base_median, b.m AS current_median, CASE WHEN a.m > 0 THEN round(b.m / a.m, 6) END AS ratio FROM a FULL JOIN b ON a.event_type = b.event_type""")
def compared_runs(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return stats.compare_runs(stats.stage_summary(events.where("user_id % 2 = 0"), "event_type", "value"), stats.stage_summary(events.where("user_id % 2 = 1"), "event_type", "value"), "event_type")


@query("""WITH p AS (SELECT CASE WHEN o_totalprice <= 0 THEN NULL ELSE round(1 - l / o_totalprice, 6) END AS reduction, round(o_totalprice / l, 6) AS speed_up FROM (SELECT o_totalprice, avg(l_extendedprice) AS l FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice))
    SELECT metric, count(v) AS valid, count(*) FILTER (WHERE v IS NULL) AS invalid, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75
    FROM (SELECT 'reduction' AS metric, reduction AS v FROM p UNION ALL SELECT 'speed_up', speed_up FROM p) GROUP BY metric""")
def paired_summary(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    pairs = orders.join(lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_extendedprice").alias("l")), "o_orderkey")
    return stats.pair_summary(stats.paired_metrics(pairs, "o_totalprice", "l"), ["reduction", "speed_up"])


@query("""WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS found FROM orders GROUP BY ALL), x AS (SELECT DISTINCT a.o_orderstatus, b.o_orderpriority FROM orders a, (SELECT DISTINCT o_orderpriority FROM orders) b)
    SELECT o_orderstatus, o_orderpriority, CAST(100 AS BIGINT) AS expected, coalesce(found, 0) AS found FROM x LEFT JOIN g USING (o_orderstatus, o_orderpriority) WHERE coalesce(found, 0) <> 100""")
def grid_check(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    grid = orders.select("o_orderstatus").distinct().crossJoin(orders.select("o_orderpriority").distinct()).withColumn("expected", F.lit(100).cast("long"))
    return stats.check_grid(orders, grid, ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderpriority AS category, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 GROUP BY 1")
def filtered_annotations(spark: SparkSession, sf: str) -> DataFrame:
    rows = reads.filter_annotations(table(spark, sf, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": []}, {"o_totalprice": (1000.0, 200000.0)})
    return summaries.category_distribution(rows, ["o_orderpriority"])


@query(f"SELECT count(DISTINCT {_SLUG.format('p_name')}) AS slugs, count(*) FILTER (WHERE {_SLUG.format('p_name')} = '') AS empty, count(*) FILTER (WHERE regexp_matches('union_' || p_size || '_' || p_partkey, '^union_[0-9]+(?:_[0-9]+)*$')) AS generated FROM part")
def label_functions(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    slug, made = labels.slugify("p_name"), F.concat_ws("_", F.lit("union"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return part.agg(F.count_distinct(slug).alias("slugs"), F.count_if(slug == "").alias("empty"), F.count_if(labels.is_generated_junction(made)).alias("generated"))


@query("""WITH s AS (SELECT c_nationkey, CASE c_custkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'ready' END AS s FROM customer WHERE c_custkey % 5 <> c_nationkey % 3)
    SELECT c_nationkey, CASE WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'degraded') THEN 'degraded' ELSE 'ready' END AS status FROM s GROUP BY 1""")
def group_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    rows = table(spark, sf, "customer").where("c_custkey % 5 <> c_nationkey % 3").withColumn("s", F.when(k == 0, "failed").when(k == 1, "degraded").otherwise("ready"))
    return rows.groupBy("c_nationkey").agg(labels.aggregate_status("s").alias("status"))


@query("SELECT user_id, max(ts) AS updated, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS layout_version FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events) GROUP BY user_id")
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of each user, read as a manifest of versions."""
    events = table(spark, sf, "events")
    manifest = events.select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("layout_version"), F.lit("ready").alias("status"), F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))
    got = versions.latest_version(manifest).select(F.col("dataset_id").alias("user_id"), F.col("layout_version").cast("string").alias("layout_version"))
    return got.join(events.groupBy("user_id").agg(F.max("ts").alias("updated")), "user_id").select("user_id", "updated", "layout_version")


@query("WITH k AS (SELECT o_custkey AS k, o_custkey - row_number() OVER (ORDER BY o_custkey) AS g FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT min(k) AS lo, count(*) AS n FROM k GROUP BY g")
def customer_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders, linked if their keys are neighbours: the least key and the size of each component."""
    ids = table(spark, sf, "orders").select("o_custkey").distinct()
    near = ids.select(F.col("o_custkey").alias("a")).join(ids.select((F.col("o_custkey") - 1).alias("a"), F.col("o_custkey").alias("b")), "a")
    edges = near.select("a", "b").unionByName(ids.select(F.col("o_custkey").alias("a"), F.col("o_custkey").alias("b")))
    return components.components_of_edges(edges).groupBy(F.col("component").alias("lo")).agg(F.count(F.lit(1)).alias("n"))


def _all() -> dict:
    from silvaspan.plans import more, views  # noqa: F401  register their queries here

    return _FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
