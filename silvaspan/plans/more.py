"""Registered queries of sources, bundles, batched reads, quality checks and statistics, with SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from silvaspan.functions import labels
from silvaspan.operators import annotations, bundles, forest, metadata, newick, patristic, profiles, quality, reads, stats, summaries, tiers
from silvaspan.plans import inputs
from silvaspan.plans.registry import _GROUPS, _LOCI, _PARTS, _POS, _SHOWN, EDGES, INDEX, _customer_cells, _groups, _states, query
from silvaspan.scratch import Scratch
from silvaspan.sources import versions
from silvaspan.sources.tables import table


def _id(letter: str, c: str):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


def _seconds(ts: str):
    """Seconds since 1970 of a time without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") / 1e6


# --- sources and sinks -------------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT o_custkey, o_custkey // 8 AS doc_id, dense_rank() OVER (PARTITION BY o_custkey // 8 ORDER BY o_custkey) AS i FROM (SELECT DISTINCT o_custkey FROM orders)), n AS (SELECT doc_id, count(*) AS trees FROM k GROUP BY doc_id),
    c AS (SELECT k.*, trees, CASE WHEN o_custkey % 3 <> 0 THEN 'c' || o_custkey WHEN trees > 1 THEN 'c' || i || '_union_1' ELSE 'union_1' END AS node_id FROM k JOIN n USING (doc_id))
    SELECT doc_id, trees, 'e_' || node_id || '_o' || o_orderkey || '_1' AS edge_id, node_id AS source, 'o' || o_orderkey AS target FROM c JOIN orders USING (o_custkey)""")
def newick_forests(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of documents of up to eight trees, a third of them without a name for the root."""
    root = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise("")
    tree = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(_id("o", "o_orderkey"))), ",").alias("kids"))
    tree = tree.select(F.expr("o_custkey div 8").alias("doc_id"), "o_custkey", F.concat(F.lit("("), "kids", F.lit(")"), root).alias("text"))
    docs = tree.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_custkey", "text"))), lambda x: x["text"]), ";").alias("content"))
    got = newick.parse_forests(docs)
    trees = got["roots"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("trees"))
    return got["edges"].join(trees, "doc_id").select("doc_id", "trees", "edge_id", "source", "target")


@query(f"SELECT 'P' || p_partkey AS isolate_id, array_to_string({_LOCI}, '|') || CASE WHEN p_partkey % 11 = 0 THEN '|0' ELSE '|1' END AS alleles FROM part")
def typing_matrix_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The typing matrix of the parts, written as tab-separated text and read again with all its checks."""
    rows = inputs.profiles(spark, sf)
    path = Scratch(spark, "matrix").path("tsv")
    cells = F.split("line", "\t")
    lines = profiles.export_profiles(rows).select(F.col("id").alias("ID"), *(F.get(cells, F.lit(k)).alias(f"L{k}") for k in range(7)))
    lines.write.option("sep", "\t").option("header", "true").csv(path)
    return versions.read_profiles(spark, path).select("isolate_id", F.array_join("alleles", "|").alias("alleles"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'a "b", c' || c_custkey % 3 AS note FROM customer""")
def annotation_file_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as CSV, its separator found again, quotes and commas in cells."""
    path = Scratch(spark, "report").path("csv")
    note = F.concat(F.lit('a "b", c'), (F.col("c_custkey") % 3).cast("string"))
    versions.write_report(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), note.alias("note")), path)
    return versions.read_annotations(spark, path)


@query(f"WITH {EDGES} SELECT source, target FROM edges")
def edge_list_export(spark: SparkSession, sf: str) -> DataFrame:
    """The edge list of the forest, exported and read again."""
    path = Scratch(spark, "edges").path("csv")
    versions.write_report(inputs.forest(spark, sf)[1].select("source", "target"), path)
    return spark.read.csv(path, header=True)


@query("""WITH e AS (SELECT *, user_id % 7 >= 3 AS good FROM events WHERE user_id % 10 <> 0), c AS (SELECT event_type, count(*) AS "count", count(*) FILTER (WHERE good) AS successes, count(*) FILTER (WHERE NOT good) AS failures FROM e GROUP BY 1),
    m AS (SELECT event_type, unnest(['total_seconds', 'user_bytes']) AS metric, unnest([value, CAST(user_id AS DOUBLE)]) AS value FROM e WHERE good)
    SELECT event_type, any_value("count") AS "count", any_value(successes) AS successes, any_value(failures) AS failures, metric, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, min(value) AS min, max(value) AS max
    FROM m JOIN c USING (event_type) WHERE value IS NOT NULL GROUP BY event_type, metric""")
def observation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log of JSON lines with nested metrics, read again; successes are summarised by every metric that its name tells, beside the counts of all measured rows."""
    path = Scratch(spark, "log").path("json")
    run = F.struct(F.col("event_type").alias("kind"), F.col("s").alias("state"), F.col("w").alias("warm_up"))
    events = _states(spark, sf).select(run.alias("run"), F.struct(F.col("value").alias("total_seconds"), F.col("user_id").alias("user_bytes")).alias("metrics"))
    versions.write_report(events, path, "json")
    log = versions.read_observations(spark, path, "run struct<kind: string, state: string, warm_up: boolean>, metrics struct<total_seconds: double, user_bytes: bigint>")
    return stats.summarize_observations(log.select(F.col("run.kind").alias("event_type"), "run.state", "run.warm_up", "metrics.*"), ["event_type"], state="state", warm_up="warm_up")


@query(f"{INDEX} SELECT node_id, dfs_start, dfs_end FROM idx")
def published_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index as published under its fingerprint and found as the newest version, beside a version that was cleared."""
    root = Scratch(spark, "published").root
    index = Scratch(spark, "index").save(inputs.index(spark, sf), "index")
    one = versions.layout_version({"nodes": index})
    versions.write_version({"nodes": index}, root, "d", one)
    versions.publish(spark, root, "d", one)
    versions.write_version({"nodes": index.where("depth < 2")}, root, "d", "old")
    versions.publish(spark, root, "d", "old")
    versions.clear(spark, root, ["nodes"], "d", "old")
    manifest = spark.read.schema(versions.MANIFEST).parquet(f"{root}/manifest")
    gone = manifest.where("status = 'cleared'").select("layout_version")
    newest = versions.latest_version(manifest.join(gone, "layout_version", "left_anti")).first()["layout_version"]
    return versions.read_geometry(spark, root, "nodes", "d", newest).select("node_id", "dfs_start", "dfs_end")


# --- labels --------------------------------------------------------------------------------------------------------------


@query("""SELECT '__category_count__p%2Fname%20x__value__' || replace(p_name, ' ', '%20') || '%2B' AS key, 'p/name x' AS field, p_name || '+' AS category, count(*) AS n FROM part GROUP BY p_name""")
def category_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of part names under flat keys, and the field and category that each key decodes to."""
    counted = table(spark, sf, "part").groupBy(labels.category_key(F.lit("p/name x"), F.concat("p_name", F.lit("+"))).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    field, category = labels.decode_category_key("key")
    return counted.select("key", field.alias("field"), category.alias("category"), "n")


@query("""SELECT c_nationkey, round(min(c_acctbal) - (max(c_acctbal) - min(c_acctbal)) * 0.1, 4) AS padded, round(max(c_acctbal) + greatest((max(c_acctbal) - min(c_acctbal)) * 0.05, 1), 4) AS world,
    round((min(c_acctbal) + max(c_acctbal)) / 2 - (max(c_acctbal) - min(c_acctbal)) * 0.25, 4) AS middle FROM customer GROUP BY c_nationkey""")
def bounds_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Padded, whole-world and middle bounds of the customers' balances of each nation."""
    got = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"))
    a, b = F.col("a"), F.col("b")
    return got.select("c_nationkey", F.round(labels.pad_bounds(a, b, 0.1)[0], 4).alias("padded"), F.round(labels.pad_world(a, b, 0.05)[1], 4).alias("world"), F.round(labels.centered_bounds(a, b, 0.5)[0], 4).alias("middle"))


@query("""WITH c AS (SELECT unnest(['c_mktsegment', 'score', 'flag', 'empty', 'code']) AS key, unnest([c_mktsegment, CAST(c_custkey % 4 AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'false' END, NULL, '0' || c_custkey]) AS v FROM customer),
    t AS (SELECT key, CASE WHEN v IS NULL THEN 'null' WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(v, '[0-9]+') AND NOT regexp_matches(v, '^0[0-9]') THEN 'number' ELSE 'string' END AS type, CASE key WHEN 'flag' THEN lower(v) WHEN 'score' THEN v WHEN 'c_mktsegment' THEN v END AS coerced FROM c)
    SELECT key, type, count(*) AS n, count(DISTINCT coerced) AS kinds FROM t GROUP BY key, type""")
def value_types(spark: SparkSession, sf: str) -> DataFrame:
    """How many cells of each column are of which type, and how many values they have under a declared one."""
    cells = _customer_cells(spark, sf)
    declared = F.when(F.col("key") == "flag", "boolean").when(F.col("key").isin("score", "code"), "number").when(F.col("key") == "c_mktsegment", "string")
    return cells.withColumn("type", labels.value_type("value")).withColumn("coerced", labels.coerce(F.col("value"), declared)).groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("coerced").alias("kinds"))


# --- annotations -----------------------------------------------------------------------------------------------------------


@query(f"""{_GROUPS}, m AS (SELECT node_id, 'P' || p_partkey AS isolate_id, 'p' || p_partkey AS norm, p_size FROM part JOIN g ON {_LOCI} = a)
    SELECT node_id, isolate_id, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'size=' || p_size END AS data FROM m""")
def isolate_data(spark: SparkSession, sf: str) -> DataFrame:
    """Every part below its profile, with its own data, which a third of the parts lack."""
    kept = profiles.drop_incomplete_loci(inputs.profiles(spark, sf))
    members = profiles.membership(kept, profiles.group_profiles(kept))
    cells = table(spark, sf, "part").where("p_size % 3 <> 0").select(_id("p", "p_partkey").alias("join_id"), F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"))
    got = annotations.attach_isolates(members, cells)
    return got.select("node_id", "isolate_id", F.array_join(F.transform(F.map_entries("data"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("data"))


@query("""SELECT 'C' || c_custkey AS node_id, 'segment' AS key, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey ELSE c_mktsegment END AS value FROM customer
    UNION ALL SELECT 'C' || c_custkey, 'extra', 'y' FROM customer WHERE c_custkey % 5 = 0""")
def merged_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a table under direct ones, which win field by field, with null too."""
    customer = table(spark, sf, "customer").withColumn("node_id", _id("C", "c_custkey"))
    direct = customer.where("c_custkey % 3 = 0").select("node_id", F.lit("segment").alias("key"), F.when(F.col("c_custkey") % 6 != 0, _id("x", "c_custkey")).alias("value"))
    direct = direct.unionByName(customer.where("c_custkey % 5 = 0").select("node_id", F.lit("extra").alias("key"), F.lit("y").alias("value")))
    return annotations.merge_annotations(direct, customer.select("node_id", F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")))


@query("""SELECT 'N' || c_nationkey AS node_id, 'score' AS key, round(avg(c_custkey % 4), 6) AS number, CAST(NULL AS VARCHAR) AS text FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'N' || c_nationkey, 'flag', NULL, CASE WHEN min(c_custkey % 2) = max(c_custkey % 2) THEN CASE WHEN min(c_custkey % 2) = 0 THEN 'true' ELSE 'false' END END FROM customer GROUP BY c_nationkey""")
def declared_values(spark: SparkSession, sf: str) -> DataFrame:
    """Means of declared numbers and agreed declared booleans of each nation's customers."""
    cells = _customer_cells(spark, sf).withColumnRenamed("join_id", "node_id")
    types = spark.createDataFrame([("score", "number"), ("flag", "boolean")], "key string, type string")
    got = annotations.declared_overrides(cells, types)
    return got.select("node_id", "key", F.when(F.col("key") == "score", F.round(F.col("value").try_cast("double"), 6)).alias("number"), F.when(F.col("key") == "flag", F.col("value")).alias("text"))


@query("""WITH c AS (SELECT unnest(['c_mktsegment', 'score', 'flag', 'empty', 'code']) AS key, unnest([c_mktsegment, CAST(c_custkey % 4 AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'false' END, NULL, '0' || c_custkey]) AS v FROM customer),
    t AS (SELECT key, CASE WHEN v IS NULL THEN NULL WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(v, '[0-9]+') AND NOT regexp_matches(v, '^0[0-9]') THEN 'number' ELSE 'string' END AS type FROM c)
    SELECT key, CASE WHEN key = 'score' THEN 'string' WHEN count(DISTINCT type) = 0 THEN 'null' WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'string' END AS type FROM t GROUP BY key""")
def inferred_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Types over single values, with one that is declared."""
    return annotations.infer_schema(_customer_cells(spark, sf), spark.createDataFrame([("score", "string")], "key string, type string"))


@query("""SELECT 'unknown node' AS violation, count(DISTINCT c_custkey) AS n FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'undeclared key', 1
    UNION ALL SELECT 'type mismatch', count(*) FROM customer UNION ALL SELECT 'isolate in two nodes', count(*) FROM (SELECT c_mktsegment FROM customer WHERE c_custkey % 7 <> 3 GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'empty membership', count(*) FROM customer WHERE c_custkey % 7 = 3 UNION ALL SELECT 'membership of unknown node', count(*) FROM customer WHERE c_custkey % 10 = 0""")
def annotation_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of violations among the customers' values: a tenth of unknown nodes, an undeclared key, segments that are no numbers, isolates in several nodes, empty memberships and those of unknown nodes."""
    customer = table(spark, sf, "customer").withColumn("node_id", _id("C", "c_custkey"))
    cells = customer.select("node_id", F.explode(F.array(F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("other").alias("key"), F.lit("1").alias("value")))).alias("x")).select("node_id", "x.*")
    types = spark.createDataFrame([("segment", "number")], "key string, type string")
    members = customer.select("node_id", F.when(F.col("c_custkey") % 7 != 3, F.col("c_mktsegment")).alias("isolate_id"))
    got = annotations.validate_annotations(cells, customer.where("c_custkey % 10 <> 0").select("node_id"), types, members)
    return got.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'p' || p_partkey AS node_id, 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size IS NOT NULL UNION ALL SELECT 'p' || p_partkey, 'brand', p_brand FROM part""")
def direct_records(spark: SparkSession, sf: str) -> DataFrame:
    """Direct records of parts under their original ids, by their normalised ids and declared types."""
    part = table(spark, sf, "part")
    rows = part.select(_id("P", "p_partkey").alias("id"), F.explode(F.array(F.struct(F.lit("size").alias("key"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("value")), F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")))).alias("x")).select("id", "x.*")
    members = part.select(_id("P", "p_partkey").alias("isolate_id"), _id("p", "p_partkey").alias("isolate_norm"))
    return metadata.direct_annotations(rows, members, spark.createDataFrame([("size", "number")], "key string, type string"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders")
def numbered_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each customer numbered from 1."""
    return annotations.number_duplicates(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]).withColumn("k", F.col("k").cast("long"))


# --- observations and metadata -----------------------------------------------------------------------------------------------

_OBS = """obs AS (SELECT 'N' || c_nationkey AS cluster_id, 'C' || c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN 'i:' || c_mktsegment WHEN c_custkey % 3 = 1 THEN 'a:' || c_mktsegment ELSE '{}' END AS data,
    CASE WHEN c_custkey % 3 = 0 THEN 'isolate:I' || c_custkey ELSE 'node:C' || c_custkey END AS reference FROM customer)"""


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").withColumn("node_id", _id("C", "c_custkey"))
    isolates = customer.where("c_custkey % 3 = 0").select("node_id", _id("I", "c_custkey").alias("isolate_id"), F.concat(F.lit("i:"), "c_mktsegment").alias("data"))
    own = customer.where("c_custkey % 3 <> 2").select("node_id", F.concat(F.lit("a:"), "c_mktsegment").alias("data"))
    return metadata.cluster_observations(customer.select(_id("N", "c_nationkey").alias("cluster_id"), "node_id"), isolates, own)


@query(f"""WITH {_OBS}, c AS (SELECT cluster_id, data, count(*) AS n, min(reference) AS reference FROM obs GROUP BY ALL)
    SELECT cluster_id, CASE WHEN NOT starts_with(reference, 'isolate:') THEN data END AS data, n, reference, starts_with(reference, 'isolate:') AS cached FROM c""")
def observed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of each nation's customers counted, without the data of references that the caller knows."""
    rows = Scratch(spark, "observed").save(_observations(spark, sf), "rows")
    return metadata.suppress_known(metadata.observation_counts(rows), rows.where("reference like 'isolate:%'").select("reference"))


@query("""SELECT 'C' || o_custkey AS node_id, count(*) AS kept FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000 GROUP BY o_custkey""")
def filtered_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with an order that matches, and how many of theirs do."""
    orders = table(spark, sf, "orders").withColumn("node_id", _id("C", "o_custkey"))
    kept = metadata.filter_observations(orders, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"o_totalprice": (1000.0, None)})
    nodes = metadata.nodes_with_observations(table(spark, sf, "customer").select(_id("C", "c_custkey").alias("node_id")), kept)
    return kept.join(nodes, "node_id", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"{INDEX}, {_POS} SELECT 'all' AS scope, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p UNION ALL SELECT 'R0', min(x), max(x), min(y), max(y) FROM p JOIN t USING (node_id) WHERE a0 = 'R0'")
def component_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The box of all nodes, and of the tree of region 0."""
    positions, index = inputs.positions(spark, sf), inputs.index(spark, sf)
    return metadata.bounds(positions).withColumn("scope", F.lit("all")).unionByName(metadata.bounds(positions, index, "R0").withColumn("scope", F.lit("R0")))


@query(f"""{INDEX} SELECT level, 'lod_' || level || '_' || representative AS cluster_id, 'price' AS key, round(avg(CAST(floor(o_totalprice) AS BIGINT) % 100), 4) AS number FROM cl JOIN orders ON node_id = 'O' || o_orderkey GROUP BY ALL""")
def cluster_values(spark: SparkSession, sf: str) -> DataFrame:
    """Means over the clusters of all tiers, in one job."""
    cells = table(spark, sf, "orders").select(_id("O", "o_orderkey").alias("node_id"), F.lit("price").alias("key"), (F.floor("o_totalprice") % 100).cast("string").alias("value"))
    got = metadata.cluster_annotations(inputs.clusters(spark, sf), cells, spark.createDataFrame([("price", "number")], "key string, type string"))
    return got.select("level", "cluster_id", "key", F.round(F.col("value").try_cast("double"), 4).alias("number"))


@query(f"""{INDEX}, m AS (SELECT representative, count(*) AS members FROM cl WHERE level = 1 GROUP BY representative), v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT m.representative AS node_id, members, CASE WHEN members > 1 THEN 'cluster' WHEN starts_with(m.representative, 'C') THEN 'own' END AS data, CASE WHEN members = 1 AND starts_with(m.representative, 'C') THEN 1 ELSE 0 END AS isolates,
        CASE WHEN members > 1 THEN 1 ELSE 0 END AS kinds, a0 AS component, parent, depth, dfs_start, dfs_end FROM m JOIN idx ON idx.node_id = m.representative""")
def attached_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What the middle tier shows, with data, isolates, distribution and tree interval attached."""
    index = Scratch(spark, "attached").save(inputs.index(spark, sf), "index")
    clusters = tiers.clusters_at(index, inputs.cut_levels(spark)).where("level = 1")
    nodes = clusters.groupBy("cluster_id", F.col("representative").alias("node_id")).agg(F.count(F.lit(1)).alias("members")).withColumn("is_representative", F.col("members") > 1)
    customer = index.where("node_id like 'C%'").select("node_id")
    counts = nodes.where("is_representative").select("cluster_id", F.lit("d").alias("data"), F.lit(1).alias("n"), F.lit("r").alias("reference"))
    got = metadata.attach_metadata(nodes, customer.withColumn("data", F.lit("own")), nodes.select("cluster_id", F.lit("cluster").alias("data")), customer.select("node_id", F.lit("i").alias("isolate_id"), F.lit("x").alias("data")), counts, index)
    return got.select("node_id", "members", "data", F.size("isolates").alias("isolates"), F.size("distribution").alias("kinds"), "component", "parent", "depth", "dfs_start", "dfs_end")


@query(f"""{INDEX}, m AS (SELECT level, representative, count(*) AS m FROM cl GROUP BY ALL), r AS (SELECT node_id, level, representative, m FROM cl JOIN m USING (level, representative))
    SELECT node_id, 'lod_' || arg_min(level || '_' || representative, (CASE WHEN m = 1 THEN 0 ELSE 1 END, CASE WHEN m = 1 THEN -level ELSE level END)) AS cluster_id FROM r GROUP BY node_id""")
def owning_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.owning_clusters(inputs.clusters(spark, sf))


# --- reads ------------------------------------------------------------------------------------------------------------------


@query(f"""{INDEX}, {_POS}, k AS (SELECT node_id, x, row_number() OVER (ORDER BY CASE WHEN node_id = 'N3' THEN 0 ELSE 1 END, node_id) AS r, count(*) OVER () AS total FROM p JOIN t USING (node_id) WHERE a0 = (SELECT a0 FROM t WHERE node_id = 'N3'))
    SELECT node_id, x, total, total > 40 AS truncated FROM k WHERE r <= 40""")
def scoped_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The first 40 nodes of the tree of nation 3, that nation first: the component is asked for before the limit."""
    index = Scratch(spark, "scoped").save(inputs.index(spark, sf), "index")
    component = index.where("node_id = 'N3'").first()["component"]
    rows = reads.scope(inputs.positions(spark, sf), index, component).withColumn("one", F.lit(1))
    return reads.ordered_slice(rows, ["one"], reads.focus_first("N3"), 40).select("node_id", "x", "total", "truncated")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment, c_custkey % 4 = 0 AS cached FROM customer")
def delta_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, those that the caller knows without their values."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return reads.delta_annotations(customer, customer.where("c_custkey % 4 = 0"), "c_custkey")


@query(f"""WITH {EDGES}, {_POS}, a AS (SELECT request_id, source, target FROM hit JOIN edges ON source = node_id), b AS (SELECT request_id, source, target FROM hit JOIN edges ON target = node_id),
    near AS (SELECT request_id, target AS node_id FROM a UNION SELECT request_id, source FROM b EXCEPT SELECT request_id, node_id FROM hit)
    SELECT request_id, 'touching' AS measure, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY request_id
    UNION ALL SELECT request_id, 'inner', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY request_id UNION ALL SELECT request_id, 'one hop', count(*) FROM near GROUP BY request_id""")
def touching_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with an end and with both ends in each box, and the neighbours outside."""
    scratch = Scratch(spark, "touching")
    _, edges, _ = inputs.forest(spark, sf)
    positions = inputs.positions(spark, sf)
    ids = scratch.save(reads.points_in_boxes(inputs.requests(spark, sf), positions).select("request_id", "node_id"), "ids")
    out = None
    for name, df in (("touching", reads.touching_edges(edges, ids)), ("inner", reads.internal_edges(edges, ids)), ("one hop", reads.one_hop(edges, ids, positions))):
        row = df.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).select("request_id", F.lit(name).alias("measure"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _asked_clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(owners, clusters of the middle tier, requests for those of several members with their largest id as focus)."""
    paths = inputs.paths(spark, sf)
    clusters = Scratch(spark, "asked").save(tiers.clusters_at(paths, inputs.cut_levels(spark)).where("level = 1"), "clusters")
    asked = clusters.groupBy("cluster_id").agg(F.max("node_id").alias("focus"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("cluster_id").alias("request_id"), "cluster_id", "focus")
    return inputs.owners(paths), clusters, asked


@query(f"""{INDEX}, {_POS}, c AS (SELECT 'lod_1_' || representative AS request_id, node_id, max(node_id) OVER w AS focus, count(*) OVER w AS total FROM cl WHERE level = 1 WINDOW w AS (PARTITION BY representative)),
    k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN node_id = focus THEN 0 ELSE 1 END, node_id) AS r FROM c WHERE total > 1) SELECT request_id, node_id, total, total > 3 AS truncated FROM k WHERE r <= 3""")
def expanded_members(spark: SparkSession, sf: str) -> DataFrame:
    """The first three members of every cluster of the middle tier, its focus first."""
    owners, clusters, asked = _asked_clusters(spark, sf)
    _, edges, _ = inputs.forest(spark, sf)
    homes = clusters.select("cluster_id", F.col("representative").alias("node_id")).distinct().join(owners.select("node_id", "component"), "node_id").select("cluster_id", "component")
    asked = reads.clusters_of_component(asked.join(homes, "cluster_id"), clusters, owners)
    shown, _, _ = reads.viewport_expand(asked, clusters, inputs.positions(spark, sf), edges, 3)
    return shown.select("request_id", "node_id", "total", "truncated")


@query(f"""{INDEX}, c AS (SELECT representative, count(*) AS m FROM cl WHERE level = 1 GROUP BY 1) SELECT 'lod_1_' || representative AS request_id, representative AS "inner", parent AS "outer", parent AS outer_representative, distance FROM c JOIN t ON node_id = representative WHERE m > 1""")
def cluster_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """The one edge to the outside of every cluster of the middle tier, and who stands for its other end there."""
    _, clusters, asked = _asked_clusters(spark, sf)
    _, edges, _ = inputs.forest(spark, sf)
    found = Scratch(spark, "boundaries").save(reads.expansion_boundary(asked, clusters, edges), "found")
    if reads.boundary_faults(asked, clusters, edges, found).limit(1).count():
        raise ValueError("a cluster has not exactly one edge to the outside")
    return found


@query(f"""{INDEX}, {_POS}, b AS (SELECT level, representative, count(*) AS members, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM cl JOIN p USING (node_id) WHERE level = 1 GROUP BY ALL),
    k AS (SELECT request_id, representative, members, row_number() OVER (PARTITION BY request_id ORDER BY members DESC, 'lod_1_' || representative) AS r, count(*) OVER (PARTITION BY request_id) AS total FROM rq JOIN b ON bx0 <= x1 AND bx1 >= x0 AND by0 <= y1 AND by1 >= y0)
    SELECT request_id, representative, members, total FROM k WHERE r <= 30""")
def coarse_viewports(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 largest clusters of the middle tier that overlap each box, with totals before the cut."""
    _, edges, _ = inputs.forest(spark, sf)
    clusters = Scratch(spark, "coarse").save(inputs.clusters(spark, sf), "clusters")
    boxed = summaries.cluster_geometry(clusters, inputs.positions(spark, sf))
    shown, _ = reads.viewport_coarse(inputs.requests(spark, sf).withColumn("level", F.lit(1)), boxed, tiers.quotient_edges(clusters, edges), 30)
    return shown.select("request_id", "representative", "members", "total")


@query(f"""{INDEX}, {_POS}, b AS (SELECT level, representative, count(*) AS members, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM cl JOIN p USING (node_id) WHERE level = 0 GROUP BY ALL),
    k AS (SELECT request_id, representative, row_number() OVER (PARTITION BY request_id ORDER BY members DESC, 'lod_0_' || representative) AS r FROM rq JOIN b ON bx0 <= x1 AND bx1 >= x0 AND by0 <= y1 AND by1 >= y0), s AS (SELECT * FROM k WHERE r <= 30)
    SELECT u.request_id, qe.source, qe.target, distance FROM qe JOIN s u ON u.representative = qe.source JOIN s v ON v.representative = qe.target AND v.request_id = u.request_id WHERE level = 0""")
def coarse_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The quotient edges between the clusters of the coarsest tier that each box shows."""
    _, edges, _ = inputs.forest(spark, sf)
    # All boxes ask for the coarsest tier, so no other one is made.
    clusters = Scratch(spark, "coarse").save(tiers.clusters_at(inputs.paths(spark, sf), inputs.cut_levels(spark).where("level = 0")), "clusters")
    boxed = summaries.cluster_geometry(clusters, inputs.positions(spark, sf))
    _, links = reads.viewport_coarse(inputs.requests(spark, sf).withColumn("level", F.lit(0)), boxed, tiers.quotient_edges(clusters, edges), 30)
    return links.select("request_id", "source", "target", "distance")


@query(f"""{INDEX}, {_POS}, c AS (SELECT 'lod_1_' || representative AS request_id, node_id, max(node_id) OVER w AS focus, count(*) OVER w AS total FROM cl WHERE level = 1 WINDOW w AS (PARTITION BY representative)),
    k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN node_id = focus THEN 0 ELSE 1 END, node_id) AS r FROM c WHERE total > 1), s AS (SELECT * FROM k WHERE r <= 3)
    SELECT u.request_id, 'inner' AS kind, source, target, distance FROM edges JOIN s u ON u.node_id = source JOIN s v ON v.node_id = target AND v.request_id = u.request_id
    UNION ALL SELECT s.request_id, 'boundary', s.node_id, parent, distance FROM s JOIN t USING (node_id) WHERE s.request_id = 'lod_1_' || s.node_id""")
def expanded_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges between the members that expanded_members shows, and those to the outside whose inner end is shown."""
    _, clusters, asked = _asked_clusters(spark, sf)
    _, edges, _ = inputs.forest(spark, sf)
    _, inner, out = reads.viewport_expand(asked, clusters, inputs.positions(spark, sf), edges, 3)
    inner = inner.select("request_id", F.lit("inner").alias("kind"), "source", "target", "distance")
    return inner.unionByName(out.select("request_id", F.lit("boundary").alias("kind"), F.col("inner").alias("source"), F.col("outer_representative").alias("target"), "distance"))


@query("""WITH c AS (SELECT c_nationkey AS request_id, c_custkey % 4 AS level, count(*) * (1 + c_custkey % 4) AS n FROM customer GROUP BY 1, 2, c_custkey % 4), rq AS (SELECT n_nationkey AS request_id, n_nationkey % 3 AS preferred, (SELECT count(*) FROM customer) / 50.0 AS target, CASE WHEN n_nationkey % 4 < 3 THEN n_nationkey % 4 END AS previous FROM nation),
    e AS (SELECT c.request_id, level, preferred, target, previous, n * power(2, greatest(0, level - preferred)) AS cost FROM c JOIN rq USING (request_id)),
    g AS (SELECT request_id, coalesce(max(level) FILTER (WHERE cost <= target), min(level)) AS chosen, max(level) FILTER (WHERE level = previous AND cost <= 1.15 * target) AS kept, max(level) FILTER (WHERE level > previous AND cost <= 0.85 * target) AS finer FROM e GROUP BY request_id)
    SELECT rq.request_id, CAST(coalesce(CASE WHEN kept IS NULL OR chosen = kept THEN chosen WHEN chosen < kept THEN kept ELSE coalesce(finer, kept) END, preferred) AS INTEGER) AS level FROM rq LEFT JOIN g USING (request_id)""")
def chosen_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """A tier for every nation from counts of its customers, a target and a previous tier."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("request_id"), (F.col("c_custkey") % 4).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("m")).withColumn("n", F.col("m") * (1 + F.col("level")))
    n = table(spark, sf, "customer").count()
    k = F.col("n_nationkey")
    asked = table(spark, sf, "nation").select(k.alias("request_id"), (k % 3).alias("preferred"), F.lit(n / 50.0).alias("target"), F.when(k % 4 < 3, k % 4).alias("previous"))
    return reads.choose_tier(counts, asked)


@query(f"""{INDEX}, f AS (SELECT * FROM idx WHERE depth = 1 OR (depth = 2 AND CAST(substr(node_id, 2) AS BIGINT) % 2 = 0)), s AS (SELECT component, dfs_start FROM idx WHERE node_id = (SELECT min('O' || o_orderkey) FROM orders))
    SELECT node_id FROM f WHERE dfs_end - dfs_start > 1 AND NOT EXISTS (SELECT 1 FROM s WHERE f.dfs_start < s.dfs_start AND s.dfs_start < f.dfs_end) AND node_id <> 'N3' UNION SELECT node_id FROM idx WHERE depth = 0 AND dfs_end - dfs_start > 1 AND component NOT IN (SELECT component FROM s)""")
def revealed_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folds of roots, nations and every second customer after one is unfolded and those that hide an order are taken away."""
    index = Scratch(spark, "revealed").save(inputs.index(spark, sf), "index")
    number = F.substring("node_id", 2, 20).try_cast("long")
    folds = index.where("dfs_end - dfs_start > 1").where((F.col("depth") == 1) | ((F.col("depth") == 2) & (number % 2 == 0))).select("component", "node_id", "dfs_start", "dfs_end")
    folds = reads.collapse(reads.unfold(reads.collapse_roots(folds, index), "N3"), index, "N4")
    target = table(spark, sf, "orders").agg(F.min(_id("O", "o_orderkey"))).first()[0]
    return reads.reveal(folds, index, target).select("node_id")


@query(f"""WITH {_POS}, v AS (SELECT DISTINCT node_id FROM hit), c AS (SELECT 'C' || a.c_custkey AS source, 'C' || b.c_custkey AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1)
    SELECT source, target FROM c WHERE source IN (SELECT node_id FROM v) AND target IN (SELECT node_id FROM v)""")
def visible_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Links between neighbouring customer keys with both ends in some box."""
    customer = table(spark, sf, "customer")
    links = customer.select(F.col("c_custkey").alias("a")).join(customer.select((F.col("c_custkey") - 1).alias("a"), F.col("c_custkey").alias("b")), "a").select(_id("C", "a").alias("source"), _id("C", "b").alias("target"))
    return reads.visible_connections(links, reads.points_in_boxes(inputs.requests(spark, sf), inputs.positions(spark, sf)))


@query("""WITH o AS (SELECT o_custkey, 'O' || o_orderkey AS node_id, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS d FROM orders)
    SELECT 'distance:' || x.node_id || ':' || y.node_id AS id, x.node_id AS source, y.node_id AS target, x.d + y.d AS distance FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.node_id < y.node_id WHERE x.d + y.d <= 1.5""")
def path_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and orders within a path of 1.5 that no edge of the tree joins."""
    _, edges, _ = inputs.forest(spark, sf)
    named = edges.where("target like 'O%' or target like 'C%'").select(F.col("target").alias("node_id"))
    return patristic.overlay_paths(edges, inputs.owners(inputs.paths(spark, sf)), named, 1.5)


@query(f"{INDEX}, m AS (SELECT level, 'lod_' || level || '_' || representative AS cluster_id, count(*) AS members FROM cl GROUP BY ALL) (SELECT 'middle' AS rule, cluster_id, members FROM m ORDER BY abs(ln(members / 5.0)), level, cluster_id LIMIT 1) UNION ALL (SELECT 'smallest', cluster_id, members FROM m ORDER BY cluster_id LIMIT 1) UNION ALL SELECT 'exact', cluster_id, members FROM m WHERE cluster_id = 'lod_0_N3'")
def target_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster nearest to a size of 5, that of the smallest id, and a named one."""
    sizes = Scratch(spark, "target").save(inputs.clusters(spark, sf).groupBy("level", "cluster_id").agg(F.count(F.lit(1)).alias("members")), "sizes")
    out = None
    for rule, df in (("middle", reads.select_target(sizes, 5.0)), ("smallest", reads.select_target(sizes)), ("exact", reads.select_target(sizes, cluster_id="lod_0_N3"))):
        row = df.select(F.lit(rule).alias("rule"), "cluster_id", "members")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT n_nationkey, n_name FROM nation")
def budgeted_read(spark: SparkSession, sf: str) -> DataFrame:
    """All nations, under a budget that would be an error if they were more, and equal to the nations of a second read."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    reads.require_same_ids(nation, table(spark, sf, "nation"), "n_nationkey")
    return reads.require_at_most(nation, 1000)


# --- tiers, profiles, quality ------------------------------------------------------------------------------------------------


@query(f"{INDEX}, n AS (SELECT a0, count(*) AS n FROM t GROUP BY a0) SELECT CASE WHEN n <= (SELECT CAST(avg(n) AS BIGINT) FROM n) THEN 0 ELSE depth END AS depth, count(*) AS nodes FROM t JOIN n USING (a0) GROUP BY 1")
def presentation_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Depths as tiers see them, where trees of at most the mean size are never folded."""
    index = Scratch(spark, "depths").save(inputs.index(spark, sf), "index")
    mean = index.count() / index.where("parent is null").count()
    return tiers.presentation_depths(index, int(mean + 0.5)).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""{INDEX}, k AS (SELECT level, node_id, count(*) AS n FROM cl GROUP BY ALL) SELECT 'partition' AS "check", count(*) FILTER (WHERE n <> 1) AS n FROM k
    UNION ALL SELECT 'refinement', count(*) FROM (SELECT f.level, f.representative FROM cl f JOIN cl c ON c.level = f.level - 1 AND c.node_id = f.node_id GROUP BY ALL HAVING count(DISTINCT c.representative) > 1)
    UNION ALL SELECT 'representative depth', count(*) FROM cl JOIN t ON t.node_id = cl.representative WHERE cl.node_id <> cl.representative AND t.depth <> cut + 1
    UNION ALL SELECT 'quotient', count(*) FROM (SELECT level, least(source, target), greatest(source, target) FROM qe GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'unplaced', count(*) FROM cl WHERE representative IS NULL""")
def tier_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Partition, refinement, representatives, quotient edges and placement of all tiers: no fault."""
    _, edges, _ = inputs.forest(spark, sf)
    index = Scratch(spark, "checks").save(inputs.paths(spark, sf), "index")
    clusters = Scratch(spark, "checks").save(tiers.clusters_at(index, inputs.cut_levels(spark)), "clusters")
    quotient = tiers.quotient_faults(tiers.quotient_edges(clusters, edges), clusters).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("quotient").alias("check"), "n")
    lost = quality.placement_faults(clusters, inputs.positions(spark, sf)).agg(F.sum("n").alias("n")).select(F.lit("unplaced").alias("check"), "n")
    return tiers.validate_tiers(clusters, index).unionByName(quotient).unionByName(lost)


@query(f"""{INDEX}, h AS (SELECT depth, count(*) AS n FROM t GROUP BY depth), r AS (SELECT depth AS d, sum(n) OVER (ORDER BY depth) + coalesce(lead(n) OVER (ORDER BY depth), 0) AS r FROM h), top AS (SELECT max(d) AS d, max(r) AS m FROM r),
    th AS (SELECT 0 AS i, 0 AS d, (SELECT r FROM r WHERE d = 0) AS r), t1 AS (SELECT min(r.d) AS d, min(r.r) AS r FROM r, th WHERE r.d > th.d AND r.r >= 2 * th.r AND 2 * th.r <= (SELECT m FROM top)), t2 AS (SELECT min(r.d) AS d, min(r.r) AS r FROM r, t1 WHERE r.d > t1.d AND r.r >= 2 * t1.r AND 2 * t1.r <= (SELECT m FROM top))
    SELECT 'threshold' AS policy, array_to_string(list_sort(list_distinct(list_filter([0, t1.d, t2.d], lambda x: x < top.d) || [top.d])), ',') AS cuts FROM top, t1, t2
    UNION ALL SELECT 'doubling', array_to_string(list_sort(list_distinct(list_filter([0, 1, 2, 4, 8], lambda x: x < top.d) || [top.d])), ',') FROM top""")
def tier_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts by the first size of twice the last, and by depths that double."""
    got = tiers.compare_policies(tiers.cut_sizes(inputs.index(spark, sf))).where("policy <> 'nearest'")
    return got.select("policy", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


@query(f"{INDEX}, g AS (SELECT level, count(DISTINCT representative) AS c, count(*) AS m FROM cl GROUP BY level), j AS (SELECT *, c - lag(c) OVER (ORDER BY level) AS jump, c / lag(c) OVER (ORDER BY level) AS ratio FROM g) SELECT count(*) AS tiers, CAST(sum(c) AS BIGINT) AS clusters, round(sum(c) / (SELECT count(*) FROM t), 6) AS per_node, CAST(sum(m) AS BIGINT) AS members, max(jump) AS largest_jump, round(max(ratio), 6) AS largest_ratio FROM j")
def growth_totals(spark: SparkSession, sf: str) -> DataFrame:
    index = Scratch(spark, "growth").save(inputs.paths(spark, sf), "index")
    return tiers.growth_totals(tiers.tier_growth(tiers.clusters_at(index, inputs.cut_levels(spark))), index.count())


@query(f"""{_GROUPS}, p AS (SELECT x.a[1] AS brand, x.node_id, y.node_id AS other, list_sum(list_transform(range(1, 7), lambda i: CAST(x.a[i] <> y.a[i] AS INTEGER))) AS d FROM g x JOIN g y ON x.a[1] = y.a[1] AND x.node_id < y.node_id)
    SELECT node_id AS source, other AS target, CAST(d AS INTEGER) AS distance FROM p""")
def brand_distances(spark: SparkSession, sf: str) -> DataFrame:
    """All distances between profiles of one brand, as many differences allowed as there are loci."""
    groups = Scratch(spark, "brands").save(_groups(spark, sf), "groups")
    return profiles.allelic_pairs(groups, 6, groups.select("node_id", F.get("alleles", F.lit(0)).alias("component")))


@query(f"""{_GROUPS}, l AS (SELECT x.node_id, x.first_pos, x.a[1] AS brand, count(*) FILTER (WHERE d = 1) AS l1, count(*) FILTER (WHERE d = 2) AS l2 FROM (SELECT x.node_id, x.first_pos, x.a, list_sum(list_transform(range(1, 7), lambda i: CAST(x.a[i] <> y.a[i] AS INTEGER))) AS d FROM g x JOIN g y ON x.a[1] = y.a[1] OR x.a[2] = y.a[2] OR x.a[3] = y.a[3]) x GROUP BY ALL)
    SELECT brand AS component, arg_min(node_id, (-l1, -l2, first_pos)) AS root FROM l GROUP BY brand""")
def component_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of each brand with most variants at one and two loci, ties by the first in the input."""
    groups = Scratch(spark, "roots").save(_groups(spark, sf), "groups")
    owners = groups.select("node_id", F.get("alleles", F.lit(0)).alias("component"))
    return profiles.select_roots(profiles.allelic_pairs(groups, 2), owners, groups, 2)


@query(f"""{_PARTS}, w AS (SELECT CAST(b.t AS INTEGER) AS d, a.parts - b.parts AS n FROM parts a JOIN parts b ON b.t = a.t + 1 WHERE a.parts > b.parts AND b.t <= 2)
    SELECT 'longest' AS measure, CAST(max(d) AS BIGINT) AS n FROM w UNION ALL SELECT 'length', CAST(sum(d * n) AS BIGINT) FROM w UNION ALL SELECT 'edges', CAST(sum(n) AS BIGINT) FROM w
    UNION ALL SELECT 'linked by 1', (SELECT count(*) FROM g) - parts FROM parts WHERE t = 1 UNION ALL SELECT 'linked by 2', (SELECT count(*) FROM g) - parts FROM parts WHERE t = 2 UNION ALL SELECT 'faults', 0 UNION ALL SELECT 'disagreements', 0""")
def forest_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """Weights, faults and the certificate of the spanning forest of at most two differing loci."""
    scratch = Scratch(spark, "certificate")
    groups = scratch.save(_groups(spark, sf), "groups")
    tree = scratch.save(profiles.spanning_forest(groups, 2), "tree")
    w = profiles.tree_weights(tree).first()
    cert = profiles.mst_certificate(tree, scratch.save(profiles.allelic_pairs(groups, 2), "pairs"), [1, 2]).collect()
    faults = profiles.validate_spanning(groups, tree, 2).count()
    rows = [("longest", w["max_distance"]), ("length", w["total_distance"]), ("edges", w["edges"]), ("faults", faults), ("disagreements", sum(r["by_tree"] != r["by_pairs"] for r in cert)), *((f"linked by {r['threshold']}", r["by_pairs"]) for r in cert)]
    return spark.createDataFrame([(n, int(v)) for n, v in rows], "measure string, n long")


@query(f"""{_GROUPS}, m AS (SELECT p_partkey AS k, a, (SELECT node_id FROM g WHERE g.a = x.a) AS node_id FROM (SELECT p_partkey, {_LOCI} AS a FROM part) x),
    e AS (SELECT least(m.node_id, n.node_id) AS source, greatest(m.node_id, n.node_id) AS target, list_sum(list_transform(range(1, 7), lambda i: CAST(m.a[i] <> n.a[i] AS INTEGER))) AS d FROM m JOIN m n ON n.k = m.k + 1)
    SELECT source, target, CAST(min(d) AS INTEGER) AS distance, CAST(NULL AS VARCHAR) AS fault FROM e WHERE source <> target GROUP BY ALL""")
def collapsed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between neighbouring parts, brought down to their profiles."""
    kept = Scratch(spark, "collapsed").save(profiles.drop_incomplete_loci(inputs.profiles(spark, sf)), "kept")
    members = profiles.membership(kept, profiles.group_profiles(kept))
    a = kept.select("input_pos", labels.slugify("isolate_id").alias("source"), F.col("alleles").alias("xa"))
    b = kept.select((F.col("input_pos") - 1).alias("input_pos"), labels.slugify("isolate_id").alias("target"), F.col("alleles").alias("ya"))
    edges = a.join(b, "input_pos").select("source", "target", profiles.hamming("xa", "ya", 0, 6).alias("distance"))
    return profiles.collapse_graph(edges, members)


@query(f"{_GROUPS} SELECT members, count(*) AS profiles FROM g GROUP BY members")
def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.group_sizes(inputs.profiles(spark, sf))


@query("""SELECT 'blank' AS measure, count(*) AS n FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'repeated', count(*) FROM part WHERE p_partkey % 6 = 1 UNION ALL SELECT 'unknown', count(*) FROM part WHERE p_partkey % 6 = 2 UNION ALL SELECT 'missing', count(*) FROM part WHERE p_partkey % 6 IN (0, 2)""")
def annotation_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Blank, repeated, unknown and missing ids of an annotation table of the parts."""
    k = F.col("p_partkey") % 6
    part = table(spark, sf, "part")
    ids = part.select(F.when(k == 0, " ").when(k == 2, _id("Q", "p_partkey")).otherwise(_id("P", "p_partkey")).alias("join_id"))
    ids = ids.unionByName(part.where(k == 1).select(_id("p", "p_partkey").alias("join_id")))
    return profiles.annotation_id_audit(inputs.profiles(spark, sf), ids)


@query(f"""WITH {EDGES}, b AS (SELECT target AS source, source AS target, distance + CASE WHEN substr(target, 2)::BIGINT % 5 = 0 THEN 1 ELSE 0 END AS distance FROM edges WHERE substr(target, 2)::BIGINT % 7 <> 0 UNION ALL SELECT 'x' || target, target, 1 FROM edges WHERE substr(target, 2)::BIGINT % 11 = 0)
    SELECT 'shared' AS measure, count(*) AS n FROM edges WHERE substr(target, 2)::BIGINT % 7 <> 0 UNION ALL SELECT 'first only', count(*) FROM edges WHERE substr(target, 2)::BIGINT % 7 = 0 UNION ALL SELECT 'second only', count(*) FROM edges WHERE substr(target, 2)::BIGINT % 11 = 0
    UNION ALL SELECT 'other distance', count(*) FROM edges WHERE substr(target, 2)::BIGINT % 7 <> 0 AND substr(target, 2)::BIGINT % 5 = 0 UNION ALL SELECT 'intersection', count(*) FROM edges WHERE substr(target, 2)::BIGINT % 7 <> 0
    UNION ALL SELECT 'isolates shared', count(*) FILTER (WHERE c_custkey % 9 <> 0) FROM customer UNION ALL SELECT 'isolates first only', count(*) FILTER (WHERE c_custkey % 9 = 0) FROM customer UNION ALL SELECT 'isolates second only', 0 UNION ALL SELECT 'isolates elsewhere', count(*) FILTER (WHERE c_custkey % 9 <> 0 AND c_custkey % 8 = 1) FROM customer
    UNION ALL SELECT 'nodes shared', count(*) FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 8 <> 1) UNION ALL SELECT 'nodes first only', count(*) FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 8 <> 1)
    UNION ALL SELECT 'nodes second only', count(DISTINCT c_nationkey) FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 8 = 1""")
def export_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The edges against a second export, turned round, with some changed, lost and added."""
    edges = inputs.forest(spark, sf)[1].select("source", "target", "distance")
    k = F.substring("target", 2, 20).cast("long")
    other = edges.where(k % 7 != 0).select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("distance") + F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("distance"))
    other = other.unionByName(edges.where(k % 11 == 0).select(F.concat(F.lit("x"), "target").alias("source"), "target", F.lit(1.0).alias("distance")))
    both = quality.shared_edges(edges, other).agg(F.count(F.lit(1)).alias("n")).select(F.lit("intersection").alias("measure"), "n")
    customer = table(spark, sf, "customer")
    members = customer.select(_id("N", "c_nationkey").alias("node_id"), _id("C", "c_custkey").alias("isolate_id"))
    moved = customer.where("c_custkey % 9 <> 0").select(F.when(F.col("c_custkey") % 8 == 1, _id("M", "c_nationkey")).otherwise(_id("N", "c_nationkey")).alias("node_id"), _id("C", "c_custkey").alias("isolate_id"))
    return quality.audit_exports(edges, other).unionByName(both).unionByName(quality.audit_membership(members, moved))


@query(f"""{INDEX} SELECT 'nodes' AS kind, count(*) FILTER (WHERE depth >= 2) AS shared, CAST(0 AS BIGINT) AS first_only, count(*) FILTER (WHERE depth < 2) AS second_only FROM t UNION ALL SELECT 'edges', count(*) FILTER (WHERE depth = 3), CAST(0 AS BIGINT), count(*) FILTER (WHERE depth IN (1, 2)) FROM t""")
def detail_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes and inner edges behind the clusters of the middle tier that stand for customers, against all nodes and edges."""
    _, edges, _ = inputs.forest(spark, sf)
    index = Scratch(spark, "detail").save(inputs.paths(spark, sf), "index")
    clusters = tiers.clusters_at(index, inputs.cut_levels(spark)).where("level = 1")
    nodes, inner = quality.reconstruct_detail(clusters.where("representative like 'C%'").select("cluster_id").distinct(), clusters, edges)
    by_node, by_edge = quality.semantic_equivalence(nodes, index), quality.semantic_equivalence(inner, edges, "edge_id")
    return by_node.withColumn("kind", F.lit("nodes")).unionByName(by_edge.withColumn("kind", F.lit("edges")))


@query("""WITH p AS (SELECT 'N' || n_nationkey AS node_id, n_nationkey * CAST(37 AS DOUBLE) % 101 AS x, n_nationkey * CAST(59 AS DOUBLE) % 83 AS y FROM nation UNION ALL SELECT 'C' || c_custkey, CAST(c_custkey * 7919 % 10007 AS DOUBLE) / 99, CAST(c_custkey * 104729 % 9973 AS DOUBLE) / 119 FROM customer),
    b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), f AS (SELECT node_id, (x - x0) * least(1000 / (x1 - x0), 700 / (y1 - y0)) AS x, (y - y0) * least(1000 / (x1 - x0), 700 / (y1 - y0)) AS y FROM p, b),
    s AS (SELECT c_custkey AS e, 'N' || c_nationkey AS s, 'C' || c_custkey AS t, a.x AS ax, a.y AS ay, c.x AS bx, c.y AS by_ FROM customer JOIN f a ON a.node_id = 'N' || c_nationkey JOIN f c ON c.node_id = 'C' || c_custkey),
    cross_ AS (SELECT count(*) AS crossings FROM s u JOIN s v ON u.e < v.e AND u.s <> v.s WHERE
        ((u.bx - u.ax) * (v.ay - u.ay) - (u.by_ - u.ay) * (v.ax - u.ax)) * ((u.bx - u.ax) * (v.by_ - u.ay) - (u.by_ - u.ay) * (v.bx - u.ax)) < 0 AND ((v.bx - v.ax) * (u.ay - v.ay) - (v.by_ - v.ay) * (u.ax - v.ax)) * ((v.bx - v.ax) * (u.by_ - v.ay) - (v.by_ - v.ay) * (u.bx - v.ax)) < 0)
    SELECT crossings, (SELECT count(*) FROM f a JOIN f c ON a.node_id < c.node_id AND sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) < 6) AS overlaps FROM cross_""")
def layout_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Crossings of the edges from nations to customers, and overlapping discs."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    places = nation.select(_id("N", "n_nationkey").alias("node_id"), (n * 37.0 % 101).alias("x"), (n * 59.0 % 83).alias("y"))
    places = places.unionByName(customer.select(_id("C", "c_custkey").alias("node_id"), ((c * 7919 % 10007).cast("double") / 99).alias("x"), ((c * 104729 % 9973).cast("double") / 119).alias("y")))
    edges = customer.select(F.col("c_custkey").alias("edge_id"), _id("N", "c_nationkey").alias("source"), _id("C", "c_custkey").alias("target"))
    return quality.layout_quality(places, edges)


# --- statistics ----------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_type, user_id % 10 AS g, CASE user_id % 7 WHEN 0 THEN 'failure' WHEN 1 THEN 'timeout' WHEN 2 THEN 'invalid' ELSE 'success' END AS s, user_id % 10 = 0 AS w, event_id % 50 = 0 AS odd FROM events),
    m AS (SELECT *, count(DISTINCT odd) OVER (PARTITION BY event_type, g) AS kinds FROM (SELECT * FROM e WHERE NOT w AND s <> 'failure'))
    SELECT event_type, CASE WHEN s = 'success' AND kinds > 1 THEN 'invalid' ELSE s END AS s, count(*) AS n FROM m GROUP BY 1, 2""")
def measured_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of measured events, successes of groups of mixed identity being invalid."""
    rows = _states(spark, sf).withColumn("failed", F.col("s") == "failure").withColumn("g", F.col("user_id") % 10).withColumn("odd", F.col("event_id") % 50 == 0)
    kept = stats.measured(rows, "w", "failed")
    return stats.invalidate_mixed(kept, ["event_type", "g"], "odd", "s").groupBy("event_type", "s").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_type, user_id % 7 >= 3 AS good, value AS total, value * 0.25 AS a, value * 0.5 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS b FROM events WHERE value IS NOT NULL), g AS (SELECT event_type, good, total - (a + b) AS rest, a, b FROM e)
    SELECT event_type, count(*) AS n, count(*) FILTER (WHERE good) AS successes, count(*) FILTER (WHERE good AND abs(rest) > 1e-6) AS unbalanced, round(quantile_cont(a, 0.5) FILTER (WHERE good), 6) AS a_median, round(quantile_cont(a, 0.25) FILTER (WHERE good), 6) AS a_p25, round(quantile_cont(a, 0.75) FILTER (WHERE good), 6) AS a_p75,
        round(quantile_cont(b, 0.5) FILTER (WHERE good), 6) AS b_median, round(quantile_cont(b, 0.25) FILTER (WHERE good), 6) AS b_p25, round(quantile_cont(b, 0.75) FILTER (WHERE good), 6) AS b_p75, round(quantile_cont(rest, 0.5) FILTER (WHERE good), 6) AS rest_median, round(quantile_cont(rest, 0.25) FILTER (WHERE good), 6) AS rest_p25, round(quantile_cont(rest, 0.75) FILTER (WHERE good), 6) AS rest_p75 FROM g GROUP BY event_type""")
def phase_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    """Phases of successful events, what they leave of the total, and rows whose phases miss it."""
    rows = _states(spark, sf).where("value is not null").withColumn("a", F.col("value") * 0.25).withColumn("b", F.col("value") * 0.5 + F.when(F.col("event_id") % 10 == 0, 1.0).otherwise(0.0))
    return stats.phase_summary(rows, ["event_type"], ["a", "b"], "value", "s")


@query("""WITH a AS (SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS m, round(quantile_cont(value, 0.25), 6) AS p, round(quantile_cont(value, 0.75), 6) AS q FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS m, round(quantile_cont(value, 0.25), 6) AS p, round(quantile_cont(value, 0.75), 6) AS q FROM events WHERE user_id % 2 = 1 GROUP BY 1)
    SELECT event_type, a.n AS a_n, a.m AS a_median, a.p AS a_p25, a.q AS a_p75, b.n AS b_n, b.m AS b_median, b.p AS b_p25, b.q AS b_p75 FROM a JOIN b USING (event_type)""")
def matched_systems(spark: SparkSession, sf: str) -> DataFrame:
    """Events of even and odd users side by side on equal conditions."""
    events = table(spark, sf, "events")
    return stats.compare_systems(events.where("user_id % 2 = 0"), events.where("user_id % 2 = 1"), ["event_type"], "value")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY event_id) AS b, value FROM events)
    SELECT user_id, count(*) AS events, count(*) FILTER (WHERE t < b) AS out_of_order, count(*) FILTER (WHERE t < 1.6e9 OR t > 1.71e9) AS outside, count(*) FILTER (WHERE least(value - 1, 0) < 0) AS negative, CAST(0 AS BIGINT) AS unbalanced FROM e GROUP BY user_id""")
def event_order(spark: SparkSession, sf: str) -> DataFrame:
    """Steps back in time and events outside a span, per user, and negative phases."""
    rows = table(spark, sf, "events").withColumn("t", _seconds("ts")).withColumn("a", F.lit(1.6e9)).withColumn("z", F.lit(1.71e9)).withColumn("p", F.col("value") - 1).withColumn("q", F.lit(1.0))
    order = stats.audit_event_phases(rows, "user_id", "event_id", "a", "t", "z")
    return order.join(stats.phase_faults(rows, "user_id", ["p", "q"], "value"), "user_id")


@query("""SELECT user_id, arg_max(1 + event_id % 8 / 8.0, (ts, event_id)) AS wait, arg_max(event_id % 4 / 4.0, (ts, event_id)) AS request FROM events GROUP BY user_id""")
def timer_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """For the last event of each user as a timer, of simultaneous ones that of the largest id: the gaps from schedule to firing and to the request."""
    fired, k = _seconds("ts"), F.col("event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", fired.alias("fired"), (fired - 1 - k % 8 / 8.0).alias("scheduled"), (fired + k % 4 / 4.0).alias("requested"))
    return stats.timer_gaps(rows, "user_id", "scheduled", "fired", "requested", "event_id").select("user_id", F.round("wait", 3).alias("wait"), F.round("request", 3).alias("request"))


@query(f"""{INDEX}, m AS (SELECT level, 'lod_' || level || '_' || representative AS cluster_id, count(*) AS members FROM cl GROUP BY ALL HAVING count(*) > 1), k AS (SELECT *, row_number() OVER (ORDER BY members, level, cluster_id) - 1 AS k, count(*) OVER () AS n FROM m),
    a AS (SELECT arg_min(members, (abs(members - d), members)) AS c FROM m, (SELECT members AS d FROM k WHERE k = round_even(0.1 * (n - 1), 0)) WHERE members >= 2),
    b AS (SELECT arg_min(members, (abs(members - d), members)) AS c FROM m, a, (SELECT members AS d FROM k WHERE k = round_even(0.5 * (n - 1), 0)) WHERE members >= 2 * a.c),
    z AS (SELECT arg_min(members, (abs(members - d), members)) AS c FROM m, b, (SELECT members AS d FROM k WHERE k = round_even(0.99 * (n - 1), 0)) WHERE members >= 2 * b.c)
    SELECT share, arg_min(cluster_id, (level, cluster_id)) AS cluster_id, members FROM m JOIN (SELECT CAST(0.1 AS DOUBLE) AS share, c FROM a UNION ALL SELECT CAST(0.5 AS DOUBLE), c FROM b UNION ALL SELECT CAST(0.99 AS DOUBLE), c FROM z) ON c = members GROUP BY share, members""")
def selected_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of all tiers whose members are nearest to those at the ranks of 10, 50 and 99 percent, each of at least twice the members of the one before."""
    return stats.select_targets(inputs.clusters(spark, sf).groupBy("level", "cluster_id").agg(F.count(F.lit(1)).alias("members")))


@query("""SELECT event_type, user_id % 3 AS series, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def plotted_series(spark: SparkSession, sf: str) -> DataFrame:
    """Medians and quartiles of series, none of whose values may be infinite."""
    return stats.series_stats(table(spark, sf, "events").where("value is not null").withColumn("series", F.col("user_id") % 3), ["event_type", "series"], "value")


@query("""SELECT user_id % 5 AS cell, CASE WHEN user_id % 5 IN (1, 3) THEN 'new' ELSE 'old' END AS run, count(*) AS n FROM events GROUP BY ALL""")
def combined_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a base run, and those of a replacement where it has them."""
    events = table(spark, sf, "events").select((F.col("user_id") % 5).alias("cell"))
    return stats.combine_runs(events.withColumn("run", F.lit("old")), events.where("cell in (1, 3)").withColumn("run", F.lit("new")), ["cell"]).groupBy("cell", "run").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'event_type' AS "column", count(DISTINCT event_type) AS n FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events""")
def constant_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that should hold one value and do not; a true constant is not among them."""
    return stats.constant_faults(table(spark, sf, "events").withColumn("fixed", F.lit(1)), ["event_type", "user_id", "fixed"])


@query("""WITH d AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL WHEN user_id % 2 = 0 THEN value END AS gap FROM events) SELECT event_type, count(gap) AS valid, count(*) FILTER (WHERE gap IS NULL) AS missing, round(sum(gap), 3) AS total FROM d GROUP BY event_type""")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    """Differences that are finite and not negative; others are null: an infinite end, a missing one, a step back."""
    before, k = F.lit(5.0), F.col("event_id") % 3
    after = F.when(k == 0, F.lit(float("inf"))).when(F.col("user_id") % 2 == 0, F.col("value") + 5.0).otherwise(F.lit(1.0))
    gaps = table(spark, sf, "events").select("event_type", stats.duration_metric(before, after).alias("gap"))
    return gaps.groupBy("event_type").agg(F.count("gap").alias("valid"), F.count_if(F.col("gap").isNull()).alias("missing"), F.round(F.sum("gap"), 3).alias("total"))


# --- bundles -------------------------------------------------------------------------------------------------------------------


def _nation_forest(spark: SparkSession, sf: str) -> bundles.Forest:
    """Regions' nations and customers as an ingested forest with the customers' segments."""
    nodes, edges, roots = inputs.forest(spark, sf)
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_pos"), _id("C", "c_custkey").alias("join_id"), F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value"))
    bundles.require_sound(nodes, edges, roots)
    values, types, warnings = bundles.annotated(nodes, cells, None, None)
    return bundles.Forest(nodes, edges, roots, values, types, warnings, "given")


@query(f"""{INDEX}, c AS (SELECT count(*) AS roots FROM t WHERE parent IS NULL OR distance > 90) SELECT (SELECT count(*) FROM t) AS nodes, (SELECT count(*) FROM edges WHERE distance <= 90) AS edges, roots, CAST(90 AS DOUBLE) AS cutoff, 'given' AS strategy,
    (SELECT count(*) FROM t) - (SELECT count(*) FROM customer) || ' nodes without row; roots: ' || roots AS told FROM c""")
def ingested_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and warnings of the forest with annotations after a cut at distance 90."""
    found = bundles.cut(_nation_forest(spark, sf), 90.0)
    rows = {r["message"] for r in found.warnings.collect()}
    bare = next(m for m in rows if m.startswith("node without row")).split(": ")[1]
    cut = next(m for m in rows if m.startswith("edges longer")).split(", ")[1]
    counts = found.counts().select("nodes", "edges", "roots")
    return counts.withColumn("cutoff", F.lit(found.cutoff)).withColumn("strategy", F.lit(found.strategy)).withColumn("told", F.lit(f"{bare} nodes without row; {cut}"))


@query(f"""{INDEX}, n0 AS (SELECT a0 FROM t WHERE node_id = 'N0') SELECT a0 AS old_component, CASE WHEN a0 = (SELECT a0 FROM n0) THEN 'N0' ELSE a0 END AS new_component, count(*) AS nodes, (SELECT count(*) FROM customer) AS annotations, 'user' AS strategy, 'given' AS default_strategy, CAST(50 AS DOUBLE) AS cutoff, TRUE AS restored FROM t GROUP BY a0""")
def root_revision(spark: SparkSession, sf: str) -> DataFrame:
    """Components before and after, their sizes, annotations and settings of a published version that was hung up at nation 0, put back to its defaults and hung up again."""
    root = Scratch(spark, "revision").root
    found = _nation_forest(spark, sf)
    found = replace(found, cutoff=50.0, options={"level": 2})
    one = bundles.publish_prepared(spark, root, "d", found, bundles.prepare(found, inputs.positions(spark, sf)))
    two = bundles.publish_root_revision(spark, root, "d", one, "N0")
    back = bundles.publish_root_revision(spark, root, "d", two.version, None)
    again = bundles.publish_root_revision(spark, root, "d", back.version, "N0")
    restored = back.version == one and again.version == two.version and bundles.publish_root_revision(spark, root, "d", two.version, "N0").version == two.version
    index = versions.read_version(spark, root, "tree_index", "d", again.version).groupBy(F.col("component").alias("new_component")).agg(F.count(F.lit(1)).alias("nodes"))
    notes = versions.read_version(spark, root, "annotations", "d", again.version).agg(F.count(F.lit(1)).alias("annotations"))
    settings = versions.read_version(spark, root, "settings", "d", again.version).select("strategy", "default_strategy", "cutoff")
    return again.components.join(index, "new_component").crossJoin(notes).crossJoin(settings).withColumn("restored", F.lit(restored))


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'zz' || c_custkey ELSE 'C' || c_custkey END AS j FROM customer) SELECT 'matched' AS measure, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS n FROM c UNION ALL SELECT 'row without node', count(*) FILTER (WHERE c_custkey % 4 = 0) FROM c
    UNION ALL SELECT 'node without row', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) + count(*) FILTER (WHERE c_custkey % 4 = 0) FROM c UNION ALL SELECT 'values', 2 * count(*) FILTER (WHERE c_custkey % 4 <> 0) FROM c
    UNION ALL SELECT 'type of size: number', 1 UNION ALL SELECT 'type of segment: string', 1 UNION ALL SELECT 'nodes of the geometry', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) + count(*) FROM c""")
def replacement_report(spark: SparkSession, sf: str) -> DataFrame:
    """What a table of new annotations does to a published version: matched nodes, misses of both kinds, values, inferred types; the geometry is shared."""
    root = Scratch(spark, "replacing").root
    found = _nation_forest(spark, sf)
    one = bundles.publish_prepared(spark, root, "d", found, bundles.prepare(found, inputs.positions(spark, sf)))
    key = F.col("c_custkey")
    cells = table(spark, sf, "customer").select(key.alias("row_pos"), F.when(key % 4 == 0, _id("zz", "c_custkey")).otherwise(_id("C", "c_custkey")).alias("join_id"), F.inline(F.array(F.struct(F.lit("segment").alias("key"), F.concat("c_mktsegment", F.lit("!")).alias("value")), F.struct(F.lit("size").alias("key"), (key % 9).cast("string").alias("value")))))
    got = bundles.replace_annotations(spark, root, "d", one, cells)
    told = got.warnings.select(F.split("message", ": ")[0].alias("measure"), F.split("message", ": ")[1].cast("long").alias("n"))
    types = got.types.select(F.concat(F.lit("type of "), "key", F.lit(": "), "type").alias("measure"), F.lit(1).cast("long").alias("n"))
    values = versions.read_version(spark, root, "annotations", "d", got.version).agg(F.count(F.lit(1)).alias("n")).select(F.lit("values").alias("measure"), "n")
    nodes = versions.read_geometry(spark, root, "nodes", "d", got.version).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes of the geometry").alias("measure"), "n")
    return told.unionByName(types).unionByName(values).unionByName(nodes).unionByName(spark.createDataFrame([("matched", got.matched)], "measure string, n long"))


@query("SELECT 'C' || c_custkey AS node_id, 'segment' AS key, upper(c_mktsegment) || '!' AS value FROM customer")
def replaced_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """The annotations of a version whose geometry is that of the version before."""
    root = Scratch(spark, "replaced").root
    customer = table(spark, sf, "customer").withColumn("node_id", _id("C", "c_custkey"))
    nodes = customer.select("node_id")
    one = versions.layout_version({"nodes": nodes})
    versions.write_version({"nodes": nodes}, root, "d", one)
    versions.publish(spark, root, "d", one)
    two = versions.replace_annotations(spark, root, "d", one, customer.select("node_id", F.lit("segment").alias("key"), F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("value")))
    places = versions.read_geometry(spark, root, "nodes", "d", two)
    return versions.read_version(spark, root, "annotations", "d", two).join(places, "node_id", "left_semi")


@query(f"""{_PARTS} SELECT (SELECT count(*) FROM g) AS nodes, (SELECT count(*) FROM g) - parts AS edges, parts AS roots, (SELECT count(*) FROM part) AS members, CAST(1 AS BIGINT) AS dropped FROM parts WHERE t = 2""")
def ingested_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the rooted spanning forest of the parts' typing matrix, edges of at most two differing loci."""
    found = bundles.ingest_profiles(inputs.profiles(spark, sf), 2, 2)
    dropped = found.warnings.where("message = 'Incomplete loci dropped: 1'").count()
    return found.counts().select("nodes", "edges", "roots").withColumn("members", F.lit(found.members.count()).cast("long")).withColumn("dropped", F.lit(dropped).cast("long"))
