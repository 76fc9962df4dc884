"""From sources to published versions: ingest, prepare, publish, reroot. Every step is a composition of the operators."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from silvaspan.operators import annotations as A, forest, newick, profiles, reads, summaries, tiers
from silvaspan.operators.metadata import direct_annotations
from silvaspan.operators.ordering import sum_before
from silvaspan.scratch import Scratch
from silvaspan.sources import versions


#: The tables whose contents make the version, and the stored digests of them.
CONTENTS, DIGESTS = ("nodes", "edges", "roots", "annotations"), "name string, digest string"
SETTINGS = "strategy string, default_strategy string, cutoff double, options string, small long"
#: Levels that one job of ``oriented`` adds.
STEPS = 4


@dataclass(frozen=True)
class Forest:
    """An ingested forest: tables, warnings (message), and how its roots were chosen."""

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    values: DataFrame
    types: DataFrame
    warnings: DataFrame
    strategy: str
    members: DataFrame | None = None
    cutoff: float | None = None
    options: dict = field(default_factory=dict)

    def counts(self) -> DataFrame:
        """One row (nodes, edges, roots, warnings)."""
        one = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((self.nodes, "nodes"), (self.edges, "edges"), (self.roots, "roots"), (self.warnings, "warnings"))]
        return one[0].crossJoin(one[1]).crossJoin(one[2]).crossJoin(one[3])


def require_sound(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> None:
    faults = forest.validate_forest(nodes, edges, roots).collect()  # a row per kind of fault
    if faults:
        raise ValueError("; ".join(f"{r['error']}: {r['n']}" for r in faults))


def annotated(ids: DataFrame, cells: DataFrame | None, direct: DataFrame | None, declared: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, types, warnings): cells (row_pos, join_id, key, value) joined to ids (node_id), direct values (node_id, key, value) over them."""
    spark = ids.sparkSession
    warnings = spark.createDataFrame([], "message string")
    values, types = spark.createDataFrame([], "node_id string, key string, value string"), spark.createDataFrame([], "key string, type string")
    if cells is not None:
        scratch = Scratch(spark, "annotated")
        joined = scratch.save(A.join_annotations(cells.select("row_pos", "join_id").distinct(), ids), "joined")
        types = scratch.save(A.infer_types(cells), "types")
        found = cells.join(joined.where("node_id is not null").select("row_pos", "node_id"), "row_pos")
        values = A.aggregate_rows(found, types).select("node_id", "key", "value")
        warnings = A.annotation_warnings(joined, ids).where("n > 0").select(F.concat_ws(": ", "kind", F.col("n").cast("string")).alias("message"))
    if declared is not None:
        types = A.infer_schema(cells if cells is not None else values, declared)
    if direct is not None:
        values = A.merge_annotations(direct, values)
        if declared is not None:
            bad = A.validate_annotations(direct, ids, declared).limit(1).collect()
            if bad:
                raise ValueError(f"{bad[0]['violation']}: {bad[0]['subject']}")
    return values, types, warnings


def cut(found: Forest, cutoff: float | None) -> Forest:
    """found without edges longer than the cutoff; severed nodes become roots."""
    if cutoff is None:
        return found
    edges, roots = forest.cut_forest(found.edges, forest.index_forest(found.edges, found.roots), cutoff)
    roots = Scratch(edges.sparkSession, "cut").save(roots, "roots")
    told = roots.agg(F.count(F.lit(1)).cast("string").alias("n")).select(F.concat(F.lit(f"edges longer than {cutoff:g} are left out, roots: "), "n").alias("message"))
    return replace(found, edges=edges, roots=roots, warnings=found.warnings.unionByName(told), cutoff=cutoff)


def ingest_newick(docs: DataFrame, cells: DataFrame | None = None, direct: DataFrame | None = None, declared: DataFrame | None = None, cutoff: float | None = None, strict: bool = False) -> Forest:
    """The forest of one Newick document (doc_id, content) with annotations. Faults of the text or the forest are errors."""
    got = newick.parse_forests(docs, strict)
    faults = got["errors"].limit(3).collect()
    if faults:
        raise ValueError("; ".join(r["message"] for r in faults))
    nodes, edges = got["nodes"].select("node_id"), got["edges"].select("edge_id", "source", "target", "distance")
    roots = got["roots"].select("node_id", "root_pos")
    require_sound(nodes, edges, roots)
    values, types, warnings = annotated(got["nodes"].where("explicit").select("node_id"), cells, direct_annotations(direct, None, declared) if direct is not None else None, declared)
    found = Forest(nodes, edges, roots, values, types, got["warnings"].select("message").unionByName(warnings), "newick")
    return cut(found, cutoff)


def oriented(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(edge_id, source, target, distance): undirected edges turned away from the roots, numbered in the order of their ends."""
    scratch = Scratch(tree.sparkSession, "oriented")
    arcs = scratch.save(tree.select("source", "target", "distance").unionByName(tree.select(F.col("target").alias("source"), F.col("source").alias("target"), "distance")), "arcs")
    now = roots.select(F.col("node_id").alias("target"), F.lit(None).cast("string").alias("source"))
    out = None
    while True:
        batch = None
        for _ in range(STEPS):
            above = now.select(F.col("target").alias("at"), F.col("source").alias("back"))
            now = arcs.join(above, arcs["source"] == above["at"]).where("back is null or target <> back").select("source", "target", "distance")
            batch = now if batch is None else batch.unionByName(now.select(*batch.columns))
        batch = scratch.save(batch, "batch")
        if not batch.limit(1).count():
            break
        out = batch if out is None else out.unionByName(batch)
        reached = scratch.save(batch.join(batch.select(F.col("source").alias("target")).distinct(), "target", "left_anti"), "tips")
        now = reached.select("target", "source")
    if out is None:
        out = tree.select("source", "target", "distance").limit(0)
    numbered = sum_before(out.withColumn("one", F.lit(1)), ["source", "target"], "one", "k")
    return numbered.select(F.concat(F.lit("e_profile_"), F.col("k").cast("string")).alias("edge_id"), "source", "target", F.col("distance").cast("double").alias("distance"))


def ingest_profiles(rows: DataFrame, limit: int | None = None, level: int = 3, cells: DataFrame | None = None, cutoff: float | None = None) -> Forest:
    """The spanning forest of a typing matrix (isolate_id, input_pos, alleles), rooted by variant counts up to ``level``."""
    scratch = Scratch(rows.sparkSession, "profiles")
    faults = profiles.id_faults(rows).limit(3).collect()
    if faults:
        raise ValueError("; ".join(f"{r['fault']}: {r['isolate_norm']}" for r in faults))
    kept = profiles.drop_incomplete_loci(rows)
    groups = scratch.save(profiles.group_profiles(kept), "groups")
    tree = scratch.save(profiles.spanning_forest(groups, limit), "tree")
    owners = forest.components_of(groups.select("node_id"), tree)
    pairs = scratch.save(profiles.allelic_pairs(groups, min(level, profiles.n_loci(groups))), "pairs")
    chosen = profiles.select_roots(pairs, owners, groups, level)
    roots = scratch.save(chosen.join(groups.select(F.col("node_id").alias("root"), F.col("first_pos").alias("root_pos")), "root").select(F.col("root").alias("node_id"), "root_pos"), "roots")
    edges = scratch.save(oriented(tree, roots), "edges")
    members = profiles.membership(kept, groups)
    nodes = groups.select("node_id")
    require_sound(nodes, edges, roots)
    values, types, warnings = annotated(members.select(F.col("isolate_norm").alias("node_id")), cells, None, None)
    dropped = profiles.locus_report(rows).where("not retained").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.concat(F.lit("Incomplete loci dropped: "), F.col("n").cast("string")).alias("message"))
    return cut(Forest(nodes, edges, roots, values, types, dropped.unionByName(warnings), "variants", members, options={"limit": limit, "level": level}), cutoff)


def prepare(found: Forest, positions: DataFrame, small: int = tiers.SMALL_COMPONENT, index: DataFrame | None = None, defaults: DataFrame | None = None, default_strategy: str | None = None, stored: bool = False) -> dict[str, DataFrame]:
    """The tables of one version: index, cuts, clusters, quotient edges, geometry, components, what was ingested, and how.

    index: one that is known already. defaults, default_strategy: the roots that the dataset was first prepared with, and how those were chosen; by default these.
    stored: the positions are those of all nodes, and these, the edges and the annotations are stored tables.
    """
    scratch = Scratch(positions.sparkSession, "prepare")
    nodes = positions.select("node_id", "x", "y") if stored else scratch.save(found.nodes.join(positions.select("node_id", "x", "y"), "node_id", "left"), "nodes")
    edges, values = (found.edges, found.values) if stored else (scratch.save(found.edges, "edges"), scratch.save(found.values, "annotations"))
    index = scratch.save(forest.index_forest(edges, found.roots) if index is None else index, "index")
    settings = positions.sparkSession.createDataFrame([(found.strategy, default_strategy or found.strategy, found.cutoff, json.dumps(found.options, sort_keys=True), small)], SETTINGS)
    members = {"members": found.members} if found.members is not None else {}
    shown = tiers.presentation_depths(index, small)
    cuts = scratch.save(tiers.levels_of(tiers.select_cuts(tiers.cut_sizes(shown))), "cuts")
    clusters = scratch.save(tiers.clusters_at(shown, cuts), "clusters")
    return {
        "nodes": nodes, "edges": edges, "roots": found.roots.select("node_id", F.col("root_pos").cast("long").alias("root_pos")), "tree_index": index,
        "cuts": cuts, "clusters": clusters, "quotient": tiers.shown_edges(shown, cuts, edges), "geometry": summaries.cluster_geometry(clusters, positions),
        "components": reads.component_boxes(index, positions), "annotations": values, "types": found.types, "warnings": found.warnings,
        "defaults": (found.roots if defaults is None else defaults).select("node_id"), "settings": settings, **members,
    }


def publish_prepared(spark: SparkSession, root: str, dataset_id: str, found: Forest, tables: dict[str, DataFrame]) -> str:
    """Writes and publishes the tables under a version that follows from their contents; a version in print stays as it is."""
    digests = {n: versions.digest(tables[n]) for n in CONTENTS}
    version = _version(dataset_id, found, digests)
    if not versions.is_published(spark, root, dataset_id, version):
        _publish(spark, root, dataset_id, version, tables, digests)
    return version


def _version(dataset_id: str, found: Forest, digests: dict[str, str]) -> str:
    return versions.version_of(digests, f"{dataset_id}|{found.strategy}|{found.cutoff}|{sorted(found.options.items())}")


def _publish(spark: SparkSession, root: str, dataset_id: str, version: str, tables: dict[str, DataFrame], digests: dict[str, str]) -> None:
    versions.publish(spark, root, dataset_id, version, status="refining")
    versions.write_version(tables | {"digests": spark.createDataFrame(sorted(digests.items()), DIGESTS)}, root, dataset_id, version)
    versions.publish(spark, root, dataset_id, version)


def preparation_summary(found: Forest, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: nodes, edges, clusters, tiers, roots, warnings, cutoff, strategy."""
    clusters = tables["clusters"].agg(F.count_distinct("cluster_id").alias("clusters"), F.greatest(F.count_distinct("level"), F.lit(1)).alias("tiers"))
    return found.counts().crossJoin(clusters).select("nodes", "edges", "clusters", "tiers", "roots", "warnings", F.lit(found.cutoff).cast("double").alias("cutoff"), F.lit(found.strategy).alias("strategy"))


def rerooted(edges: DataFrame, index: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, roots, moved): every component with a row in wanted (node_id), one at most, hung up there; the order of the roots stays."""
    scratch = Scratch(edges.sparkSession, "rerooted")
    at = scratch.save(index.join(wanted.select("node_id").distinct(), "node_id").select("component", F.col("node_id").alias("new"), F.col("dfs_start").alias("s")), "at")
    if at.count() != at.select("component").distinct().count():
        raise ValueError("a component has one root")
    if wanted.select("node_id").distinct().count() != at.count():
        raise ValueError("a root is a node of the forest")
    path = index.join(at, "component").where("dfs_start <= s and s < dfs_end").select(F.col("node_id").alias("target"), F.lit(True).alias("turn"))
    turned = edges.join(path, "target", "left").select(
        "edge_id", F.when(F.col("turn"), F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("turn"), F.col("source")).otherwise(F.col("target")).alias("target"), "distance"
    )
    old = index.where("parent is null").select("node_id", F.col("dfs_start").alias("root_pos"), "component").join(at, "component", "left")
    roots = old.select(F.coalesce("new", "node_id").alias("node_id"), "root_pos")
    moved = old.select(F.col("component").alias("old_component"), F.coalesce("new", "node_id").alias("new_component"))
    return turned, roots, moved


@dataclass(frozen=True)
class Revision:
    """A version after its roots changed, the root before and after of every component, and the roots of the first preparation."""

    version: str
    components: DataFrame
    defaults: DataFrame


def stored(spark: SparkSession, root: str, dataset_id: str, version: str) -> dict[str, DataFrame]:
    """The tables of a version: annotations are its own, all others those of the version whose geometry it shares."""
    kinds = {"annotations": "node_id string, key string, value string", "types": "key string, type string", "warnings": "message string"}
    own = {n: versions.read_version(spark, root, n, dataset_id, version, kind) for n, kind in kinds.items()}
    shared = {n: versions.read_geometry(spark, root, n, dataset_id, version) for n in ("nodes", "edges", "roots", "tree_index", "defaults", "settings")}
    return own | shared


def _members(spark: SparkSession, root: str, dataset_id: str, version: str) -> DataFrame | None:
    """The isolates of a version's nodes, or None if it has none."""
    if not versions.has_table(spark, root, "members"):
        return None
    found = versions.read_geometry(spark, root, "members", dataset_id, version)
    return found if found.limit(1).count() else None


def _digests(spark: SparkSession, root: str, dataset_id: str, version: str, read: dict[str, DataFrame]) -> dict[str, str]:
    """The digests of nodes and annotations of a version: stored with it, or found anew where its annotations, or those of its time, are not."""
    shared, known = versions.geometry_of(spark, root, dataset_id, version), {}
    if versions.has_table(spark, root, "digests"):
        known = {r["name"]: r["digest"] for r in versions.read_version(spark, root, "digests", dataset_id, shared, DIGESTS).collect()}  # a row per table
    own = {n: known.get(n) for n in (("nodes", "annotations") if shared == version else ("nodes",))}
    return {n: own.get(n) or versions.digest(read[n]) for n in ("nodes", "annotations")}


def publish_root_revision(spark: SparkSession, root: str, dataset_id: str, version: str, node_id: str | None) -> Revision:
    """A version whose component of node_id hangs at that node, or, without node_id, all of whose components hang at the roots of their first preparation.

    Positions are kept and have to be complete, and so are cutoff, options, isolates and the size of small components. The strategy is that of the first preparation
    whenever all roots are its roots, else ``user``. A request that changes no root keeps the version. One component is turned by its
    intervals, the index of all others stays; several at once are indexed anew.
    """
    read = stored(spark, root, dataset_id, version)
    if read["nodes"].where("x is null or y is null").limit(1).count():
        raise ValueError("the prepared geometry is incomplete")
    index, settings, defaults = read["tree_index"], read["settings"].first(), read["defaults"]
    current = index.where("parent is null").select(F.col("node_id").alias("component"))
    homes = defaults.join(index.select("node_id", "component"), "node_id")
    wanted = homes.select("node_id", "component") if node_id is None else index.where(F.col("node_id") == node_id).select("node_id", "component")
    scratch = Scratch(spark, "revision")
    wanted = scratch.save(wanted, "wanted")
    if node_id is not None and not wanted.count():
        raise ValueError("a root is a node of the forest")
    components = scratch.save(current.join(wanted, "component", "left").select(F.col("component").alias("old_component"), F.coalesce("node_id", "component").alias("new_component")), "components")
    changed = components.where("old_component <> new_component").count()
    if not changed:
        return Revision(version, components, defaults)
    edges, _, _ = rerooted(read["edges"], index, wanted.select("node_id"))
    edges = scratch.save(edges, "edges")
    # The place of a root is kept, so components keep their order; numbers are those of the stored roots.
    places = read["roots"].select(F.col("node_id").alias("old_component"), "root_pos").join(components, "old_component")
    roots = scratch.save(places.select(F.col("new_component").alias("node_id"), "root_pos"), "places")
    default = not roots.select("node_id").exceptAll(defaults).limit(1).count()
    strategy = settings["default_strategy"] if default else "user"
    found = Forest(read["nodes"].select("node_id"), edges, roots, read["annotations"], read["types"], read["warnings"], strategy, _members(spark, root, dataset_id, version), settings["cutoff"], json.loads(settings["options"]))
    # A revision leaves nodes and annotations as they are, so the version is known before anything is prepared for it.
    digests = _digests(spark, root, dataset_id, version, read) | {"edges": versions.digest(edges), "roots": versions.digest(roots)}
    new = _version(dataset_id, found, digests)
    if not versions.is_published(spark, root, dataset_id, new):
        turned = forest.rerooted_index(index, node_id) if changed == 1 and node_id is not None else None
        _publish(spark, root, dataset_id, new, prepare(found, read["nodes"], settings["small"], turned, defaults, settings["default_strategy"], stored=True), digests)
    return Revision(new, components, defaults)


@dataclass(frozen=True)
class Replacement:
    """A version with other annotations: how many nodes have a row, what had none, and the fields' types."""

    version: str
    matched: int
    warnings: DataFrame
    types: DataFrame


def replace_annotations(spark: SparkSession, root: str, dataset_id: str, version: str, cells: DataFrame) -> Replacement:
    """The version's annotations replaced by a table's cells (row_pos, join_id, key, value), under a version that shares its geometry.

    Rows name nodes, or, where nodes have isolates, isolates: then an isolate has one row at most, and a node's values are those of its isolates
    together. A table that matches nothing is an error. Types are inferred anew. The same contents give the same version.
    """
    scratch = Scratch(spark, "replacement")
    nodes, members = versions.read_geometry(spark, root, "nodes", dataset_id, version).select("node_id"), _members(spark, root, dataset_id, version)
    ids = nodes if members is None else members.select(F.col("isolate_norm").alias("node_id"))
    joined = scratch.save(A.join_annotations(cells.select("row_pos", "join_id").distinct(), ids), "joined")
    if not joined.where("node_id is not null").limit(1).count():
        raise ValueError("the table matches no node and no isolate")
    rows = cells.join(joined.where("node_id is not null").select("row_pos", "node_id"), "row_pos")
    isolates = {}
    if members is not None:
        if joined.where("node_id is not null").groupBy("node_id").count().where("count > 1").limit(1).count():
            raise ValueError("an isolate has several rows")
        named = rows.select(F.col("node_id").alias("join_id"), "key", "value")
        isolates = {"isolates": A.attach_isolates(members, named)}
        rows = rows.withColumnRenamed("node_id", "isolate_norm").join(members.select("isolate_norm", "node_id"), "isolate_norm")
    rows = scratch.save(rows.select("row_pos", "node_id", "key", "value"), "rows")
    values = scratch.save(A.aggregate_rows(rows, A.infer_types(cells)).select("node_id", "key", "value"), "values")
    types = scratch.save(A.infer_schema(values), "types")
    warnings = scratch.save(A.annotation_warnings(joined, ids).where("n > 0").select(F.concat_ws(": ", "kind", F.col("n").cast("string")).alias("message")), "warnings")
    tables = {"annotations": values, "types": types, "warnings": warnings, **isolates}
    new = versions.layout_version({n: tables[n] for n in ("annotations", "types", *isolates)}, f"{dataset_id}/{version}")
    if not versions.is_published(spark, root, dataset_id, new):
        versions.write_version(tables, root, dataset_id, new)
        versions.publish(spark, root, dataset_id, new, geometry_version=versions.geometry_of(spark, root, dataset_id, version))
    return Replacement(new, rows.select("node_id").distinct().count(), warnings, types)
