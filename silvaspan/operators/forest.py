"""Forests: validation, DFS interval index, distance cuts and rerooting.

A forest is nodes (node_id), edges (edge_id, source, target, distance) that point from parent to child,
and roots (node_id, root_pos), one per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from silvaspan.operators.components import components_of_edges
from silvaspan.operators.ordering import carry_last, sum_before
from silvaspan.operators.skew import counted_join, spread_join, with_next, with_place
from silvaspan.scratch import Scratch

#: Up to this depth rows carry the path from their root; deeper forests use list ranking.
LEVELS = 16
#: A level of at most this many nodes is broadcast to the edges below it.
NARROW = 1 << 15


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node id of each node's component, itself for isolated nodes."""
    found = components_of_edges(edges, "source", "target").withColumnRenamed("node", "node_id")
    return nodes.select("node_id").distinct().join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def validate_forest(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(error, n): every kind of violation with its count; no rows for a sound forest."""
    scratch = Scratch(nodes.sparkSession, "faults")
    ids = nodes.select("node_id").distinct()
    # Edges that close no cycle by a fault of their own kind: both ends known, no loop, parallel ones once.
    sound = edges.where("source <> target").join(ids, edges["source"] == ids["node_id"], "left_semi").join(ids, edges["target"] == ids["node_id"], "left_semi")
    sound = sound.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    sound = scratch.save(sound, "sound")
    comps = scratch.save(components_of(nodes, sound), "components")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    checks = [
        ("no node", nodes.agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("n"))),
        ("duplicate node id", nodes.groupBy("node_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))),
        ("duplicate edge id", edges.groupBy("edge_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))),
        ("unknown endpoint", ends.join(ids, "node_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))),
        ("self loop", edges.where("source = target").agg(F.count(F.lit(1)).alias("n"))),
        ("parallel edge", edges.groupBy(F.least("source", "target"), F.greatest("source", "target")).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))),
        ("negative distance", edges.where("distance < 0 or isnan(distance)").agg(F.count(F.lit(1)).alias("n"))),
        ("component without exactly one root", comps.join(roots.select("node_id", F.lit(1).alias("r")), "node_id", "left").groupBy("component").agg(F.sum(F.coalesce("r", F.lit(0))).alias("r")).where("r <> 1").agg(F.count(F.lit(1)).alias("n"))),
        ("cycle", comps.agg((F.count(F.lit(1)) - F.countDistinct("component")).alias("t")).crossJoin(sound.agg(F.count(F.lit(1)).alias("e"))).select(F.when(F.col("e") > F.col("t"), F.col("e") - F.col("t")).otherwise(0).alias("n"))),
    ]
    out = None
    for error, counted in checks:
        row = counted.select(F.lit(error).alias("error"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0")


def parents_of(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, parent, edge_id, distance): roots have a null parent."""
    return edges.select(F.col("target").alias("node_id"), F.col("source").alias("parent"), "edge_id", "distance").unionByName(roots.select("node_id"), allowMissingColumns=True)


def depths_of(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(node_id, depth, component) by pointer jumping over parents: as many rounds as the logarithm of the depth; an error on a cycle."""
    n = parents.count()
    now = scratch.save(parents.select("node_id", F.coalesce("parent", "node_id").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")), "jump")
    while True:
        # Ever more rows point to the same few nodes, which are then broadcast.
        above = now.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        new = counted_join(now, above, "up", scratch, n).select("node_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        new = scratch.save(new, "jump")
        moved, deepest = new.agg(F.count_if("moved"), F.max("depth")).first()
        scratch.drop(now)
        now = new.drop("moved")
        if not moved:
            return now.select("node_id", "depth", F.col("up").alias("component"))
        if deepest > n:
            raise ValueError("the edges hold a cycle")


def paths_of(parents: DataFrame, scratch: Scratch, most: int, n: int) -> DataFrame | None:
    """(node_id, parent, root_pos, path): the nodes from the root to each of the n nodes, level by level; None if one is deeper than ``most``.

    parents has root_pos for roots. A node that no root reaches is an error. Each row is joined once, with the level above it.
    """
    level = scratch.save(parents.where("parent is null").select("node_id", "parent", "root_pos", F.array("node_id").alias("path")), "level")
    out, got = level, level.count()
    found, hung = got, parents.where("parent is not null")
    for _ in range(most):
        if not got or found == n:
            break
        above = level.select(F.col("node_id").alias("parent"), F.col("root_pos").alias("top"), F.col("path").alias("head"))
        below = hung.drop("root_pos")
        below = below.join(F.broadcast(above), "parent") if got <= NARROW else counted_join(below, above, "parent", scratch, n)
        level = scratch.save(below.select("node_id", "parent", F.col("top").alias("root_pos"), F.concat("head", F.array("node_id")).alias("path")), "level")
        got = level.count()
        found, out = found + got, out.unionByName(level)
    if found == n:
        return out
    if not got or hung.join(parents.select(F.col("node_id").alias("parent")), "parent", "left_anti").limit(1).count():
        raise ValueError("an edge is reached from no root, or reaches a node again")
    return None


def _parents(edges: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The stored (node_id, parent, root_pos) of all nodes, and their number; a node with two rows is an error."""
    hung = edges.select(F.col("target").alias("node_id"), F.col("source").alias("parent"), F.lit(None).cast("long").alias("root_pos"))
    parents = scratch.save(hung.unionByName(roots.select("node_id", F.lit(None).cast("string").alias("parent"), F.col("root_pos").cast("long").alias("root_pos"))), "parents")
    n, kinds = parents.agg(F.count(F.lit(1)), F.count_distinct("node_id")).first()
    if n > kinds:
        raise ValueError("a node has two parents, or a root has one")
    return parents, n


def forest_paths(edges: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(node_id, depth, path) of all nodes, without their order; None for a forest deeper than ``LEVELS``. Faults are the errors of index_forest."""
    scratch = Scratch(edges.sparkSession, "index")
    parents, n = _parents(edges, roots, scratch)
    paths = paths_of(parents, scratch, LEVELS, n)
    return None if paths is None else paths.select("node_id", (F.size("path") - 1).cast("long").alias("depth"), "path")


def index_forest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, component, parent, depth, dfs_start, dfs_end): half-open preorder intervals over the whole forest.

    Children come in the order of their ids, components in the order of root_pos. A node lies in the subtree
    of x exactly if its start lies in x's interval. An edge that no root reaches, or that reaches a node
    again, is an error.

    The preorder is the order of the paths from the roots: rows are dealt by ranges of it and numbered, so neither a root nor
    a node of many children is one task, and nothing is joined on the root. Forests deeper than ``LEVELS`` have no paths; their Euler
    tour is ranked.
    """
    scratch = Scratch(edges.sparkSession, "index")
    parents, n = _parents(edges, roots, scratch)
    paths = paths_of(parents, scratch, LEVELS, n)
    if paths is None:
        return _index_by_ranking(parents, scratch, n)
    sizes = paths.select(F.explode("path").alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = with_place(paths, ["root_pos", "path"], "dfs_start", scratch)
    stop = F.col("dfs_start") + F.coalesce("size", F.lit(1))
    return placed.join(sizes, "node_id", "left").select("node_id", F.get("path", F.lit(0)).alias("component"), "parent", (F.size("path") - 1).cast("long").alias("depth"), F.col("dfs_start").cast("long").alias("dfs_start"), stop.cast("long").alias("dfs_end"))


def _index_by_ranking(parents: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """The Euler tour of down and up arcs, ranked by pointer doubling: as many rounds as the logarithm of its length."""
    rows = scratch.save(parents.select("node_id", "parent").join(depths_of(parents, scratch), "node_id"), "depths")
    kids = with_next(rows.where("parent is not null").select("parent", "node_id"), "parent", "node_id", "sibling", scratch)
    first = kids.where("first").select(F.col("parent").alias("node_id"), F.col("node_id").alias("child"))
    at = rows.select("node_id", "parent").join(kids.select("node_id", "sibling"), "node_id", "left").join(first, "node_id", "left")
    down, up = (lambda c: F.concat(F.lit("d"), c)), (lambda c: F.concat(F.lit("u"), c))
    arcs = at.select(down(F.col("node_id")).alias("arc"), F.coalesce(down(F.col("child")), up(F.col("node_id"))).alias("next"), F.lit(1).cast("long").alias("n"))
    ups = at.select(up(F.col("node_id")).alias("arc"), F.coalesce(down(F.col("sibling")), up(F.col("parent"))).alias("next"), F.lit(0).cast("long").alias("n"))
    now = scratch.save(arcs.unionByName(ups), "arcs")
    while now.where("next is not null").limit(1).count():
        # The arcs that have reached the end of their tour stay; no two others have the same next.
        jump = now.select(F.col("arc").alias("next"), F.col("next").alias("then"), F.col("n").alias("more"))
        moved = now.where("next is not null").join(jump, "next").select("arc", F.col("then").alias("next"), (F.col("n") + F.col("more")).alias("n"))
        new = scratch.save(now.where("next is null").unionByName(moved), "arcs")
        scratch.drop(now)
        now = new
    # n: down arcs from here to the end of the tour.
    d = now.where("arc like 'd%'").select(F.expr("substring(arc, 2)").alias("node_id"), F.col("n").alias("from_down"))
    u = now.where("arc like 'u%'").select(F.expr("substring(arc, 2)").alias("node_id"), F.col("n").alias("from_up"))
    ranked = scratch.save(rows.join(d, "node_id").join(u, "node_id"), "ranked")
    order = ranked.where("parent is null").select("component", F.col("from_down").alias("total")).join(parents.where("parent is null").select(F.col("node_id").alias("component"), "root_pos"), "component")
    order = scratch.save(sum_before(order, ["root_pos", "component"], "total", "base"), "order")
    found = spread_join(ranked, order, "component", "total", n)
    start = F.col("base") + F.col("total") - F.col("from_down")
    return found.select("node_id", "component", "parent", "depth", start.cast("long").alias("dfs_start"), (start + F.col("from_down") - F.col("from_up")).cast("long").alias("dfs_end"))


def cut_forest(edges: DataFrame, index: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """Edges of at most cutoff, and the roots of what is left: the old ones and the severed children, in DFS order."""
    if isinstance(cutoff, bool) or not 0 <= cutoff < float("inf"):
        raise ValueError("the cutoff is a finite number of at least 0")
    unknown = edges.where("distance is null").limit(1).count()
    if unknown:
        raise ValueError("a distance cut needs all distances")
    kept = edges.where(F.col("distance") <= cutoff)
    cut = edges.where(F.col("distance") > cutoff).select(F.col("target").alias("node_id"))
    roots = index.where("parent is null").select("node_id", "dfs_start").unionByName(index.join(cut, "node_id", "left_semi").where("parent is not null").select("node_id", "dfs_start"))
    return kept, roots.select("node_id", F.col("dfs_start").alias("root_pos"))


def reroot(edges: DataFrame, index: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, roots, moved): the component of node_id hung up at it; moved maps old to new component.

    Only the edges between the node and its old root turn round: those whose target's interval holds the node.
    """
    at = index.where(F.col("node_id") == node_id).select(F.col("component").alias("c"), F.col("dfs_start").alias("s"))
    path = index.join(F.broadcast(at), (F.col("component") == F.col("c")) & (F.col("dfs_start") <= F.col("s")) & (F.col("s") < F.col("dfs_end"))).select(F.col("node_id").alias("target"), F.lit(True).alias("turn"))
    turned = edges.join(path, "target", "left").select(
        "edge_id", F.when(F.col("turn"), F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("turn"), F.col("source")).otherwise(F.col("target")).alias("target"), "distance"
    )
    old = index.where("parent is null").select("node_id", F.col("dfs_start").alias("root_pos"), "component")
    roots = old.join(F.broadcast(at), F.col("component") == F.col("c"), "left").select(F.when(F.col("c").isNotNull(), F.lit(node_id)).otherwise(F.col("node_id")).alias("node_id"), "root_pos")
    moved = at.select(F.col("c").alias("old_component"), F.lit(node_id).alias("new_component"))
    return turned, roots, moved


def rerooted_index(index: DataFrame, node_id: str) -> DataFrame:
    """The index of the whole forest after the component of node_id is hung up at it, equal to a new index of the turned edges.

    Only that component's rows change. The nodes from node_id to the old root change places; every subtree that hangs from them keeps
    its inner order, so all its intervals move by one offset, which its first row hands on in the old preorder.
    """
    scratch = Scratch(index.sparkSession, "rehung")
    at = index.where(F.col("node_id") == node_id).select("component", "dfs_start", "depth").first()
    if at is None:
        raise ValueError("a root is a node of the forest")
    mine, others = index.where(F.col("component") == at["component"]), index.where(F.col("component") != at["component"])
    size = F.col("dfs_end") - F.col("dfs_start")
    on_path = (F.col("dfs_start") <= at["dfs_start"]) & (F.col("dfs_end") > at["dfs_start"])
    # step: 0 for the new root, counted up to the old one.
    path = scratch.save(mine.where(on_path).select("node_id", "dfs_start", (F.lit(at["depth"]) - F.col("depth")).alias("step"), size.alias("size")), "path")
    base, total = mine.where("parent is null").select("dfs_start", size.alias("size")).first()
    # Below a path node now stand its other children and the path node above it, with all that hangs there.
    kids = mine.where(~on_path).join(path.select(F.col("node_id").alias("parent"), "step"), "parent").select("step", "node_id", size.alias("size"))
    turned = path.select((F.col("step") + 1).alias("step"), "size").join(path.select("step", "node_id"), "step").select((F.col("step") - 1).alias("step"), "node_id", (F.lit(total) - F.col("size")).alias("size"), F.lit(True).alias("on"))
    order = scratch.save(sum_before(kids.withColumn("on", F.lit(False)).unionByName(turned), ["step", "node_id"], "size", "before"), "order")
    first = order.groupBy("step").agg(F.min("before").alias("first"))
    # offset: of a child's start from its parent's.
    offsets = scratch.save(order.join(first, "step").select("step", "node_id", "on", (F.col("before") - F.col("first") + 1).alias("offset")), "offsets")
    steps = offsets.where("on").select((F.col("step") + 1).alias("step"), "node_id", "offset").unionByName(path.where("step = 0").select("step", "node_id", F.lit(0).cast("long").alias("offset")))
    starts = scratch.save(sum_before(steps, ["step"], "offset", "sum").select("step", "node_id", (F.col("sum") + F.col("offset") + base).alias("start")), "starts")
    above = starts.select((F.col("step") + 1).alias("step"), F.col("node_id").alias("new_parent"))
    shifts = offsets.where("not on").join(starts.select("step", F.col("start").alias("top")), "step").select("node_id", (F.col("top") + F.col("offset")).alias("start"), (F.col("step") + 1).alias("new_depth"))
    hung = mine.where(~on_path).join(shifts, "node_id", "left")
    moved = carry_last(hung, "dfs_start", F.when(F.col("start").isNotNull(), F.struct((F.col("start") - F.col("dfs_start")).alias("by"), (F.col("new_depth") - F.col("depth")).alias("down"))), "move")
    name = F.lit(node_id).alias("component")
    rest = moved.select("node_id", name, "parent", (F.col("depth") + F.col("move.down")).cast("long").alias("depth"), (F.col("dfs_start") + F.col("move.by")).alias("dfs_start"), (F.col("dfs_end") + F.col("move.by")).alias("dfs_end"))
    below = path.select((F.col("step") + 1).alias("step"), F.col("size").alias("taken"))
    spine = starts.join(above, "step", "left").join(below, "step", "left")
    spine = spine.select("node_id", name, F.col("new_parent").alias("parent"), F.col("step").cast("long").alias("depth"), F.col("start").cast("long").alias("dfs_start"), (F.col("start") + F.lit(total) - F.coalesce("taken", F.lit(0))).cast("long").alias("dfs_end"))
    return others.select(*spine.columns).unionByName(rest).unionByName(spine)
