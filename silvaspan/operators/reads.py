"""Batched reads of a prepared forest. A request is a row, and a batch of requests is one job.

nodes: (node_id, x, y, …); edges: (edge_id, source, target, distance); clusters with boxes:
(level, cluster_id, representative, members, x0, x1, y0, y1); requests: (request_id, x0, x1, y0, y1, …).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from silvaspan.operators.ordering import carry_last, carry_max
from silvaspan.scratch import Scratch


def filter_annotations(df: DataFrame, accepted: dict[str, list[str]] | None = None, ranges: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Rows that match every active field: listed texts (an empty list is inactive), inclusive numeric bounds; null never matches."""
    tests = [F.coalesce(F.col(k).cast("string").isin(v), F.lit(False)) for k, v in (accepted or {}).items() if v]
    for k, (lo, hi) in (ranges or {}).items():
        number = F.col(k).try_cast("double")
        tests.append(F.coalesce(number.isNotNull() & (number >= lo if lo is not None else F.lit(True)) & (number <= hi if hi is not None else F.lit(True)), F.lit(False)))
    return df.where(reduce(Column.__and__, tests)) if tests else df


def in_box(x: Column, y: Column) -> Column:
    return x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1"))


def overlaps_box() -> Column:
    return (F.col("x0") <= F.col("bx1")) & (F.col("x1") >= F.col("bx0")) & (F.col("y0") <= F.col("by1")) & (F.col("y1") >= F.col("by0"))


def boxes(requests: DataFrame, *more: str) -> DataFrame:
    return requests.select("request_id", *(F.col(c).alias("b" + c) for c in ("x0", "x1", "y0", "y1")), *more)


def _grid(requests: DataFrame) -> dict[str, float]:
    """Corner and cell sides of a grid: a quarter of a request's mean sides. A driver-side row of four numbers."""
    row = requests.agg(F.min("x0").alias("cx"), F.min("y0").alias("cy"), F.avg(F.col("x1") - F.col("x0")).alias("w"), F.avg(F.col("y1") - F.col("y0")).alias("h")).first()
    return {"x": row["cx"] or 0.0, "y": row["cy"] or 0.0, "w": (row["w"] or 0) / 4 or 1.0, "h": (row["h"] or 0) / 4 or 1.0}


def _scaled(df: DataFrame, x0: str, x1: str, y0: str, y1: str, grid: dict[str, float]) -> DataFrame:
    """df with ``own``: by how many doublings of the grid's cell a box stands in some 36 cells at most."""
    wide = F.greatest((F.col(x1) - F.col(x0)) / grid["w"], (F.col(y1) - F.col(y0)) / grid["h"], F.lit(1.0))
    return df.withColumn("own", F.greatest(F.lit(0), F.ceil(F.log2(wide)) - 2).cast("int"))


def _scales(df: DataFrame) -> list[int]:
    """The doublings in use, of which a double has room for some two thousand, and data for a few."""
    return sorted(r["own"] for r in df.select("own").distinct().collect())


def _placed(df: DataFrame, x0: str, x1: str, y0: str, y1: str, scales: list[int], grid: dict[str, float]) -> DataFrame:
    """One row for each of the scales from its own on, and each cell (cx, cy) there that a box touches."""
    rows = df.withColumn("scale", F.explode(F.filter(F.array(*map(F.lit, scales)), lambda s: s >= F.col("own"))))
    for c, lo, hi, corner, side in (("cx", x0, x1, grid["x"], grid["w"]), ("cy", y0, y1, grid["y"], grid["h"])):
        size = F.lit(side) * F.pow(F.lit(2.0), F.col("scale"))
        first, last = F.floor((F.col(lo) - corner) / size), F.floor((F.col(hi) - corner) / size)
        rows = rows.withColumn(c, F.explode(F.sequence(first, F.greatest(first, last))))
    return rows


def points_in_boxes(requests: DataFrame, points: DataFrame, *more: str) -> DataFrame:
    """(request_id, more, columns of points): the points (x, y, ...) in every box.

    Both sides meet on the cells of a grid, then the test is exact. A box takes cells of the scale of its own size, a
    point stands in one cell of every scale in use.
    """
    grid = _grid(requests)
    asked = _scaled(boxes(requests, *more), "bx0", "bx1", "by0", "by1", grid)
    scales = _scales(asked)
    if not scales:
        return boxes(requests, *more).crossJoin(points.limit(0)).select("request_id", *more, *points.columns)
    asked = _placed(asked, "bx0", "bx1", "by0", "by1", scales, grid).where("scale = own").drop("own")
    placed = _placed(points.where("x is not null and y is not null").withColumn("own", F.lit(0)), "x", "x", "y", "y", scales, grid).drop("own")
    return asked.join(placed, ["scale", "cx", "cy"]).where(in_box(F.col("x"), F.col("y"))).select("request_id", *more, *points.columns)


def boxes_overlapping(requests: DataFrame, boxed: DataFrame, *more: str) -> DataFrame:
    """(request_id, more, columns of boxed): the boxes (x0, x1, y0, y1, ...) that overlap every request, once each.

    Both sides meet on the cells of a grid, at the scale of the larger of the two, so neither stands in many
    cells; a pair counts in the cell that holds the lower corner of what both share.
    """
    grid = _grid(requests)
    asked, own = _scaled(boxes(requests, *more), "bx0", "bx1", "by0", "by1", grid), _scaled(boxed.where("x0 is not null and y0 is not null"), "x0", "x1", "y0", "y1", grid)
    scales = sorted({*_scales(asked), *_scales(own)})
    if not scales:
        return boxes(requests, *more).crossJoin(boxed.limit(0)).select("request_id", *more, *boxed.columns)
    asked = _placed(asked, "bx0", "bx1", "by0", "by1", scales, grid).withColumnRenamed("own", "asked_own")
    hit = asked.join(_placed(own, "x0", "x1", "y0", "y1", scales, grid), ["scale", "cx", "cy"]).where(overlaps_box() & (F.col("scale") == F.greatest("own", "asked_own")))
    size = F.pow(F.lit(2.0), F.col("scale"))
    first = (F.col("cx") == F.floor((F.greatest("bx0", "x0") - grid["x"]) / (F.lit(grid["w"]) * size))) & (F.col("cy") == F.floor((F.greatest("by0", "y0") - grid["y"]) / (F.lit(grid["h"]) * size)))
    return hit.where(first).select("request_id", *more, *boxed.columns)


def scope(df: DataFrame, index: DataFrame, component: str, key: str = "node_id") -> DataFrame:
    """Rows of one component, before any limit."""
    return df.join(index.where(F.col("component") == component).select(F.col("node_id").alias(key)), key, "left_semi")


def ordered_slice(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """df cut to the first rows of each key, with ``total`` before the cut and ``truncated``.

    Totals are summed up apart, so the ranking is nothing but a limit: each task hands on ``limit`` rows of a key at most.
    """
    rows = Scratch(df.sparkSession, "slice").save(df, "rows")
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= limit).drop("_k")
    return first.join(totals, keys).select(*df.columns, "total", (F.col("total") > limit).alias("truncated"))


def focus_first(node_id: str) -> list[Column]:
    return [F.when(F.col("node_id") == node_id, 0).otherwise(1).asc(), F.col("node_id").asc()]


def require_at_most(df: DataFrame, rows: int) -> DataFrame:
    """df, or an error if it has more rows: nothing is cut silently."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows")
    return df


def require_same_ids(a: DataFrame, b: DataFrame, key: str = "node_id") -> None:
    found = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer").where("a is null or b is null").limit(1).count()
    if found:
        raise ValueError(f"the sets of {key} differ")


def internal_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids (request_id, node_id), per request."""
    return edges.join(ids.select("request_id", F.col("node_id").alias("source")), "source").join(ids.select("request_id", F.col("node_id").alias("target")), ["request_id", "target"])


def touching_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ids, once per request: two joins and a union instead of one join on either end."""
    a = edges.join(ids.select("request_id", F.col("node_id").alias("source")), "source")
    b = edges.join(ids.select("request_id", F.col("node_id").alias("target")), "target")
    return a.unionByName(b).dropDuplicates(["request_id", "edge_id"])


def one_hop(edges: DataFrame, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, node columns): positioned neighbours of ids outside ids."""
    ends = touching_edges(edges, ids).select("request_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return ends.join(ids, ["request_id", "node_id"], "left_anti").join(nodes, "node_id")


def represented_nodes(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, node_id): ids and all their neighbours, once each."""
    around = touching_edges(edges, ids).select("request_id", F.explode(F.array("source", "target")).alias("node_id"))
    return ids.select("request_id", "node_id").unionByName(around).distinct()


def viewport_detail(requests: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes in the box and all their neighbours (flag ``inside``: shown for themselves), and per request all edges that touch a node inside, with both ends shown.

    ``total`` counts the nodes in the box before the limit and the shown neighbours outside it.
    """
    scratch = Scratch(nodes.sparkSession, "viewport")
    inside = scratch.save(ordered_slice(points_in_boxes(requests, nodes), ["request_id"], [F.col("node_id")], limit), "inside")
    ids = inside.select("request_id", "node_id")
    around = scratch.save(one_hop(edges, ids, nodes).select("request_id", *nodes.columns), "around")
    outside = around.join(boxes(requests), "request_id").where(~in_box(F.col("x"), F.col("y"))).groupBy("request_id").agg(F.count(F.lit(1)).alias("_more"))
    inside = inside.join(outside, "request_id", "left").withColumn("total", F.col("total") + F.coalesce("_more", F.lit(0))).drop("_more")
    shown = inside.select("request_id", *nodes.columns, F.lit(True).alias("inside"), "total", "truncated").unionByName(around.withColumn("inside", F.lit(False)), allowMissingColumns=True)
    ends = shown.select("request_id", "node_id").distinct()
    links = touching_edges(edges, ids)
    for end in ("source", "target"):
        links = links.join(ends.withColumnRenamed("node_id", end), ["request_id", end], "left_semi")
    return shown, links


def viewport_coarse(requests: DataFrame, boxed: DataFrame, quotient: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Representatives of the request's level that overlap its box, largest first, and the quotient edges among them."""
    asked = requests.withColumn("asked", F.col("level"))
    hit = boxes_overlapping(asked, boxed, "asked").where(F.col("asked") == F.col("level")).select("request_id", "level", "cluster_id", "representative", "members")
    shown = ordered_slice(hit, ["request_id"], [F.col("members").desc(), F.col("cluster_id")], limit)
    ids = shown.select("request_id", "level", F.col("representative").alias("node_id"))
    a, b = ids.withColumnRenamed("node_id", "source"), ids.withColumnRenamed("node_id", "target")
    return shown, quotient.join(a, ["level", "source"]).join(b, ["request_id", "level", "target"])


def viewport_expand(requests: DataFrame, clusters: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of each asked (request_id, cluster_id, focus), their inner edges, and the boundary edge to the representative outside."""
    members = requests.join(clusters, "cluster_id").join(nodes, "node_id")
    shown = ordered_slice(members, ["request_id"], [F.when(F.col("node_id") == F.col("focus"), 0).otherwise(1), F.col("node_id")], limit)
    ids = shown.select("request_id", "node_id")
    inner = internal_edges(edges, ids)
    return shown, inner, expansion_boundary(requests, clusters, edges).join(ids.withColumnRenamed("node_id", "inner"), ["request_id", "inner"], "left_semi")


def expansion_boundary(requests: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, inner, outer, outer_representative, distance): edges from the asked cluster to a node outside it, and that node's representative at the same level."""
    # Only edges between two clusters of a tier can leave one: these few are found first, by a join at each end, for all requests together.
    a = clusters.select("level", F.col("node_id").alias("source"), F.col("cluster_id").alias("sc"), F.col("representative").alias("sr"))
    b = clusters.select("level", F.col("node_id").alias("target"), F.col("cluster_id").alias("tc"), F.col("representative").alias("tr"))
    between = edges.select("source", "target", "distance").join(a, "source").join(b, ["level", "target"]).where("sc <> tc")
    between = Scratch(edges.sparkSession, "boundary").save(between, "between")
    side = lambda x, xc, y, yr: between.select(F.col(xc).alias("cluster_id"), F.col(x).alias("inner"), F.col(y).alias("outer"), F.col(yr).alias("outer_representative"), "distance")
    out = requests.select("request_id", "cluster_id").join(side("source", "sc", "target", "tr").unionByName(side("target", "tc", "source", "sr")), "cluster_id")
    # A request may ask for several clusters; what lies in any of them is not outside.
    inside = out.select("request_id", "outer").distinct().join(clusters.select(F.col("node_id").alias("outer"), "cluster_id"), "outer")
    inside = inside.join(requests.select("request_id", "cluster_id"), ["request_id", "cluster_id"], "left_semi").select("request_id", "outer")
    return out.join(inside, ["request_id", "outer"], "left_anti").select("request_id", "inner", "outer", "outer_representative", "distance")


def boundary_faults(requests: DataFrame, clusters: DataFrame, edges: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """(request_id, n): asked clusters of several members that do not have exactly one edge to the outside; ``boundary`` is their expansion_boundary where it is known."""
    size = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("m"))
    boundary = expansion_boundary(requests, clusters, edges) if boundary is None else boundary
    found = boundary.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    rows = requests.join(size, "cluster_id").where("m > 1").join(found, "request_id", "left")
    return rows.select("request_id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def clusters_of_component(requests: DataFrame, clusters: DataFrame, index: DataFrame) -> DataFrame:
    """requests (request_id, cluster_id, component), or an error if a cluster is not of the component it is asked in."""
    homes = clusters.select("cluster_id", F.col("representative").alias("node_id")).distinct().join(index.select("node_id", F.col("component").alias("home")), "node_id").select("cluster_id", "home")
    lost = requests.join(homes, "cluster_id", "left").where("home is null or home <> component")
    if lost.limit(1).count():
        raise ValueError("a cluster is not in the component it is asked in")
    return requests


def read_region(requests: DataFrame, nodes: DataFrame, edges: DataFrame, numeric: str, category: str, limit: int | None = None, owners: DataFrame | None = None) -> DataFrame:
    """(request_id, nodes, total, truncated, edges, mean, mode, counts): what is shown of each box, aggregated.

    With a limit the first nodes by id are shown, and edges, mean, mode and counts are theirs; total counts the box. With owners (node_id, component) a request's
    component, where it names one, comes before the limit. counts: a map of each category to its nodes.
    """
    scratch = Scratch(nodes.sparkSession, "region")
    more = ["component"] if owners is not None else []
    hit = points_in_boxes(requests, nodes, *more)
    if owners is not None:
        hit = hit.join(owners.select("node_id", F.col("component").alias("_home")), "node_id").where("component is null or component = _home").drop("_home")
    hit = scratch.save(hit if limit is None else ordered_slice(hit, ["request_id"], [F.col("node_id")], limit), "hit")
    total = F.count(F.lit(1)) if limit is None else F.max("total")
    shown = hit.groupBy("request_id").agg(F.count(F.lit(1)).alias("nodes"), total.alias("total"), F.round(F.avg(numeric), 6).alias("mean"))
    kinds = hit.where(F.col(category).isNotNull()).groupBy("request_id", category).agg(F.count(F.lit(1)).alias("n"))
    modes = kinds.groupBy("request_id").agg(F.min_by(category, F.struct(-F.col("n"), F.col(category))).alias("mode"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "n")))).alias("counts"))
    inner = internal_edges(edges, hit.select("request_id", "node_id")).groupBy("request_id").agg(F.count(F.lit(1)).alias("edges"))
    rows = requests.select("request_id").join(shown, "request_id", "left").join(inner, "request_id", "left").join(modes, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("request_id", zero("nodes"), zero("total"), (F.coalesce("total", F.lit(0)) > F.coalesce("nodes", F.lit(0))).alias("truncated"), zero("edges"), "mean", "mode", "counts")


def component_boxes(index: DataFrame, positions: DataFrame) -> DataFrame:
    """(component, nodes, dfs_start, x0, x1, y0, y1) of every component."""
    rows = index.join(positions.select("node_id", "x", "y"), "node_id", "left")
    return rows.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.min("dfs_start").alias("dfs_start"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def component_page(components: DataFrame, after: int, limit: int) -> tuple[DataFrame, int | None]:
    """The next components by dfs_start, and the cursor of the page behind, if there is one."""
    if not 1 <= limit <= 200:
        raise ValueError("a page has 1 to 200 components")
    rows = components.where(F.col("dfs_start") > after).orderBy("dfs_start").limit(limit + 1)
    last = rows.select("dfs_start").collect()
    return rows.limit(limit), last[limit - 1][0] if len(last) > limit else None


def representation_counts(requests: DataFrame, boxed: DataFrame, nodes: DataFrame, edges: DataFrame, ceiling: int | None = None, apart: bool = False) -> DataFrame:
    """(request_id, level, n): what each tier up to the ceiling would show in each box.

    A tier shows its clusters that overlap the box; tiers with a cluster without a place are left out. The finest tier of all shows full
    detail, so it counts the nodes in the box and all their placed neighbours, wherever these lie: a hub in
    the box makes it dear. Above the ceiling nothing is counted, the finest tier neither. With apart, full detail
    is a row of level -1 besides the clusters of every tier, whatever the ceiling.
    """
    tiers = boxed.groupBy("level").agg((F.count("x0") == F.count(F.lit(1))).alias("whole"))
    # One row per tier: few.
    tiers = tiers.agg(F.collect_list(F.struct("level", "whole")).alias("t")).first()["t"]
    finest = max((t["level"] for t in tiers), default=None)
    counted = sorted(t["level"] for t in tiers if t["whole"] and (ceiling is None or t["level"] <= ceiling))
    coarse, out = [t for t in counted if apart or t != finest], requests.select("request_id").where("false").select("request_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("n"))
    if coarse:
        asked = requests.select("request_id", F.explode(F.array(*map(F.lit, coarse))).alias("level"))
        found = boxes_overlapping(requests, boxed.where(F.col("level").isin(coarse))).groupBy("request_id", "level").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(asked.join(found, ["request_id", "level"], "left").select("request_id", F.col("level").cast("int").alias("level"), F.coalesce("n", F.lit(0)).alias("n")))
    if apart or finest in counted:
        detail = -1 if apart else finest
        ids = Scratch(nodes.sparkSession, "detail").save(points_in_boxes(requests, nodes).select("request_id", "node_id"), "ids")
        fine = represented_nodes(ids, edges).join(nodes.select("node_id"), "node_id", "left_semi").groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(requests.select("request_id").join(fine, "request_id", "left").select("request_id", F.lit(detail).cast("int").alias("level"), F.coalesce("n", F.lit(0)).alias("n")))
    return out


def choose_tier(counts: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, level): the finest tier whose cost fits the request's target, else the coarsest; the preferred one where no tier is counted.

    A tier ahead of the preferred one costs twice as much per step. A previous tier of at most 1.15 times
    the target yields to no coarser one, and to a finer one only if that costs at most 0.85 of the target: then to the finest such.
    """
    if requests.where("target < 1").limit(1).count():
        raise ValueError("a target is positive")
    asked = requests.select("request_id", "preferred", "target", "previous")
    rows = counts.where("level >= 0").join(asked, "request_id")
    cost = F.col("n") * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("level") - F.col("preferred")))
    each = rows.select("request_id", "level", "previous", "target", cost.alias("cost"))
    got = each.groupBy("request_id").agg(
        F.max(F.when(F.col("cost") <= F.col("target"), F.col("level"))).alias("fit"), F.min("level").alias("coarsest"),
        F.max(F.when((F.col("level") == F.col("previous")) & (F.col("cost") <= 1.15 * F.col("target")), F.col("level"))).alias("kept"),
        F.max(F.when((F.col("level") > F.col("previous")) & (F.col("cost") <= 0.85 * F.col("target")), F.col("level"))).alias("finer"),
    )
    chosen = F.coalesce("fit", "coarsest")
    level = F.when(F.col("kept").isNull() | (chosen == F.col("kept")), chosen).when(chosen < F.col("kept"), F.col("kept")).otherwise(F.coalesce("finer", "kept"))
    found = got.select("request_id", level.alias("level"))
    return asked.join(found, "request_id", "left").select("request_id", F.coalesce("level", "preferred").cast("int").alias("level"))


def outer_cover(folds: DataFrame) -> DataFrame:
    """Folds (component, node_id, dfs_start, dfs_end) that lie in no other one; the preorder runs through all components."""
    return carry_max(folds, "dfs_start", "dfs_end", "_end").where("_end is null or dfs_start >= _end").drop("_end")


def apply_folds(index: DataFrame, folds: DataFrame) -> DataFrame:
    """(node_id, hidden_by, hidden): nodes strictly inside a folded subtree are hidden; a folded root keeps their number.

    Folds and nodes are merged in preorder: the last outer fold that started at or before a node is the only one that can hold it.
    """
    cover = outer_cover(folds).select(F.col("dfs_start"), F.col("dfs_end").alias("f1"), F.col("node_id").alias("fold")).dropDuplicates(["dfs_start"])
    rows = index.select("node_id", "dfs_start").join(cover, "dfs_start", "left")
    rows = carry_last(rows, "dfs_start", F.when(F.col("fold").isNotNull(), F.struct("fold", "f1")), "last")
    inside = F.col("last").isNotNull() & (F.col("dfs_start") < F.col("last.f1")) & (F.col("node_id") != F.col("last.fold"))
    return rows.select("node_id", F.when(inside, F.col("last.fold")).alias("hidden_by"), F.when(F.col("fold").isNotNull(), F.col("f1") - F.col("dfs_start") - 1).alias("hidden"))


def reveal(folds: DataFrame, index: DataFrame, target: str) -> DataFrame:
    """folds without those that hold the target strictly inside."""
    at = index.where(F.col("node_id") == target).select(F.col("component").alias("c"), F.col("dfs_start").alias("s"))
    return folds.join(F.broadcast(at), (F.col("component") == F.col("c")) & (F.col("dfs_start") < F.col("s")) & (F.col("s") < F.col("dfs_end")), "left_anti")


def fold_roots(index: DataFrame) -> DataFrame:
    """One fold per component, at its root."""
    return index.where("parent is null").select("component", "node_id", "dfs_start", "dfs_end")


def collapse(folds: DataFrame, index: DataFrame, node_id: str) -> DataFrame:
    """folds and that of one node with nodes below it."""
    more = index.where((F.col("node_id") == node_id) & (F.col("dfs_end") - F.col("dfs_start") > 1)).select(*folds.columns)
    return folds.where(F.col("node_id") != node_id).unionByName(more)


def collapse_roots(folds: DataFrame, index: DataFrame) -> DataFrame:
    """folds and those of all roots with nodes below them."""
    more = fold_roots(index).where("dfs_end - dfs_start > 1").select(*folds.columns)
    return folds.join(more.select("node_id"), "node_id", "left_anti").select(*folds.columns).unionByName(more)


def unfold(folds: DataFrame, node_id: str) -> DataFrame:
    """folds without that of one node."""
    return folds.where(F.col("node_id") != node_id)


def delta_annotations(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows with ``cached``; what the caller knows comes without its values."""
    out = rows.join(known.select(key, F.lit(True).alias("cached")), key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return out.select(*(F.when(~F.col("cached"), F.col(c)).alias(c) if c != key else F.col(c) for c in rows.columns), "cached")


def merge_delta(delta: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The caller's side of ``delta_annotations``: rows that came without values take them from what the caller knows, all others as they came."""
    held = known.select(F.col(key).alias("_key"), F.struct(*(c for c in delta.columns if c not in (key, "cached"))).alias("_held"))
    rows = delta.join(held, F.col(key) == F.col("_key"), "left")
    return rows.select(*(F.col(c) if c == key else F.when(F.col("cached"), F.col(f"_held.{c}")).otherwise(F.col(c)).alias(c) for c in delta.columns if c != "cached"))


def visible_connections(connections: DataFrame, visible: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """connections with both ends visible, and with owners (node_id, component) of one component.

    Nodes that stand for a cluster or a folded branch (columns ``grouped`` and ``folded`` of visible, where it has them) are no ends.
    """
    for flag in ("grouped", "folded"):
        if flag in visible.columns:
            visible = visible.where(~F.coalesce(flag, F.lit(False)))
    ids = visible.select("node_id").distinct()
    rows = connections.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    if owners is None:
        return rows
    a, b = owners.select(F.col("node_id").alias("source"), F.col("component").alias("_a")), owners.select(F.col("node_id").alias("target"), F.col("component").alias("_b"))
    return rows.join(a, "source").join(b, "target").where("_a = _b").select(*connections.columns)


def connection_counts(connections: DataFrame, shown: DataFrame) -> DataFrame:
    """One row (total, visible): how many connections there are, and how many are shown."""
    return connections.agg(F.count(F.lit(1)).alias("total")).crossJoin(shown.agg(F.count(F.lit(1)).alias("visible")))


def compose_expansion(base: tuple[DataFrame, DataFrame], patches: tuple[DataFrame, DataFrame], budget: int, priority: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a view after clusters were expanded in it.

    Nodes (node_id, cluster_id, proxy, pos, ...) and edges (edge_id, source, target, ...); those of patches also have ``patch``, their order,
    and their edges ``boundary``. A patch's node takes the place of another one of its id, a proxy only where none is; later patches win. A proxy of a
    cluster of which some patch shows members goes. Base edges between the ends of a boundary edge give way to it. Of more nodes than
    the budget the priority node stays, then base nodes and new ones in their order; ``partial`` says so. Edges keep both ends.
    """
    scratch = Scratch(base[0].sparkSession, "compose")
    old, new = base[0].withColumn("patch", F.lit(-1)), patches[0]
    columns = [c for c in old.columns]
    order = F.struct(F.col("patch") >= 0, "patch", "pos")
    held = old.unionByName(new.join(old.select("node_id"), "node_id", "left_anti").unionByName(new.where(~F.col("proxy")).join(old.select("node_id"), "node_id", "left_semi")).select(*columns))
    # The last that isn't a proxy, else the first; the place is that of the first of all.
    rank = F.struct((~F.col("proxy") & (F.col("patch") >= 0)).alias("fresh"), F.when(F.col("proxy"), -F.col("patch")).otherwise(F.col("patch")).alias("p"))
    one = held.groupBy("node_id").agg(F.max_by(F.struct(*columns), rank).alias("x"), F.min(order).alias("_order")).select("x.*", "_order")
    detailed = new.where(~F.col("proxy") & F.col("cluster_id").isNotNull()).select("cluster_id").distinct().withColumn("_gone", F.lit(True))
    left = one.join(detailed, "cluster_id", "left").where(~F.col("proxy") | F.col("_gone").isNull())
    left = scratch.save(left, "left")
    nodes = left.orderBy(F.when(F.col("node_id") == priority, 0).otherwise(1), "_order", "node_id").limit(budget).withColumn("partial", F.lit(left.count() > budget))
    nodes = scratch.save(nodes.drop("_order", "_gone", "patch").select("node_id", "cluster_id", "proxy", *(c for c in columns if c not in ("node_id", "cluster_id", "proxy", "patch")), "partial"), "nodes")
    ends = lambda df: df.select(F.least("source", "target").alias("_s"), F.greatest("source", "target").alias("_t"))
    met = patches[1].where("boundary")
    kept = base[1].withColumn("_s", F.least("source", "target")).withColumn("_t", F.greatest("source", "target")).join(ends(met).distinct(), ["_s", "_t"], "left_anti").drop("_s", "_t")
    names = kept.columns
    every = kept.withColumn("patch", F.lit(-1)).unionByName(patches[1].select(*names, "patch"))
    edges = every.groupBy("edge_id").agg(F.max_by(F.struct(*names), "patch").alias("x")).select("x.*")
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return nodes, edges.select(*names)


def select_target(df: DataFrame, middle: float | None = None, cluster_id: str | None = None) -> DataFrame:
    """The cluster of this id; else the one whose size is nearest to the geometric middle, ties by level and id; else the one of the smallest id."""
    if cluster_id is not None:
        return df.where(F.col("cluster_id") == cluster_id).limit(1)
    order = F.struct("cluster_id") if middle is None else F.struct(F.abs(F.log(F.col("members") / F.lit(middle))).alias("d"), "level", "cluster_id")
    return df.agg(F.min_by(F.struct(*df.columns), order).alias("x")).where("x is not null").select("x.*")
