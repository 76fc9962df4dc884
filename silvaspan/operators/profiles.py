"""Categorical profiles: loci, groups of equal profiles, Hamming joins, spanning trees and forests.

profiles: (isolate_id, input_pos, alleles array<string>). ``0`` is the only missing allele. Joins compare
alleles by their 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from silvaspan.functions.labels import slugify
from silvaspan.operators.components import components_of_edges
from silvaspan.operators.skew import spread_join
from silvaspan.scratch import Scratch

MISSING = "0"
#: Tables of a Hamming join: as many shared blocks are asked for as this allows, SHARED at most.
TABLES, SHARED = 64, 8
#: Blocks whose shared ones are told by the bits of a long.
MASK = 62
#: Loci that are compared one by one in compiled code; wider profiles are compared as arrays.
UNROLLED = 32
#: Subsets of loci up to which a band of the spanning forest is found by groups of equal projections.
SUBSETS = 64
#: Profiles of one tile where all pairs are asked for.
TILE = 1024
#: Candidate pairs of one task of a Hamming join.
WORK = 1 << 20
#: A spanning forest over many loci goes by bands up to this part of the loci; beyond, components look for their nearest others by so many pivots, of which
#: the first PLANES deal the profiles into cells, and each profile is first held against so many that follow it in the pivots' order.
BANDS, PIVOTS, PLANES, NEXT = 16, 6, 2, 4


def locus_report(profiles: DataFrame) -> DataFrame:
    """(pos, retained): a locus stays if no row lacks it."""
    long = profiles.select(F.posexplode("alleles").alias("pos", "allele"))
    return long.groupBy("pos").agg((~F.bool_or(F.col("allele") == MISSING)).alias("retained"))


def drop_incomplete_loci(profiles: DataFrame) -> DataFrame:
    """profiles without the loci that any row lacks; an error if none is left. The positions of the others are one small row, so the plan is as small for thousands of loci."""
    kept = Scratch(profiles.sparkSession, "loci").save(locus_report(profiles).where("retained").agg(F.sort_array(F.collect_list("pos")).alias("_kept")), "kept")
    if not kept.where("size(_kept) > 0").limit(1).count():
        raise ValueError("no locus is complete")
    columns = profiles.columns
    picked = F.transform("_kept", lambda p: F.get("alleles", p)).alias("alleles")
    return profiles.crossJoin(F.broadcast(kept)).select(*(picked if c == "alleles" else F.col(c) for c in columns))


def group_profiles(profiles: DataFrame) -> DataFrame:
    """(node_id, alleles, first_pos, members): equal profiles; the representative is the smallest normalised id."""
    rows = profiles.withColumn("norm", slugify("isolate_id"))
    return rows.groupBy("alleles").agg(F.min("norm").alias("node_id"), F.min("input_pos").alias("first_pos"), F.count(F.lit(1)).alias("members")).select("node_id", "alleles", "first_pos", "members")


def membership(profiles: DataFrame, groups: DataFrame) -> DataFrame:
    """(node_id, isolate_id, isolate_norm) of every isolate."""
    rows = profiles.select("alleles", "isolate_id", slugify("isolate_id").alias("isolate_norm"))
    return rows.join(groups.select("node_id", "alleles"), "alleles").select("node_id", "isolate_id", "isolate_norm")


def id_faults(profiles: DataFrame) -> DataFrame:
    """(fault, isolate_norm, n): normalised ids that collide, are empty or look generated."""
    norm = profiles.select(slugify("isolate_id").alias("isolate_norm")).groupBy("isolate_norm").agg(F.count(F.lit(1)).alias("n"))
    fault = F.when(F.col("isolate_norm") == "", "empty").when(F.startswith("isolate_norm", F.lit("union_")), "reserved").when(F.col("n") > 1, "collision")
    return norm.select(fault.alias("fault"), "isolate_norm", "n").where("fault is not null")


def export_profiles(profiles: DataFrame, distinct: bool = False) -> DataFrame:
    """(id, alleles as tab-separated text) in input order, or one row per distinct profile in first-occurrence order."""
    rows = profiles if not distinct else group_profiles(profiles).select(F.col("node_id").alias("isolate_id"), F.col("first_pos").alias("input_pos"), "alleles")
    return rows.orderBy("input_pos").select(F.col("isolate_id").alias("id"), F.array_join("alleles", "\t").alias("line"))


def hashed(groups: DataFrame) -> DataFrame:
    """(node_id, h): the alleles' hashes, in the order of the loci."""
    return groups.select("node_id", F.transform("alleles", lambda a: F.xxhash64(a)).alias("h"))


def n_loci(groups: DataFrame) -> int:
    return groups.agg(F.max(F.size("alleles"))).first()[0] or 0


@F.arrow_udf(T.IntegerType())
def _differing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Differing places of arrays of longs of one length, whole batches at a time."""
    n = len(a)
    x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1)) for v in (a, b))
    return pa.array((x != y).sum(axis=1).astype(np.int32))


def hamming(a: str, b: str, lo: int, hi: int) -> Column:
    """Differing loci from lo to hi of two arrays of hashes: compiled for few loci, by batches for many."""
    if hi - lo <= UNROLLED:
        return sum(((F.get(a, F.lit(k)) != F.get(b, F.lit(k))).cast("int") for k in range(lo, hi)), F.lit(0))
    return _differing(F.slice(a, lo + 1, hi - lo), F.slice(b, lo + 1, hi - lo))


def allelic_pairs(groups: DataFrame, n: int, owners: DataFrame | None = None) -> DataFrame:
    """(source, target, distance): every pair within n differing loci, once, source < target.

    Loci are cut into n + s blocks; a pair within n shares s of them, so candidates come from equi-joins
    on s blocks, one table for each choice, and are verified. s is as large as ``TABLES`` and the loci allow: with few
    loci a block is one locus, and every candidate is a result. A pair is kept in its first table only, the
    one of its first s shared blocks, so no distinct is needed. With as many differences allowed as there are loci,
    all pairs are asked for: they are compared tile by tile, each pair of tiles in its own group.
    """
    rows = hashed(groups)
    rows = rows.join(owners.select("node_id", "component"), "node_id") if owners is not None else rows.withColumn("component", F.lit(""))
    loci = n_loci(groups)
    if n >= loci:
        tiles = max(1, math.ceil(groups.count() / TILE))
        tile = F.pmod(F.xxhash64("node_id"), F.lit(tiles))
        own = rows.select("*", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
        own = own.select("component", "node_id", "h", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile")
        x = own.select("component", "lo", "hi", F.col("node_id").alias("source"), F.col("h").alias("xh"), F.col("tile").alias("xt"))
        y = own.select("component", "lo", "hi", F.col("node_id").alias("target"), F.col("h").alias("yh"), F.col("tile").alias("yt"))
        both = x.join(y, ["component", "lo", "hi"]).where("source < target and (lo = hi or xt <> yt)")
        return both.select("source", "target", hamming("xh", "yh", 0, loci).alias("distance"))
    share = max(s for s in range(1, min(loci - n, SHARED) + 1) if s == 1 or (math.comb(n + s, s) <= TABLES and n + s <= MASK))
    blocks = n + share
    cuts = [loci * k // blocks for k in range(blocks + 1)]
    single = blocks == loci
    block = F.col("h") if single else F.array(*(F.xxhash64(F.slice("h", lo + 1, hi - lo)) for lo, hi in zip(cuts, cuts[1:])))
    rows = Scratch(groups.sparkSession, "blocks").save(rows.select("component", "node_id", "h", block.alias("b")), "rows")

    def verified(near: DataFrame) -> DataFrame:
        """Wide profiles don't travel with every block: they join the pairs that are left."""
        a, b = rows.select(F.col("node_id").alias("source"), F.col("h").alias("xh")), rows.select(F.col("node_id").alias("target"), F.col("h").alias("yh"))
        met = near.select("source", "target").join(a, "source").join(b, "target")
        return met.select("source", "target", hamming("xh", "yh", 0, loci).alias("distance")).where(F.col("distance") <= n)

    if blocks > MASK:
        # One shared block, and more blocks than a mask has bits: a pair is kept at the first block that it shares.
        keyed = rows.select("component", "node_id", "b", F.posexplode("b").alias("k", "v"))
        x = keyed.select("component", "k", "v", F.col("node_id").alias("source"), F.col("b").alias("xb"))
        y = keyed.select("component", "k", "v", F.col("node_id").alias("target"), F.col("b").alias("yb"))
        first = F.array_position(F.zip_with("xb", "yb", lambda u, v: u == v), True) == F.col("k") + 1
        return verified(x.join(y, ["component", "k", "v"]).where((F.col("source") < F.col("target")) & first))
    tables = []
    for t, own in enumerate(itertools.combinations(range(blocks), share)):
        value = F.xxhash64(F.lit(t), *(F.get("b", F.lit(k)) for k in own))
        # In a pair's first table no block before the table's last one is shared but its own.
        tables.append(F.struct(value.alias("v"), F.lit(sum(1 << k for k in own)).cast("long").alias("mine"), F.lit((1 << (own[-1] + 1)) - 1).cast("long").alias("seen")))
    wide = not single and loci > UNROLLED
    carried = ["b"] if single or wide else ["b", "h"]
    keyed = rows.withColumn("t", F.explode(F.array(*tables))).select("component", "node_id", *carried, "t.v", "t.mine", "t.seen")
    # Few rows may have many candidates: tasks are told by these, as Spark sees the rows alone.
    sizes = keyed.groupBy("component", "v").agg(F.count(F.lit(1)).alias("n"))
    tasks = int(sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0))).first()[0]) // WORK + 1
    deal = lambda df: df.repartition(tasks, "component", "v") if tasks > 1 else df
    x = keyed.select("component", "v", "mine", "seen", F.col("node_id").alias("source"), *(F.col(c).alias("x" + c) for c in carried))
    y = keyed.select("component", "v", F.col("node_id").alias("target"), *(F.col(c).alias("y" + c) for c in carried))
    equal = sum((F.when(F.get("xb", F.lit(k)) == F.get("yb", F.lit(k)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(blocks)), F.lit(0).cast("long"))
    near = deal(x).join(deal(y).hint("shuffle_hash") if tasks > 1 else y, ["component", "v"]).where("source < target").withColumn("equal", equal).where(F.col("equal").bitwiseAND(F.col("seen")) == F.col("mine"))
    if wide:
        return verified(near)
    far = F.lit(loci) - F.bit_count("equal") if single else hamming("xh", "yh", 0, loci)
    return near.select("source", "target", far.cast("int").alias("distance")).where(F.col("distance") <= n)


def lv_counts(pairs: DataFrame) -> DataFrame:
    """(node_id, distance, n): how many others lie at each distance of each node."""
    both = pairs.select(F.col("source").alias("node_id"), "distance").unionByName(pairs.select(F.col("target").alias("node_id"), "distance"))
    return both.groupBy("node_id", "distance").agg(F.count(F.lit(1)).alias("n"))


def projections(rows: DataFrame, loci: int, differ: int) -> DataFrame:
    """rows (h, ...) once for each choice of loci - differ loci, with ``v``, the hash of the choice and its alleles."""
    values = [F.xxhash64(F.lit(t), *(F.get("h", F.lit(k)) for k in own)) for t, own in enumerate(itertools.combinations(range(loci), loci - differ))]
    return rows.withColumn("v", F.explode(F.array(*values)))


def single_variants(groups: DataFrame, loci: int) -> DataFrame:
    """(node_id, lv): how many distinct profiles differ in exactly one locus: those that share all loci but one."""
    shared = projections(hashed(groups), loci, 1).select("node_id", "v")
    sizes = shared.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.join(sizes, "v").groupBy("node_id").agg(F.sum(F.col("n") - 1).alias("lv"))


def _own_groups(nodes: DataFrame, loci: int, band: int) -> DataFrame:
    """(v, c, own): of every group v of profiles that share loci - band loci each component's best node, by variants and id."""
    rank = F.struct((-F.col("lv")).alias("lv"), F.col("node_id").alias("id"))
    return projections(nodes, loci, band).groupBy("v", F.col("component").alias("c")).agg(F.min(rank).alias("own"))


def _open_groups(per: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored rows (v, c, own, first, second) of groups that several components share; ``first`` and ``second`` are the best rows (own, c) of two of them."""
    per = scratch.save(per, "per")
    # The two least of a group's rows, which are one for each component.
    row = F.struct("own", "c")
    two = per.groupBy("v").agg(F.min(row).alias("first"), F.max(F.col("c")).alias("high"), F.min(F.col("c")).alias("low")).where("high <> low").select("v", "first")
    met = scratch.save(per.join(two, "v"), "met")
    scratch.drop(per)
    second = met.where("c <> first.c").groupBy("v").agg(F.min(row).alias("second"))
    return scratch.save(met.join(second, "v"), "open")


def _merged_groups(met: DataFrame, merged: DataFrame) -> DataFrame:
    """(v, c, own) of open groups after components were merged (node, new)."""
    now = met.select("v", "c", "own").join(merged.select(F.col("node").alias("c"), "new"), "c", "left")
    return now.groupBy("v", F.coalesce("new", "c").alias("c")).agg(F.min("own").alias("own"))


def _best_by_groups(met: DataFrame, band: int) -> DataFrame:
    """(c, r, ca, cb): for every open group of profiles that share loci - band loci, each component's best edge out of it.

    Two members of a group differ in ``band`` loci at most, and as all shorter edges are merged, members of two
    components in exactly that many. The best edge of a component joins its best node, by variants and id, to the
    best node of the others: two nodes per group and component are looked at, never pairs of all.
    """
    met = met.withColumn("far", F.when(F.col("c") == F.col("first.c"), F.col("second")).otherwise(F.col("first")))
    a, b = F.col("own.id"), F.col("far.own.id")
    la, lb = -F.col("own.lv"), -F.col("far.own.lv")
    r = F.struct(F.lit(band).alias("distance"), (-F.greatest(la, lb)).alias("l1"), (-F.least(la, lb)).alias("l2"), F.least(a, b).alias("source"), F.greatest(a, b).alias("target"))
    near = a < b
    return met.select("c", r.alias("r"), F.when(near, F.col("c")).otherwise(F.col("far.c")).alias("ca"), F.when(near, F.col("far.c")).otherwise(F.col("c")).alias("cb"))


def _best_by_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(c, r, ca, cb): each component's best edge among pairs."""
    a = nodes.select(F.col("node_id").alias("source"), F.col("component").alias("ca"), F.col("lv").alias("la"))
    b = nodes.select(F.col("node_id").alias("target"), F.col("component").alias("cb"), F.col("lv").alias("lb"))
    open_ = pairs.join(a, "source").join(b, "target").where("ca <> cb")
    r = F.struct("distance", (-F.greatest("la", "lb")).alias("l1"), (-F.least("la", "lb")).alias("l2"), "source", "target")
    return open_.select(F.explode(F.array("ca", "cb")).alias("c"), r.alias("r"), "ca", "cb")


def _as_matrix(h: pa.Array) -> np.ndarray:
    return h.flatten().to_numpy(zero_copy_only=False).reshape(len(h), -1) if len(h) else np.zeros((0, 1), np.int64)


def _distances_to(pivots: list[list[int]]):
    """A column function: the distances of an array of hashes to each pivot."""
    table = np.array(pivots, np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def to(h: pa.Array) -> pa.Array:
        x = _as_matrix(h)
        d = np.stack([(x != p).sum(axis=1) for p in table], axis=1).astype(np.int32) if len(x) else np.zeros((0, len(table)), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, len(table)), pa.int32()), pa.array(d.ravel()))

    return to


def with_pivots(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """nodes (node_id, h, ...) with ``p``, their distances to PIVOTS profiles at most, each the farthest from those before it, and these profiles' ids."""
    first = nodes.agg(F.min(F.struct("node_id", "h")).alias("x")).first()["x"]
    ids, rows = [first["node_id"]], [first["h"]]
    while True:
        found = scratch.save(nodes.withColumn("p", _distances_to(rows)("h")), "pivots")
        far = found.agg(F.max(F.struct(F.array_min("p").alias("d"), "node_id", "h")).alias("x")).first()["x"]
        if len(ids) == PIVOTS or not far["d"]:
            return found, ids
        ids.append(far["node_id"])
        rows.append(far["h"])
        scratch.drop(found)


def _reach(nodes: DataFrame, pivots: list[str], top: int) -> DataFrame:
    """(component, reach): a distance of at most ``top`` within which each component has another one's profile, if there is one: the least to a pivot or to a profile that follows in the pivots' order."""
    homes = {r["node_id"]: r["component"] for r in nodes.where(F.col("node_id").isin(pivots)).select("node_id", "component").collect()}
    to = [F.when(F.col("component") != homes[v], F.get("p", F.lit(k))) for k, v in enumerate(pivots)]
    by_pivot = nodes.select("component", F.least(*to, F.lit(top)).alias("d"))
    rows = nodes.select("p", "node_id", "component", "h").repartitionByRange("p", "node_id").sortWithinPartitions("p", "node_id").select("component", "h")

    def run(batches):
        for batch in batches:
            c, x = np.array(batch.column(0).to_pylist(), object), _as_matrix(batch.column(1))
            for s in range(1, min(NEXT, len(c) - 1) + 1):
                at = np.flatnonzero(c[s:] != c[:-s])
                if len(at):
                    d = (x[at] != x[at + s]).sum(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((c[at], c[at + s]))), pa.array(np.tile(d, 2))], ["component", "d"])

    found = by_pivot.unionByName(rows.mapInArrow(run, "component string, d int"))
    return found.groupBy("component").agg(F.min("d").alias("reach"))


def foreign_candidates(nodes: DataFrame, reach: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, target): pairs of profiles of two components that may be as near as the reach of one of them, by the triangle inequality at every pivot.

    The profiles stand in cells of their first pivots' distances; those of components with a reach (component, reach, n) look into the cells within it.
    """
    total = nodes.count()
    width = max(1, int(reach.agg(F.avg("reach")).first()[0] or 1))
    planes = min(PLANES, nodes.select(F.max(F.size("p"))).first()[0] or 1)
    cells = [f"b{k}" for k in range(planes)]
    slim = scratch.save(nodes.select("node_id", "component", "p"), "slim")
    x = spread_join(slim, reach, "component", "n", total).select(F.col("node_id").alias("x"), F.col("component").alias("xc"), F.col("p").alias("xp"), "reach")
    y = slim.select(F.col("node_id").alias("y"), F.col("component").alias("yc"), F.col("p").alias("yp"))
    for k, c in enumerate(cells):
        at = F.get("xp", F.lit(k))
        x = x.withColumn(c, F.explode(F.sequence(F.floor((at - F.col("reach")) / width), F.floor((at + F.col("reach")) / width))))
        y = y.withColumn(c, F.floor(F.get("yp", F.lit(k)) / width))
    near = F.forall(F.zip_with("xp", "yp", lambda a, b: F.abs(a - b)), lambda d: d <= F.col("reach"))
    return x.join(y, cells).where((F.col("xc") != F.col("yc")) & near).select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target")).distinct()


def _best_by_pivots(nodes: DataFrame, pivots: list[str], loci: int, top: int, scratch: Scratch) -> DataFrame:
    """(c, r, ca, cb): the best edge of every component but the largest, which the others find."""
    sizes = scratch.save(nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    largest = sizes.agg(F.max_by("component", F.struct("n", "component"))).first()[0]
    reach = scratch.save(_reach(nodes, pivots, top).join(sizes.where(F.col("component") != largest), "component"), "reach")
    pairs = foreign_candidates(nodes, reach, scratch)
    a = nodes.select(F.col("node_id").alias("source"), F.col("h").alias("xh"))
    b = nodes.select(F.col("node_id").alias("target"), F.col("h").alias("yh"))
    known = pairs.join(a, "source").join(b, "target").select("source", "target", hamming("xh", "yh", 0, loci).alias("distance"))
    return _best_by_pairs(nodes, known.where(F.col("distance") <= top)).where(F.col("c") != largest)


def spanning_forest(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """(source, target, distance): a minimum spanning tree over distinct profiles, or the forest of edges of at most ``limit``.

    Bands of growing distance: within a band, rounds in which every component takes its least edge to
    another one (ties by the ends' variant counts, then ids, a strict order, so no cycles) and components
    are merged. An edge of one band is never displaced by a later band, so the weights are those of Kruskal.

    With few loci a band is one distance, and its edges are found by groups of equal projections, without pairs. With
    more, bands double and candidates come from a Hamming join, up to a part of the loci. What is left are components far from each other: each but
    the largest has a reach, a distance to some other one that is known, and candidates are the pairs that no pivot tells to be farther apart.
    """
    spark = groups.sparkSession
    scratch = Scratch(spark, "spanning")
    groups = scratch.save(groups.select("node_id", "alleles"), "profiles")
    loci = n_loci(groups)
    top = loci if limit is None else min(limit, loci)
    if not top:
        return spark.createDataFrame([], "source string, target string, distance int")
    near = single_variants(groups, loci) if loci <= SUBSETS else lv_counts(allelic_pairs(groups, 1)).where("distance = 1").select("node_id", F.col("n").alias("lv"))
    nodes = hashed(groups).join(near, "node_id", "left").select("node_id", "h", F.coalesce("lv", F.lit(0)).alias("lv"), F.col("node_id").alias("component"))
    nodes = scratch.save(nodes, "nodes")
    n_nodes, n_edges = nodes.count(), 0
    tree, done, band = [], 0, 1
    while True:
        band = min(band, top)
        # Groups tell a distance only where all shorter edges are merged.
        grouped = band == done + 1 and math.comb(loci, band) <= SUBSETS
        by_pivots = not grouped and band > max(1, loci // BANDS)
        pairs, met = None, None
        if by_pivots and n_edges < n_nodes - 1:
            nodes, pivots = with_pivots(nodes, scratch)
            band = top
        while n_edges < n_nodes - 1:
            if not grouped and not by_pivots and pairs is None:
                pairs = scratch.save(allelic_pairs(groups, band).where("distance > 0"), f"pairs{band}")
            if grouped:
                # Merged components keep the best of their nodes, and a group that one component fills stays so: only open groups go on.
                met = _open_groups(_own_groups(nodes, loci, band) if met is None else _merged_groups(met, merged), scratch)
            open_ = _best_by_groups(met, band) if grouped else _best_by_pivots(nodes, pivots, loci, top, scratch) if by_pivots else _best_by_pairs(nodes, pairs)
            best = open_.groupBy("c").agg(F.min(F.struct("r", "ca", "cb")).alias("m"))
            chosen = scratch.save(best.select("m.r.source", "m.r.target", "m.r.distance", "m.ca", "m.cb").distinct(), "chosen")
            found = chosen.count()
            if not found:
                break
            n_edges += found
            tree.append(chosen.select("source", "target", F.col("distance").cast("int").alias("distance")))
            merged = scratch.save(components_of_edges(chosen, "ca", "cb").withColumnRenamed("component", "new"), "merged")
            kept = [c for c in nodes.columns if c != "component"]
            nodes = scratch.save(nodes.join(merged, nodes["component"] == merged["node"], "left").select(*kept, F.coalesce("new", "component").alias("component")), "nodes")
        if n_edges >= n_nodes - 1 or band >= top:
            break
        done, band = band, band + 1 if math.comb(loci, band + 1) <= SUBSETS else band * 2
    if not tree:
        return spark.createDataFrame([], "source string, target string, distance int")
    out = tree[0]
    for more in tree[1:]:
        out = out.unionByName(more)
    return out


def weight_histogram(tree: DataFrame) -> DataFrame:
    """(distance, n): equal for all minimum spanning trees of the same profiles."""
    return tree.groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def tree_weights(tree: DataFrame) -> DataFrame:
    return tree.agg(F.max("distance").alias("max_distance"), F.sum("distance").alias("total_distance"), F.count(F.lit(1)).alias("edges"))


def mst_certificate(tree: DataFrame, pairs: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, by_tree, by_pairs): nodes linked to a smaller one at each threshold, which agree for a minimum spanning tree."""
    out = None
    for t in thresholds:
        merged = [components_of_edges(df.where(F.col("distance") <= t), "source", "target").where("node <> component").agg(F.count(F.lit(1)).alias(name)) for df, name in ((tree, "by_tree"), (pairs, "by_pairs"))]
        row = merged[0].crossJoin(merged[1]).select(F.lit(t).alias("threshold"), "by_tree", "by_pairs")
        out = row if out is None else out.unionByName(row)
    return out


def validate_spanning(groups: DataFrame, tree: DataFrame, limit: int | None = None) -> DataFrame:
    """(error, n): profiles not in the tree's universe, cycles, edges over the limit, and more than one component of a full tree."""
    nodes = groups.select("node_id")
    ends = tree.select(F.explode(F.array("source", "target")).alias("node_id"))
    comps = components_of_edges(tree, "source", "target")
    n, e, linked, roots = nodes.count(), tree.count(), comps.count(), comps.select("component").distinct().count()
    rows = [("unknown profile", ends.join(nodes, "node_id", "left_anti").count()), ("cycle", e - (linked - roots)), ("too long", tree.where(F.col("distance") > limit).count() if limit is not None else 0), ("several components", max(0, n - linked + roots - 1) if limit is None else 0)]
    return groups.sparkSession.createDataFrame([r for r in rows if r[1]], "error string, n long")


def select_roots(pairs: DataFrame, owners: DataFrame, first_pos: DataFrame, level: int) -> DataFrame:
    """(component, root): most variants at distance 1, then 2, up to level; then the first in the input."""
    counts = lv_counts(pairs).where(F.col("distance").between(1, level))
    vectors = counts.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("distance", "n"))).alias("m"))
    rows = owners.join(vectors, "node_id", "left").join(first_pos.select("node_id", "first_pos"), "node_id")
    vector = F.array(*(-F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)) for k in range(1, level + 1)))
    return rows.groupBy("component").agg(F.min_by("node_id", F.struct(vector, F.col("first_pos"))).alias("root"))


def collapse_graph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(source, target, distance, fault): isolate edges between representatives; a fault where parallel weights differ or an inner edge has length."""
    a, b = members.select(F.col("isolate_norm").alias("source"), F.col("node_id").alias("s")), members.select(F.col("isolate_norm").alias("target"), F.col("node_id").alias("t"))
    rows = edges.join(a, "source").join(b, "target").select(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target"), "distance")
    found = rows.groupBy("source", "target").agg(F.min("distance").alias("distance"), F.max("distance").alias("most"))
    inner = F.col("source") == F.col("target")
    fault = F.when(inner & (F.col("most") > 0), "distance inside a profile").when(~inner & (F.col("distance") != F.col("most")), "conflicting distances")
    return found.select("source", "target", "distance", fault.alias("fault")).where(~inner | F.col("fault").isNotNull())


def triangular_pairs(lines: DataFrame) -> DataFrame:
    """(source, target, distance) from numbered lines (line_no, value) of a lower-triangular matrix: a size line, then id and distances."""
    rows = lines.where("line_no > 0").select((F.col("line_no") - 1).alias("row"), F.split(F.trim("value"), r"\s+").alias("cells"))
    ids = rows.select("row", F.get("cells", F.lit(0)).alias("id"))
    cells = rows.select("row", F.posexplode(F.slice("cells", 2, 1 << 30)).alias("col", "d"))
    return cells.join(ids.withColumnRenamed("id", "target"), "row").join(ids.select(F.col("row").alias("col"), F.col("id").alias("source")), "col").select("source", "target", F.col("d").try_cast("int").alias("distance"))


def audit_profiles(profiles: DataFrame) -> DataFrame:
    """(measure, n): rows, loci, kept loci, distinct profiles, pairs at distance zero, collisions, empty ids."""
    report = locus_report(profiles)
    kept = drop_incomplete_loci(profiles)
    sizes = kept.groupBy("alleles").agg(F.count(F.lit(1)).alias("m"))
    faults = id_faults(profiles)
    measures = [
        ("rows", profiles.agg(F.count(F.lit(1)))), ("loci", report.agg(F.count(F.lit(1)))), ("kept loci", report.agg(F.count_if("retained"))),
        ("distinct profiles", sizes.agg(F.count(F.lit(1)))), ("pairs at zero", sizes.agg(F.coalesce(F.sum(F.expr("m * (m - 1) div 2")), F.lit(0)))),
        ("id collisions", faults.agg(F.count_if(F.col("fault") == "collision"))), ("empty ids", faults.agg(F.count_if(F.col("fault") == "empty"))),
    ]
    out = None
    for name, df in measures:
        row = df.toDF("n").select(F.lit(name).alias("measure"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def group_sizes(profiles: DataFrame) -> DataFrame:
    """(members, profiles): how many distinct profiles stand for how many rows each."""
    sizes = drop_incomplete_loci(profiles).groupBy("alleles").agg(F.count(F.lit(1)).alias("members"))
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("profiles"))


def annotation_id_audit(profiles: DataFrame, ids: DataFrame) -> DataFrame:
    """(measure, n): annotation rows (join_id) with a blank id, ids that repeat, ids of no profile row, profile rows without annotation; by normalised ids."""
    own = profiles.select(slugify("isolate_id").alias("norm")).distinct()
    rows = ids.select(slugify("join_id").alias("norm"))
    known = rows.where("norm <> ''")
    measures = [
        ("blank", rows.where("norm is null or norm = ''")), ("repeated", known.groupBy("norm").count().where("count > 1")),
        ("unknown", known.distinct().join(own, "norm", "left_anti")), ("missing", own.join(known, "norm", "left_anti")),
    ]
    out = None
    for name, df in measures:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def triangular_faults(lines: DataFrame, members: DataFrame, loci: int) -> DataFrame:
    """(fault, n) of numbered lines (line_no, value) of a triangular matrix over members (id, profile): wrong size line or row length,
    unknown or repeated ids, distances that are no whole number of at most ``loci``, zeros between other profiles and lengths between equal ones."""
    rows = lines.where("line_no > 0").select((F.col("line_no") - 1).alias("row"), F.split(F.trim("value"), r"\s+").alias("cells"))
    ids = rows.select(F.get("cells", F.lit(0)).alias("id"))
    told = lines.where("line_no = 0").select(F.trim("value").try_cast("long").alias("told")).crossJoin(rows.agg(F.count(F.lit(1)).alias("found")))
    cells = rows.select("row", F.explode(F.slice("cells", 2, 1 << 30)).alias("d"))
    pairs = triangular_pairs(lines)
    a, b = members.select(F.col("id").alias("source"), F.col("profile").alias("pa")), members.select(F.col("id").alias("target"), F.col("profile").alias("pb"))
    equal = pairs.join(a, "source").join(b, "target")
    checks = [
        ("size line", told.where("told is null or told <> found")), ("row length", rows.where("size(cells) <> row + 1")), ("repeated id", ids.groupBy("id").count().where("count > 1")),
        ("unknown id", ids.join(members.select("id"), "id", "left_anti")), ("bad distance", cells.where(F.col("d").try_cast("int").isNull() | ~F.col("d").rlike("^[0-9]+$") | (F.col("d").try_cast("int") > loci))),
        ("zero and equality", equal.where("(distance = 0) <> (pa = pb)")),
    ]
    out = None
    for fault, df in checks:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(fault).alias("fault"), "n")
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0")
