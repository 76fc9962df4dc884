import itertools
import random

import pytest
from pyspark.sql import functions as F

from silvaspan.operators import components, forest, newick, ordering, patristic, profiles, reads, tiers
from silvaspan.operators.components import components_of_edges
from silvaspan.scratch import Scratch

EDGE = "edge_id string, source string, target string, distance double"


def plain_index(parent):
    kids, out = {}, {}
    for v, p in parent.items():
        kids.setdefault(p, []).append(v)
    clock = 0
    stack = [(r, 0, False) for r in sorted(kids[None], reverse=True)]
    while stack:
        v, d, done = stack.pop()
        if done:
            out[v] = (*out[v], clock)
            continue
        out[v] = (d, clock)
        clock += 1
        stack.append((v, d, True))
        stack += [(c, d + 1, False) for c in sorted(kids.get(v, []), reverse=True)]
    return out


def frames(spark, parent):
    edges = [(f"e{v}", p, v, 1.0) for v, p in parent.items() if p is not None]
    roots = [(v, k) for k, v in enumerate(sorted(v for v, p in parent.items() if p is None))]
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame(roots, "node_id string, root_pos int")


def grown(seed, n, roots, wide):
    """A random forest: every node hangs below one of the last ``wide`` nodes before it."""
    draw = random.Random(seed)
    names = [f"{draw.choice('abcxyz')}{k:04d}" for k in range(n)]
    return {v: None if k < roots else names[draw.randrange(max(0, k - wide), k)] for k, v in enumerate(names)}


@pytest.mark.parametrize("levels, deep", [(16, 40), (16, 3), (0, 3)])
def test_index_equals_plain_traversal(spark, monkeypatch, levels, deep):
    monkeypatch.setattr(forest, "LEVELS", levels)
    parent = grown(2024, 83, 5, deep)
    got = {r["node_id"]: (r["depth"], r["dfs_start"], r["dfs_end"]) for r in forest.index_forest(*frames(spark, parent)).collect()}
    assert got == plain_index(parent)


def test_faulty_forests_are_errors(spark):
    roots = spark.createDataFrame([("r", 0)], "node_id string, root_pos int")
    for links in ([("r", "a"), ("b", "c"), ("c", "b")], [("r", "a"), ("r", "b"), ("b", "a")], [("r", "a"), ("a", "r")]):
        edges = spark.createDataFrame([(f"e{k}", *x, 1.0) for k, x in enumerate(links)], EDGE)
        with pytest.raises(ValueError):
            forest.index_forest(edges, roots)
    with pytest.raises(ValueError):
        forest.depths_of(spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b")], "node_id string, parent string"), Scratch(spark, "t"))
    nodes = spark.createDataFrame([("r",), ("a",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("1", "r", "a", 1.0), ("2", "a", "b", 1.0), ("3", "r", "b", 1.0), ("4", "b", "b", 1.0), ("5", "b", "zz", 1.0)], EDGE)
    assert {r["error"]: r["n"] for r in forest.validate_forest(nodes, edges, roots).collect()} == {"cycle": 1, "self loop": 1, "unknown endpoint": 1}


def test_sums_and_carries_run_through_spans(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice([None, f"v{k}"]), draw.randrange(9)) for k in range(200)]
    df = spark.createDataFrame(rows, "at long, v string, n long").repartition(5)
    for inclusive in (True, False):
        got = {r["at"]: r["last"] for r in ordering.carry_last(df, "at", F.col("v"), "last", span=7, inclusive=inclusive).collect()}
        assert got == {k: next((v for j, v, _ in reversed(rows[: k + inclusive]) if v), None) for k, _, _ in rows}
    assert {r["at"]: r["m"] for r in ordering.carry_max(df, "at", "n", "m", span=9).collect()} == {k: max((n for _, _, n in rows[:k]), default=None) for k, _, _ in rows}
    for span in (1000, 16):
        assert {r["at"]: r["s"] for r in ordering.sum_before(df, ["at"], "n", "s", span=span).collect()} == {k: sum(n for _, _, n in rows[:k]) for k, _, _ in rows}


def test_deep_chain(spark):
    parent = {f"n{k:04d}": f"n{k - 1:04d}" if k else None for k in range(300)}
    got = {r["node_id"]: (r["depth"], r["dfs_start"], r["dfs_end"]) for r in forest.index_forest(*frames(spark, parent)).collect()}
    assert got == plain_index(parent)


def test_components_of_odd_edges(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 5), (7, None), (9, 8), (3, 3)], "a long, b long")
    for local in (0, None):
        assert {r["node"]: r["component"] for r in components_of_edges(df, local=local).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8}
    draw = random.Random(8)
    many = spark.createDataFrame([(f"v{draw.randrange(90)}", f"v{draw.randrange(90)}") for _ in range(60)], "a string, b string")
    assert sorted(map(tuple, components_of_edges(many, local=0).collect())) == sorted(map(tuple, components_of_edges(many).collect()))
    assert components_of_edges(df.limit(0)).count() == 0


#: The cuts that have to come of these counts.
@pytest.mark.parametrize(
    "counts, gamma, cuts",
    [
        ([1] * 12001, 2, [0, 2, 6, 14, 30, 62, 126, 254, 510, 1022, 2046, 4094, 8190, 12000]),
        ([1, 1, 1, 2], 2, [0, 3]),
        ([1, 1, 1, 9], 3, [0, 1, 3]),
        ([1], 2, [0]),
        ([1, 1], 2, [1]),
        ([1, 1, 1], 1.01, [0, 2]),
    ],
)
def test_cut_selection(spark, counts, gamma, cuts):
    hist = spark.createDataFrame([(d, n) for d, n in enumerate(counts)], "depth long, n long")
    index = hist.select("depth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert tiers.select_cuts(tiers.cut_sizes(index), gamma=gamma).first()["cuts"] == cuts


@pytest.mark.parametrize("gamma", [0, 1, -1, float("nan"), float("inf")])
def test_bad_gamma(spark, gamma):
    with pytest.raises(ValueError):
        tiers.select_cuts(spark.createDataFrame([(0, 1)], "depth long, visible long"), gamma=gamma)


def test_tiers_are_nested_partitions(spark):
    draw = random.Random(5)
    parent = {f"n{k:03d}": None if k == 0 else f"n{draw.randrange(max(0, k - 9), k):03d}" for k in range(120)}
    edges, roots = frames(spark, parent)
    index = forest.index_forest(edges, roots)
    cuts = tiers.levels_of(tiers.select_cuts(tiers.cut_sizes(index)))
    clusters = tiers.clusters_at(index, cuts)
    assert {r["check"]: r["n"] for r in tiers.validate_tiers(clusters, index).collect()} == {"partition": 0, "refinement": 0, "representative depth": 0}
    sizes = {r["depth"]: r["visible"] for r in tiers.cut_sizes(index).collect()}
    shown = {(r["cut"], r["n"]) for r in clusters.groupBy("cut").agg(F.countDistinct("cluster_id").alias("n")).collect()}
    assert shown == {(c, sizes[c]) for c, _ in shown}
    assert tiers.presentation_depths(index, 64).where("depth > 0").count() > 0 and tiers.presentation_depths(index, 120).where("depth > 0").count() == 0


def test_folds(spark):
    parent = {"r": None, "a": "r", "b": "a", "c": "b", "d": "r"}
    edges, roots = frames(spark, parent)
    index = forest.index_forest(edges, roots)
    folds = index.where("node_id in ('a', 'b')").select("component", "node_id", "dfs_start", "dfs_end")
    shown = {r["node_id"]: (r["hidden_by"], r["hidden"]) for r in reads.apply_folds(index, folds).collect()}
    assert shown == {"r": (None, None), "a": (None, 2), "b": ("a", None), "c": ("a", None), "d": (None, None)}
    assert [r["node_id"] for r in reads.reveal(folds, index, "b").collect()] == ["b"]
    assert reads.reveal(folds, index, "c").count() == 0 and reads.fold_roots(index).count() == 1


#: Texts, and the nodes, edges and warnings that have to come of them.
NEWICK = [
    ("balanced", "((A,B)X,(C,D)Y)Root;", 7, 6, 0),
    ("lengths", "(A:0.10,(B:0.20,C:0.30)N:0.40)R:0.50;", 5, 4, 0),
    ("blanks", " ( ( A , B ) X , C ) Root ; ", 5, 4, 0),
    ("twice", "(A,A)R;", 3, 2, 1),
    ("quoted", "('it''s; (x)',[a;b]B)R;", 3, 2, 0),
    ("forest", "(A,B)R;(C,(D,E));", 8, 6, 1),
    ("anonymous", "((A,_),C);", 5, 4, 0),
    ("negative", "(A:-1,B:2);", 3, 2, 1),
    ("plain", "(A,B)R", 3, 2, 0),
]


def test_newick_cases(spark):
    docs = spark.createDataFrame([(n, c) for n, c, *_ in NEWICK] + [("open", "(A,BRoot;"), ("behind", "(A,B)R;EXTRA("), ("empty", " "), ("length", "(A:x,B);"), ("close", "A,B)R;")], "doc_id string, content string")
    got = newick.parse_forests(docs)
    count = {name: {r["doc_id"]: r["count"] for r in got[name].groupBy("doc_id").count().collect()} for name in ("nodes", "edges", "warnings")}
    for name, _, nodes, edges, warnings in NEWICK:
        assert (count["nodes"].get(name, 0), count["edges"].get(name, 0), count["warnings"].get(name, 0)) == (nodes, edges, warnings), name
    assert {r["doc_id"] for r in got["errors"].collect()} == {"open", "behind", "empty", "length", "close"}
    ids = {(r["doc_id"], r["node_id"]) for r in got["nodes"].collect()}
    assert {("forest", "c2_union_1"), ("forest", "c2_union_3"), ("twice", "a_2"), ("quoted", "it_s_x"), ("anonymous", "leaf_1"), ("anonymous", "union_1")} <= ids
    edges = {(r["source"], r["target"]): r["distance"] for r in got["edges"].where("doc_id = 'lengths'").collect()}
    assert edges == {("r", "a"): 0.1, ("r", "n"): 0.4, ("n", "b"): 0.2, ("n", "c"): 0.3}


def test_newick_tasks_grow_with_the_documents(spark, monkeypatch):
    """One shuffle partition is configured; documents are dealt by their characters, and the rows are those of one task."""
    docs = spark.createDataFrame([(k, f"((a{k}:1,'b c'):2,(c,:3)d)r;(e,f{k})") for k in range(60)], "doc_id int, content string")
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        whole = newick.parse_forests(docs)
        monkeypatch.setattr(newick, "CHARS", 64)
        dealt = newick.parse_forests(docs)
        for name in ("nodes", "edges", "roots", "errors"):
            assert sorted(map(str, dealt[name].collect())) == sorted(map(str, whole[name].collect())), name
        assert dealt["edges"].count() == 60 * 8
        assert whole["edges"].select(F.spark_partition_id()).distinct().count() == 1
        assert dealt["edges"].select(F.spark_partition_id()).distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)


PROFILE = "isolate_id string, input_pos long, alleles array<string>"


def test_missing_loci_and_groups(spark):
    rows = [("iso-A", 0, ["1", "2", "0", "5"]), ("iso-B", 1, ["1", "2", "7", "5"]), ("iso-C", 2, ["1", "3", "7", "0"]), ("iso-D", 3, ["2", "3", "8", "5"])]
    df = spark.createDataFrame(rows, PROFILE)
    assert [r["retained"] for r in profiles.locus_report(df).orderBy("pos").collect()] == [True, True, False, False]
    groups = profiles.group_profiles(profiles.drop_incomplete_loci(df))
    assert sorted((r["node_id"], r["members"]) for r in groups.collect()) == [("iso_a", 2), ("iso_c", 1), ("iso_d", 1)]
    got = {(r["source"], r["target"]): r["distance"] for r in profiles.allelic_pairs(groups, 2).collect()}
    assert got == {("iso_a", "iso_c"): 1, ("iso_a", "iso_d"): 2, ("iso_c", "iso_d"): 1}


def test_bounded_levels(spark):
    rows = [("A", 0, list("1111")), ("A2", 1, list("1111")), ("B", 2, list("1112")), ("C", 3, list("2222")), ("D", 4, list("3333"))]
    groups = profiles.group_profiles(spark.createDataFrame(rows, PROFILE))
    for limit, edges in ((1, 1), (3, 2), (4, 3), (None, 3)):
        assert profiles.spanning_forest(groups, limit).count() == edges
    assert profiles.validate_spanning(groups, profiles.spanning_forest(groups)).count() == 0


@pytest.mark.parametrize("loci", [5, 9, 40])
def test_hamming_pairs_and_tree_equal_brute_force(spark, loci):
    draw = random.Random(loci)
    rows = [(f"q{k:03d}", k, [draw.choice("abcde") for _ in range(loci)]) for k in range(40)]
    for k in range(0, 30, 2):  # Some that differ in few loci.
        rows.append((f"r{k:03d}", 50 + k, [draw.choice("xyz") if draw.random() < 0.2 else a for a in rows[k][2]]))
    groups = profiles.group_profiles(spark.createDataFrame(rows, PROFILE))
    own = {r["node_id"]: r["alleles"] for r in groups.collect()}
    every = {(a, b): sum(x != y for x, y in zip(own[a], own[b])) for a, b in itertools.combinations(sorted(own), 2)}
    for n in (1, 3, loci, 99):
        got = [(r["source"], r["target"], r["distance"]) for r in profiles.allelic_pairs(groups, n).collect()]
        assert len(got) == len(set(got)) and {(a, b): d for a, b, d in got} == {p: d for p, d in every.items() if d <= n}
    near = {v: sum(d == 1 for p, d in every.items() if v in p) for v in own}

    def rank(pair):
        x, y = near[pair[0]], near[pair[1]]
        return every[pair], -max(x, y), -min(x, y), pair

    root, tree = {v: v for v in own}, set()

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in sorted(every, key=rank):
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree.add((a, b, every[a, b]))
    assert {tuple(r) for r in profiles.spanning_forest(groups).collect()} == tree
    assert {tuple(r) for r in profiles.spanning_forest(groups, 2).collect()} == {e for e in tree if e[2] <= 2}


def test_paths_equal_brute_force(spark):
    draw = random.Random(5150)
    parent = {k: draw.randrange(max(0, k - 6), k) if k > 1 else None for k in range(34)}
    length = {k: draw.choice([0.0, 0.3, 1.0, 1.7, 4.0]) for k in parent}
    edges = spark.createDataFrame([(f"e{k}", f"n{p}", f"n{k}", length[k]) for k, p in parent.items() if p is not None], EDGE)

    def up(k):
        out, d = {}, 0
        while k is not None:
            out[k] = d
            d, k = d + round(length[k] * 10), parent[k]
        return out

    picked = [k for k in range(34) if k % 3]
    named = [f"n{k}" for k in picked]
    every = {}
    for a, b in itertools.combinations(picked, 2):
        x, y = up(a), up(b)
        if shared := [x[k] + y[k] for k in x if k in y]:
            every[tuple(sorted((f"n{a}", f"n{b}")))] = min(shared) / 10
    for radius, local in ((0, None), (0.6, 5), (3, 0), (100, None)):
        got = {(r["source"], r["target"]): r["distance"] for r in patristic.patristic_pairs(edges, spark.createDataFrame([(x,) for x in named], "node_id string"), radius, local).collect()}
        assert got == {p: d for p, d in every.items() if d <= radius}


def test_paths_on_a_long_chain_and_a_wide_star(spark):
    """The ends of a chain of 6,000 nodes meet at a few separators; no list is as long as the climb."""
    chain = spark.range(5999).selectExpr("cast(id as string) AS edge_id", "concat('n', id) AS source", "concat('n', id + 1) AS target", "1D AS distance")
    ends = spark.createDataFrame([("n0",), ("n5999",), ("isolated",)], "node_id string")
    assert [tuple(r) for r in patristic.patristic_pairs(chain, ends, 5999).collect()] == [("n0", "n5999", 5999.0)]
    assert patristic.separators_within(chain, 5999).groupBy("node_id").count().agg(F.max("count")).first()[0] <= 64
    star = spark.range(1, 500).selectExpr("cast(id as string) AS edge_id", "'hub' AS source", "concat('s', id) AS target", "if(id < 3, 1D, 3D) AS distance")
    named = star.selectExpr("target AS node_id")
    # All pairs of the far leaves are just beyond the radius: none of them is a candidate.
    assert [tuple(r) for r in patristic.patristic_pairs(star, named, 2.5, 20).collect()] == [("s1", "s2", 2.0)]


def test_exact_decimals(spark):
    edges = spark.createDataFrame([("e", "m", "a", 0.1), ("f", "m", "b", 0.2)], EDGE)
    assert patristic.patristic_pairs(edges, spark.createDataFrame([("a",), ("b",)], "node_id string"), 0.3).count() == 1
    with pytest.raises(ValueError):
        patristic.patristic_pairs(edges.withColumn("distance", F.lit(None).cast("double")), edges.selectExpr("source AS node_id"), 1)
    loop = spark.createDataFrame([("e", "a", "b", 0.0), ("f", "b", "c", 0.0), ("g", "c", "a", 0.0)], EDGE)
    back = spark.createDataFrame([("e", "a", "b", 0.0), ("f", "b", "a", 0.0)], EDGE)
    for local in (None, 0):
        for df in (loop, back):
            with pytest.raises(ValueError):
                patristic.patristic_pairs(df, df.selectExpr("source AS node_id"), 1, local)


def test_jump_depths(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "node_id string, parent string")
    assert sorted((r["node_id"], r["depth"], r["component"]) for r in forest.depths_of(df, Scratch(spark, "t")).collect()) == [("a", 0, "a"), ("b", 1, "a"), ("c", 2, "a")]


def test_hubs_are_cut_into_spans(spark):
    """Next siblings and first children where one parent stands in many ranges."""
    from silvaspan.operators.skew import counted_join, with_next, with_place

    rows = [("hub", f"{k:03d}") for k in range(90)] + [(f"p{k}", "x") for k in range(5)]
    df = spark.createDataFrame(rows, "parent string, node_id string")
    got = {(r["parent"], r["node_id"]): (r["next"], r["first"]) for r in with_next(df, "parent", "node_id", "next", Scratch(spark, "t")).collect()}
    assert got == {(p, v): (f"{int(v) + 1:03d}" if p == "hub" and v != "089" else None, v in ("000", "x")) for p, v in rows}
    placed = with_place(df.repartition(7), ["parent", "node_id"], "k", Scratch(spark, "t")).collect()
    assert sorted((r["k"], r["parent"], r["node_id"]) for r in placed) == [(k, *x) for k, x in enumerate(sorted(rows))]
    names = spark.createDataFrame([("hub", 1), ("p1", 2)], "parent string, n int")
    assert counted_join(df, names, "parent", Scratch(spark, "t"), 10**9).count() == counted_join(df, names, "parent", Scratch(spark, "t"), 95).count() == 91


def test_rerooted_index_equals_a_new_index(spark):
    for seed, wide in ((7, 40), (11, 2)):
        parent = grown(seed, 61, 3, wide)
        edges, roots = frames(spark, parent)
        index = Scratch(spark, "t").save(forest.index_forest(edges, roots), "index")
        deepest = index.orderBy(F.col("depth").desc()).first()["node_id"]
        for node in (deepest, next(v for v, p in parent.items() if p is None)):
            turned, new_roots, _ = forest.reroot(edges, index, node)
            columns = ["node_id", "component", "parent", "depth", "dfs_start", "dfs_end"]
            want = sorted(map(tuple, forest.index_forest(turned, new_roots).select(*columns).collect()))
            assert sorted(map(tuple, forest.rerooted_index(index, node).select(*columns).collect())) == want
    with pytest.raises(ValueError):
        forest.rerooted_index(index, "nobody")


def test_spanning_tree_over_thousands_of_loci(spark, monkeypatch):
    """Far components are joined by pivots: Kruskal's tree, from fewer candidates than there are pairs."""
    draw, loci, rows = random.Random(31), 3000, []
    for c, size in enumerate((14, 9, 6, 5, 4)):
        # Centres on a line, members around each.
        centre = [f"{1 + (k < 420 * c)}" if c else "1" for k in range(loci)]
        for m in range(size):
            own = list(centre)
            for k in draw.sample(range(loci), draw.randrange(1, 60)):
                own[k] = f"m{draw.randrange(40)}"
            rows.append((f"c{c}m{m:02d}", 100 * c + m, own))
    df = spark.createDataFrame(rows, "isolate_id string, input_pos long, alleles array<string>")
    kept = profiles.drop_incomplete_loci(df)
    groups = Scratch(spark, "t").save(profiles.group_profiles(kept), "groups")
    every = {(a[0], b[0]): sum(x != y for x, y in zip(a[2], b[2])) for a, b in itertools.combinations(rows, 2)}
    root, want = {r[0]: r[0] for r in rows}, set()

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for (a, b), d in sorted(every.items(), key=lambda x: (x[1], x[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, d))
    counted, plain = [], profiles.foreign_candidates
    monkeypatch.setattr(profiles, "foreign_candidates", lambda *a: counted.append(plain(*a).count()) or plain(*a))
    monkeypatch.setattr(profiles, "BANDS", 10**6)
    assert {tuple(r) for r in profiles.spanning_forest(groups).collect()} == want
    assert max(counted) < len(every) and counted
    near = sorted((a, b, d) for (a, b), d in every.items() if d <= 70)
    assert sorted(map(tuple, profiles.allelic_pairs(groups, 70).collect())) == near and near


def test_pairs_at_one_separator_are_many_tasks(spark, monkeypatch):
    spokes = [(f"e{k}", "h", f"s{k:03d}", float(k % 7) / 2) for k in range(60)] + [("f", "s059", "far", 50.0), ("g", "far", "leaf", 1.0)]
    edges = spark.createDataFrame(spokes, "edge_id string, source string, target string, distance double")
    named = edges.selectExpr("target AS node_id")
    # What hangs from an edge beyond the radius is left to itself, and the hub's spokes are dealt into tiles and tasks.
    monkeypatch.setattr(patristic, "TILE", 4)
    monkeypatch.setattr(patristic, "WORK", 20)
    d = {t: w for _, s, t, w in spokes if s == "h"}
    want = {(a, b, d[a] + d[b]) for a in d for b in d if a < b and d[a] + d[b] <= 3} | {("far", "leaf", 1.0)}
    found = patristic.patristic_pairs(edges, named, 3)
    assert found.count() == len(want) and {tuple(r) for r in found.collect()} == want
    assert found.rdd.getNumPartitions() > 10


def test_clusters_of_paths_are_those_of_the_preorder(spark, monkeypatch):
    cuts = spark.createDataFrame([(0, 0), (1, 2), (2, 5)], "level int, cut int")
    edges, roots = frames(spark, grown(7, 60, 4, 9))
    want = {tuple(r) for r in tiers.clusters_at(forest.index_forest(edges, roots), cuts).collect()}
    for narrow in (1 << 15, 0):
        monkeypatch.setattr(forest, "NARROW", narrow)
        paths = forest.forest_paths(edges, roots)
        assert {tuple(r) for r in tiers.clusters_at(paths, cuts).collect()} == want
    monkeypatch.setattr(forest, "LEVELS", 2)
    assert forest.forest_paths(edges, roots) is None
    with pytest.raises(ValueError):
        forest.forest_paths(edges.where("source <> 'none'").unionByName(spark.createDataFrame([("x", "lost", "found", 1.0)], EDGE)), roots)


def test_dense_graphs_are_thinned(spark):
    rng = random.Random(5)
    pairs = {(x, y) for x, y in ((rng.randrange(60), rng.randrange(60)) for _ in range(3000)) if x > y and x % 2 == y % 2}
    edges = spark.createDataFrame([(f"n{x:02d}", f"n{y:02d}") for x, y in pairs], "u string, v string").where("u > v")
    assert components._thinned(edges, 2).count() <= 2 * 58 < edges.count()
    for local in (0, 80, 1 << 16):
        got = {r["node"]: r["component"] for r in components_of_edges(edges, "u", "v", local).collect()}
        assert got == {f"n{k:02d}": f"n{k % 2:02d}" for k in range(60)}, local


def test_hamming_candidates_tell_the_tasks(spark, monkeypatch):
    """Small tables are one shuffle partition to Spark, however many pairs they have."""
    rows = [(f"p{k}", [str(k % 2), str(k % 3), str(k % 5), str(k % 4)]) for k in range(60)]
    groups = spark.createDataFrame(rows, "node_id string, alleles array<string>")
    want = {(x, y, d) for (x, a), (y, b) in itertools.combinations(sorted(rows), 2) if (d := sum(i != j for i, j in zip(a, b))) <= 2}
    assert {tuple(r) for r in profiles.allelic_pairs(groups, 2).collect()} == want
    monkeypatch.setattr(profiles, "WORK", 64)
    dealt = profiles.allelic_pairs(groups, 2)
    assert {tuple(r) for r in dealt.collect()} == want
    assert dealt.select(F.spark_partition_id()).distinct().count() > 8


def test_open_groups_go_on_from_round_to_round(spark):
    """The groups after a merge, from the open ones before, are those of the merged profiles."""
    scratch = Scratch(spark, "open")
    nodes = spark.createDataFrame([(f"p{k}", [k % 2, k % 3, k % 5], k % 4, f"p{k}") for k in range(30)], "node_id string, h array<long>, lv long, component string")
    merged = spark.createDataFrame([(f"p{k}", f"p{k % 7}") for k in range(30)], "node string, new string")
    later = nodes.join(merged, nodes["component"] == merged["node"]).select("node_id", "h", "lv", F.col("new").alias("component"))
    rows = lambda per: sorted(map(str, profiles._open_groups(per, scratch).collect()))
    met = profiles._open_groups(profiles._own_groups(nodes, 3, 2), scratch)
    assert rows(profiles._merged_groups(met, merged)) == rows(profiles._own_groups(later, 3, 2)) != []
