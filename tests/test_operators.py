import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaspan.functions import labels
from silvaspan.operators import annotations, bundles, forest, metadata, newick, patristic, profiles, quality, reads, stats, summaries, tiers
from silvaspan.sources import versions

CELLS = "cluster_id string, row_pos long, key string, value string"


def column(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(f(F.col("t"))).collect()]


def test_labels(spark):
    assert column(spark, ["A b", "__x--Y__", "é", "", None], labels.slugify) == ["a_b", "x_y", "", "", None]
    texts = ["1", "1.5", "01", "0", "-0.5", "1_000", "1__0", "90D", "0x1", "1e3", "1e999", "nan", "inf", ".5", "5.", "", "a", None]
    want = [True, True, False, True, True, True, False, False, False, True, False, False, False, True, True, False, False, False]
    assert column(spark, texts, labels.is_number_literal) == want
    assert column(spark, ["TRUE", "False", "1", None], labels.is_boolean_literal) == [True, True, False, None]
    assert column(spark, ["1.0", "2.5", "1_000"], lambda c: labels.to_category_text(c, F.lit("number"))) == ["1", "2.5", "1000"]
    assert column(spark, ["TRUE", "false"], lambda c: labels.to_category_text(c, F.lit("boolean"))) == ["True", "False"]
    assert column(spark, ["a b+c/é"], labels.percent_encode) == ["a%20b%2Bc%2F%C3%A9"]
    assert column(spark, ["a%20b%2Bc%2F%C3%A9"], labels.percent_decode) == ["a b+c/é"]
    assert column(spark, [" ", " x "], labels.blank_to_null) == [None, "x"]
    with pytest.raises(ValueError):
        labels.reject_reserved(spark.range(1).withColumn("__category_count__a", F.lit(1)))


def test_status(spark):
    def of(*s):
        return spark.createDataFrame([(x,) for x in s], "s string").agg(labels.aggregate_status("s")).first()[0]

    assert [of(), of("ready", "failed"), of("ready", "degraded"), of("ready"), of("ready", "pending")] == ["pending", "failed", "degraded", "ready", "refining"]


def test_cluster_aggregate(spark):
    columns = {"colour": ["red", "blue", "blue", None], "weight": ["1.5", "2", "4", "2.5"], "wet": ["false", "false", "true", "false"], "lost": [None] * 4}
    rows = [("left", k, key, v) for key, own in columns.items() for k, v in enumerate(own)]
    rows += [("right", 8, "colour", "violet"), ("right", 9, "colour", "amber")]
    cells = spark.createDataFrame(rows, CELLS)
    got = {(r["cluster_id"], r["key"]): r["value"] for r in summaries.aggregate_cluster(cells, annotations.infer_types(cells)).collect()}
    assert got == {("left", "colour"): "blue", ("left", "weight"): "2.5", ("left", "wet"): "false", ("right", "colour"): "amber"}


def test_top_categories_separate_and_forced(spark):
    dist = spark.createDataFrame([(f"k{k:02d}", 20 - k) for k in range(15)], "category string, n long")
    got = {r["category"]: r["n"] for r in summaries.top_categories(dist, 5, separate=["k14", "k13"], other=["k00"]).collect()}
    assert got == {"k13": 7, "k14": 6, "k01": 19, "k02": 18, "Other": sum(range(6, 21)) - 7 - 6 - 19 - 18}
    assert summaries.top_categories(dist.limit(5), 5).where("category = 'Other'").count() == 0


def test_merge_and_validation(spark):
    direct = spark.createDataFrame([("a", "x", None), ("a", "y", "1")], "node_id string, key string, value string")
    table = spark.createDataFrame([("a", "x", "old"), ("b", "x", "kept")], "node_id string, key string, value string")
    assert {(r["node_id"], r["key"]): r["value"] for r in annotations.merge_annotations(direct, table).collect()} == {("a", "x"): None, ("a", "y"): "1", ("b", "x"): "kept"}
    types = spark.createDataFrame([("x", "number")], "key string, type string")
    nodes = spark.createDataFrame([("a",)], "node_id string")
    got = sorted((r["violation"], r["subject"]) for r in annotations.validate_annotations(table.unionByName(direct), nodes, types).collect())
    assert got == [("type mismatch", "a/x"), ("type mismatch", "b/x"), ("undeclared key", "y"), ("unknown node", "b")]
    members = spark.createDataFrame([("a", "i"), ("a", None), ("c", "i"), ("c", "k")], "node_id string, isolate_id string")
    got = sorted((r["violation"], r["subject"]) for r in annotations.validate_annotations(direct.limit(0), nodes, types, members).collect())
    assert got == [("empty membership", "a"), ("isolate in two nodes", "i"), ("membership of unknown node", "c")]
    assert {r["key"]: r["type"] for r in annotations.infer_schema(table, types).collect()} == {"x": "number"}


def test_overrides_and_isolates(spark):
    cells = spark.createDataFrame([("a", "n", "1"), ("a", "n", "2"), ("a", "b", "true"), ("a", "b", "false")], "node_id string, key string, value string")
    types = spark.createDataFrame([("n", "number"), ("b", "boolean")], "key string, type string")
    assert {r["key"]: r["value"] for r in annotations.declared_overrides(cells, types).collect()} == {"n": "1.5", "b": None}
    members = spark.createDataFrame([("p", "I 1", "i_1"), ("p", "I 2", "i_2")], "node_id string, isolate_id string, isolate_norm string")
    rows = spark.createDataFrame([("i_1", "k", "v")], "join_id string, key string, value string")
    assert {r["isolate_id"]: r["data"] for r in annotations.attach_isolates(members, rows).collect()} == {"I 1": {"k": "v"}, "I 2": {}}
    faults = annotations.isolate_faults(members, spark.createDataFrame([("i_1",), ("i_1",), ("zz",)], "join_id string"))
    assert {tuple(r) for r in faults.collect()} == {("several rows", "i_1"), ("unknown isolate", "zz")}


def test_versions_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    nodes = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "node_id string, x double")
    one = versions.layout_version({"nodes": nodes})
    assert one == versions.layout_version({"nodes": nodes.repartition(5)}) != versions.layout_version({"nodes": nodes}, "other")
    assert one != versions.layout_version({"nodes": nodes.limit(1)})
    versions.write_version({"nodes": nodes}, root, "d", one)
    versions.publish(spark, root, "d", one)
    notes = spark.createDataFrame([("a", "k", "v")], "node_id string, key string, value string")
    two = versions.replace_annotations(spark, root, "d", one, notes)
    assert two == versions.replace_annotations(spark, root, "d", one, notes) != one
    assert versions.latest_version(spark.read.schema(versions.MANIFEST).parquet(f"{root}/manifest")).first()["layout_version"] == two
    assert versions.read_geometry(spark, root, "nodes", "d", two).count() == 2
    with pytest.raises(ValueError):
        versions.replace_annotations(spark, root, "d", one, notes.withColumn("node_id", F.lit("none")))
    versions.clear(spark, root, ["annotations"], "d", two)
    assert spark.read.schema(versions.MANIFEST).parquet(f"{root}/manifest").where("status = 'cleared'").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("ID\tL1\tL2\nx\t1\t0\ny\t1\t2\n")
    got = versions.read_profiles(spark, str(tmp_path / "p.tsv")).orderBy("input_pos").collect()
    assert [(r["isolate_id"], r["alleles"]) for r in got] == [("x", ["1", "0"]), ("y", ["1", "2"])]
    (tmp_path / "bad.tsv").write_text("ID\tL1\nx\t1\nx\t\n")
    with pytest.raises(ValueError):
        versions.read_profiles(spark, str(tmp_path / "bad.tsv"))
    assert versions.read_annotations(spark, str(tmp_path / "p.tsv")).columns == ["ID", "L1", "L2"]
    (tmp_path / "ragged.tsv").write_text("ID\tL1\tL2\nx\t1\t2\ny\t1\t2\t3\n")
    with pytest.raises(ValueError):
        versions.read_profiles(spark, str(tmp_path / "ragged.tsv"))
    lines = spark.createDataFrame([(0, "3"), (1, "a"), (2, "b 1"), (3, "c 2 3")], "line_no int, value string")
    members = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r")], "id string, profile string")
    assert profiles.triangular_faults(lines, members, 3).count() == 0
    bad = spark.createDataFrame([(0, "4"), (1, "a"), (2, "b 0"), (3, "d 2 9 1"), (4, "d x 1 1")], "line_no int, value string")
    assert {r["fault"]: r["n"] for r in profiles.triangular_faults(bad, members, 3).collect()} == {"row length": 1, "repeated id": 1, "unknown id": 2, "bad distance": 2, "zero and equality": 1}
    assert sorted(tuple(r) for r in profiles.triangular_pairs(lines).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 3)]


def test_reads(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 9.0, 9.0), ("d", 8.0, 9.0)], "node_id string, x double, y double")
    edges = spark.createDataFrame([("e1", "a", "b", 1.0), ("e2", "b", "c", 1.0), ("e3", "c", "d", 1.0)], "edge_id string, source string, target string, distance double")
    asked = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], "request_id int, x0 double, x1 double, y0 double, y1 double")
    shown, links = reads.viewport_detail(asked, nodes, edges, 10)
    assert sorted((r["node_id"], r["inside"]) for r in shown.collect()) == [("a", True), ("b", True), ("c", False)]
    assert sorted(r["edge_id"] for r in links.collect()) == ["e1", "e2"]
    clusters = spark.createDataFrame([("k", 0, "a", "a"), ("k", 0, "b", "a"), ("m", 0, "c", "c"), ("m", 0, "d", "c")], "cluster_id string, level int, node_id string, representative string")
    want = spark.createDataFrame([(1, "k", "b")], "request_id int, cluster_id string, focus string")
    members, inner, out = reads.viewport_expand(want, clusters, nodes, edges, 1)
    assert [r["node_id"] for r in members.collect()] == ["b"] and members.first()["truncated"] and inner.count() == 0
    assert [(r["inner"], r["outer_representative"]) for r in out.collect()] == [("b", "c")]
    counts = spark.createDataFrame([(1, 0, 5), (1, 1, 40), (1, 2, 90), (1, -1, 500)], "request_id int, level int, n long")

    def tier(preferred, target, previous=None):
        return reads.choose_tier(counts, spark.createDataFrame([(1, preferred, float(target), previous)], "request_id int, preferred int, target double, previous int")).first()["level"]

    assert (tier(2, 50), tier(0, 50), tier(2, 1), tier(2, 80, 2), tier(2, 1000)) == (1, 0, 0, 2, 2)

    def pick(own, preferred, target, previous=None):
        df = spark.createDataFrame([(1, k, n) for k, n in own.items()] or [(2, 0, 0)], "request_id int, level int, n long")
        return reads.choose_tier(df, spark.createDataFrame([(1, preferred, float(target), previous)], "request_id int, preferred int, target double, previous int")).first()["level"]

    # A previous tier over its bound is let go; within it, it yields to the finest comfortable one only; no tiers: the preferred one.
    assert pick({1: 200, 2: 80, 3: 95}, 3, 100, 1) == 3 and pick({1: 110, 2: 80, 3: 95}, 3, 100, 1) == 2
    assert pick({0: 50, 1: 90}, 1, 100, 0) == 0 and pick({0: 50, 1: 114}, 1, 100, 1) == 1 and pick({0: 50, 1: 116}, 1, 100, 1) == 0
    assert pick({}, 2, 9) == 2 and pick({0: 0, 1: 0}, 1, 9) == 1
    with pytest.raises(ValueError):
        pick({0: 1}, 0, 0)
    with pytest.raises(ValueError):
        reads.require_at_most(nodes, 3)
    with pytest.raises(ValueError):
        reads.require_same_ids(nodes, nodes.limit(2))
    assert {r["node_id"]: r["x"] for r in reads.delta_annotations(nodes, nodes.where("node_id = 'a'"), "node_id").collect()}["a"] is None


def test_composed_view(spark):
    node, edge = "node_id string, cluster_id string, proxy boolean, pos long", "edge_id string, source string, target string"
    base = spark.createDataFrame([("r", None, False, 0), ("p", "c1", True, 1), ("q", "c2", True, 2)], node), spark.createDataFrame([("1", "r", "p"), ("2", "r", "q")], edge)
    patch = spark.createDataFrame([("a", "c1", False, 0, 0), ("b", "c1", False, 1, 0), ("q", "c2", True, 2, 0), ("b", "c1", False, 9, 1)], f"{node}, patch int"), spark.createDataFrame([("3", "a", "b", 0, False), ("4", "p", "r", 0, True), ("5", "r", "a", 0, False), ("3", "b", "a", 1, False)], f"{edge}, patch int, boundary boolean")
    nodes, edges = reads.compose_expansion(base, patch, 3, "b")
    assert [(r["node_id"], r["pos"], r["partial"]) for r in nodes.collect()] == [("b", 9, True), ("r", 0, True), ("q", 2, True)]
    assert {tuple(r) for r in edges.collect()} == {("2", "r", "q")}
    nodes, edges = reads.compose_expansion(base, patch, 10, "b")
    assert {r["node_id"] for r in nodes.where("not partial").collect()} == {"r", "q", "a", "b"}
    assert {tuple(r) for r in edges.collect()} == {("2", "r", "q"), ("3", "b", "a"), ("5", "r", "a")}


def test_layout_quality_and_audit(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1000.0, 700.0), ("c", 0.0, 700.0), ("d", 1000.0, 0.0), ("e", 1.0, 1.0)], "node_id string, x double, y double")
    edges = spark.createDataFrame([("1", "a", "b", 1.0), ("2", "c", "d", 2.0), ("3", "a", "c", 3.0)], "edge_id string, source string, target string, distance double")
    assert tuple(quality.layout_quality(nodes, edges).first()) == (1, 1)
    other = spark.createDataFrame([("b", "a", 1.0), ("c", "d", 9.0)], "source string, target string, distance double")
    assert {r["measure"]: r["n"] for r in quality.audit_exports(edges, other).collect()} == {"shared": 2, "first only": 1, "second only": 0, "other distance": 1}


def test_crossings_of_dense_cells(spark, monkeypatch):
    places = [(f"n{k}", k * 0.6180339887 % 1, k * 0.4142135623 % 1) for k in range(90)]
    ends = [(k, f"n{k * 31 % 90}", f"n{(k * 53 + 7) % 90}") for k in range(160)]
    nodes, edges = spark.createDataFrame(places, "node_id string, x double, y double"), spark.createDataFrame([e for e in ends if e[1] != e[2]], "edge_id long, source string, target string")
    at = {n: (x, y) for n, x, y in places}

    def side(p, a, b):
        return (at[b][0] - at[a][0]) * (at[p][1] - at[a][1]) - (at[b][1] - at[a][1]) * (at[p][0] - at[a][0])

    own = [e for e in ends if e[1] != e[2]]
    plain = sum(len({a, b, c, d}) == 4 and side(c, a, b) * side(d, a, b) < 0 and side(a, c, d) * side(b, c, d) < 0 for i, a, b in own for j, c, d in own if i < j)
    for dense, tile, cell in ((2, 50, 300.0), (10**6, 2048, 300.0)):
        monkeypatch.setattr(quality, "DENSE", dense)
        monkeypatch.setattr(quality, "TILE", tile)
        found = quality.layout_quality(nodes, edges, cell)
        assert found.first()["crossings"] == plain
        # The rows of all cells never travel to the driver to be broadcast.
        assert "BroadcastHashJoin [cx" not in found._jdf.queryExecution().toString() and "BroadcastHashJoin [gx" not in found._jdf.queryExecution().toString()


def test_crossings_of_upright_edges(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 700.0), ("c", 500.0, 0.0), ("d", 500.0, 700.0)] + [(f"{s}{k}", x, 690.0 - 70 * k) for s, x in (("l", 400.0), ("r", 1000.0)) for k in range(9)], "node_id string, x double, y double")
    edges = spark.createDataFrame([(0, "c", "d")] + [(k + 1, f"l{k}", f"r{k}") for k in range(9)], "edge_id long, source string, target string")
    assert quality.layout_quality(nodes, edges, 100.0).first()["crossings"] == 9
    assert quality.layout_quality(nodes, edges.selectExpr("edge_id", "target AS source", "source AS target"), 100.0).first()["crossings"] == 9


def test_crossings_of_stars(spark, monkeypatch):
    # Places on a small grid: many ends lie on one line with a centre, on the line of two centres or on each other.
    places = [(f"n{k}", float(k * 7 % 13), float(k * 5 % 11) * 0.7) for k in range(150)]
    ends = [(k, f"n{(0, 1, 2, 3, 40 + k)[k % 5]}", f"n{(k * 53 + 7) % 150}") for k in range(300)]
    nodes, edges = spark.createDataFrame(places, "node_id string, x double, y double"), spark.createDataFrame(ends, "edge_id long, source string, target string")
    monkeypatch.setattr(quality.stars, "LEAST", 10**6)
    plain = tuple(quality.layout_quality(nodes, edges, radius=30.0).first())
    for least, tile in ((20, 16), (20, 1 << 18), (2, 1 << 18)):
        monkeypatch.setattr(quality.stars, "LEAST", least)
        monkeypatch.setattr(quality.stars, "STAR", tile)
        assert tuple(quality.layout_quality(nodes, edges, radius=30.0).first()) == plain and min(plain) > 0
    # Stars alone: no row for a cell, and copies of an end are one for each other star, not one for each pair of tiles.
    found = quality.layout_quality(nodes, edges.where("edge_id % 5 < 4"), radius=30.0)
    assert "cx" not in found._jdf.queryExecution().toString()
    # An edge id that repeats: equal ids do not cross.
    twice = edges.selectExpr("edge_id % 60 AS edge_id", "source", "target")
    monkeypatch.setattr(quality.stars, "LEAST", 10**6)
    plain = quality.layout_quality(nodes, twice).first()["crossings"]
    monkeypatch.setattr(quality.stars, "LEAST", 2)
    assert quality.layout_quality(nodes, twice).first()["crossings"] == plain


def test_stars_against_all_pairs():
    random = np.random.default_rng(1)
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    for scale, most in ((8.3532 / 99, 40), (1e-3 / 7, 4), (8.3532 / 3, 6), (1.0, 10**6)):
        for _ in range(100):
            a, b, p, q = (random.integers(0, most, s) * scale for s in ((2,), (2,), (30, 2), (40, 2)))
            u, v = (p - a)[:, None], (q - b)[None]
            plain = (cross(u, b - a) * cross(u, q[None] - a) < 0) & (cross(v, a - b) * cross(v, p[:, None] - b) < 0)
            assert quality.stars.star_crossings(a, b, p, q) == np.count_nonzero(plain)


def test_known_revisions_and_quotients_of_prepared_forests(spark, tmp_path, monkeypatch):
    nodes = spark.createDataFrame([(f"n{k}", float(k), 1.0) for k in range(40)], "node_id string, x double, y double")
    edges = spark.createDataFrame([(f"e{k}", f"n{(k - 1) // 2}", f"n{k}", 1.0) for k in range(1, 40) if k != 20], "edge_id string, source string, target string, distance double")
    roots = spark.createDataFrame([("n0", 0), ("n20", 1)], "node_id string, root_pos long")
    values = spark.createDataFrame([("n1", "k", "v")], "node_id string, key string, value string")
    found = bundles.Forest(nodes.select("node_id"), edges, roots, values, spark.createDataFrame([("k", "string")], "key string, type string"), spark.createDataFrame([], "message string"), "given")
    for small in (0, 2):
        tables = bundles.prepare(found, nodes, small)
        rows = {tuple(r) for r in tables["quotient"].collect()}
        assert rows and rows == {tuple(r) for r in tiers.quotient_edges(tables["clusters"], edges).select(*tables["quotient"].columns).collect()}
    assert bundles.tiers.clusters_at(forest.index_forest(edges, roots), spark.createDataFrame([], "level int, cut int")).count() == 0
    root = f"file://{tmp_path}/store"
    one = bundles.publish_prepared(spark, root, "d", found, tables)
    two = bundles.publish_root_revision(spark, root, "d", one, "n7").version
    # Versions in print are known by their contents, before anything is prepared.
    monkeypatch.setattr(bundles, "prepare", None)
    assert bundles.publish_root_revision(spark, root, "d", two, None).version == one and bundles.publish_root_revision(spark, root, "d", one, "n7").version == two != one


def test_rows_of_one_field_meet_no_part_of_the_types_twice(spark):
    cells = spark.createDataFrame([("a", 0, "1"), ("a", 1, "4"), ("b", 2, None)], "node_id string, row_pos long, value string").withColumn("key", F.lit("k"))
    got = annotations.aggregate_rows(cells, annotations.infer_types(cells))
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert [(r["node_id"], r["value"], r["rows"]) for r in got.collect()] == [("a", "1;4", 2)]


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1, "v1", "success", 1.0, 3.0, False), ("a", 2, "v2", "success", 2.0, 1.0, False), ("b", 1, "v1", "failure", None, 1.0, True)], "k string, i int, id string, s string, t0 double, t1 double, w boolean")
    assert {r["s"] for r in stats.invalidate_mixed(df, ["k"], "id", "s").collect()} == {"invalid", "failure"}
    assert [r[0] for r in df.orderBy("k", "i").select(stats.duration_metric(F.col("t0"), F.col("t1"))).collect()] == [2.0, None, None]
    ends = spark.createDataFrame([(1.0, float("inf")), (float("-inf"), 1.0), (float("nan"), 1.0), (2.0, 2.0)], "a double, b double")
    assert [r[0] for r in ends.select(stats.duration_metric(F.col("a"), F.col("b"))).collect()] == [None, None, None, 0.0]
    assert stats.measured(df.withColumn("f", F.col("s") == "failure"), "w", "f").count() == 2
    with pytest.raises(ValueError):
        stats.compare_systems(df, df.where("k = 'a'"), ["k"], "t1")
    assert stats.combine_runs(df, df.where("k = 'a'").limit(1), ["k"]).count() == 2
    runs = tiers.runs(spark.createDataFrame([(k, v) for k, v in enumerate("aabba")], "o int, v string"), "o", "v")
    assert sorted(tuple(r) for r in runs.collect()) == [("a", 0, 2), ("a", 4, 1), ("b", 2, 2)]
    audit = stats.audit_event_phases(spark.createDataFrame([("k", 1, 0.0, 1.0, 9.0), ("k", 2, 0.0, 0.5, 9.0), ("k", 3, 0.0, 10.0, 9.0)], "k string, o int, s double, t double, e double"), "k", "o", "s", "t", "e")
    assert tuple(audit.first()) == ("k", 3, 1, 1)


def test_cluster_annotations_pair_no_value_with_every_part_of_the_types(spark):
    """With one field the join on it has no key left; the values of two tiers stay apart."""
    clusters = spark.createDataFrame([(0, "lod_0_r", "a"), (0, "lod_0_r", "b"), (1, "lod_1_a", "a"), (1, "lod_1_b", "b")], "level int, cluster_id string, node_id string")
    cells = spark.createDataFrame([("a", "1"), ("b", "4"), ("c", "9"), ("b", None)], "node_id string, value string").withColumn("key", F.lit("k"))
    got = metadata.cluster_annotations(clusters, cells, spark.createDataFrame([("k", "number")], "key string, type string"))
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == {(0, "lod_0_r", "k", "2.5"), (1, "lod_1_a", "k", "1.0"), (1, "lod_1_b", "k", "4.0")}
    got = metadata.cluster_annotations(clusters, cells, spark.createDataFrame([("k", "string")], "key string, type string"))
    assert {tuple(r) for r in got.collect()} == {(0, "lod_0_r", "k", "1"), (1, "lod_1_a", "k", "1"), (1, "lod_1_b", "k", "4")}


def test_ingest_newick_and_publish(spark, tmp_path):
    docs = spark.createDataFrame([("d", "((A:1,B:9)X:2,'C d':3)R;")], "doc_id string, content string")
    cells = spark.createDataFrame([(0, "A", "score", "1"), (1, "c d", "score", "3"), (2, "nobody", "score", "4")], "row_pos long, join_id string, key string, value string")
    direct = spark.createDataFrame([("b", "score", "7")], "id string, key string, value string")
    found = bundles.ingest_newick(docs, cells, direct, spark.createDataFrame([("score", "number")], "key string, type string"), cutoff=5.0)
    assert tuple(found.counts().first())[:3] == (5, 3, 2) and found.cutoff == 5.0
    assert {r["node_id"]: r["value"] for r in found.values.collect()} == {"a": "1", "c_d": "3", "b": "7"}
    told = {r["message"] for r in found.warnings.collect()}
    assert "row without node: 1" in told and any(m.endswith("roots: 2") for m in told)
    places = found.nodes.withColumn("x", F.length("node_id").cast("double")).withColumn("y", F.lit(0.0))
    tables = bundles.prepare(found, places, small=0)
    row = bundles.preparation_summary(found, tables).first()
    assert (row["nodes"], row["edges"], row["roots"], row["strategy"], row["cutoff"]) == (5, 3, 2, "newick", 5.0) and row["tiers"] >= 1
    root = f"file://{tmp_path}/store"
    one = bundles.publish_prepared(spark, root, "d", found, tables)
    assert bundles.publish_prepared(spark, root, "d", found, tables) == one
    states = [r["status"] for r in spark.read.schema(versions.MANIFEST).parquet(f"{root}/manifest").orderBy("updated_at").collect()]
    assert states == ["refining", "ready"]
    two = bundles.publish_root_revision(spark, root, "d", one, "a")
    assert {tuple(r) for r in two.components.collect()} == {("r", "a"), ("b", "b")} and {r[0] for r in two.defaults.collect()} == {"r", "b"}
    index = {r["node_id"]: r["parent"] for r in versions.read_version(spark, root, "tree_index", "d", two.version).collect()}
    assert index == {"a": None, "x": "a", "r": "x", "c_d": "r", "b": None} and two.version != one
    settings = versions.read_version(spark, root, "settings", "d", two.version).first()
    assert (settings["strategy"], settings["default_strategy"], settings["cutoff"], settings["small"]) == ("user", "newick", 5.0, 0)
    assert bundles.publish_root_revision(spark, root, "d", two.version, "a").version == two.version
    # Annotations of a table: the geometry is shared, also by a revision that follows.
    three = bundles.replace_annotations(spark, root, "d", two.version, spark.createDataFrame([(0, "A", "kind", "x"), (1, "a", "kind", "y"), (2, "r", "kind", "z"), (3, "none", "kind", "z")], "row_pos long, join_id string, key string, value string"))
    assert three.matched == 2 and {r[0] for r in three.warnings.collect()} == {"row without node: 1", "node without row: 3"} and [tuple(r) for r in three.types.collect()] == [("kind", "string")]
    with pytest.raises(ValueError, match="matches no node"):
        bundles.replace_annotations(spark, root, "d", two.version, spark.createDataFrame([(0, "none", "kind", "x")], "row_pos long, join_id string, key string, value string"))
    back = bundles.publish_root_revision(spark, root, "d", three.version, None)
    assert {r["node_id"]: r["parent"] for r in versions.read_version(spark, root, "tree_index", "d", back.version).collect()}["r"] is None
    assert {(r["node_id"], r["value"]) for r in versions.read_version(spark, root, "annotations", "d", back.version).collect()} == {("a", "x;y"), ("r", "z")}
    assert versions.read_version(spark, root, "settings", "d", back.version).first()["strategy"] == "newick"
    assert {tuple(r) for r in back.components.collect()} == {("a", "r"), ("b", "b")}
    # Back at the roots of the beginning, with the annotations of the beginning, it is the first version again.
    assert bundles.publish_root_revision(spark, root, "d", two.version, None).version == one
    with pytest.raises(ValueError):
        bundles.publish_root_revision(spark, root, "d", one, "nobody")
    with pytest.raises(ValueError):
        bundles.ingest_newick(spark.createDataFrame([("d", "(A,B;")], "doc_id string, content string"))
    with pytest.raises(ValueError):
        bundles.ingest_newick(docs, direct=spark.createDataFrame([("b", "score", "x")], "id string, key string, value string"), declared=spark.createDataFrame([("other", "number")], "key string, type string"))


def test_direct_records_name_an_isolate_once(spark):
    members = spark.createDataFrame([("I 1", "i_1")], "isolate_id string, isolate_norm string")
    rows = spark.createDataFrame([("I 1", "k", "v"), ("i_1", "k", "w")], "id string, key string, value string")
    with pytest.raises(ValueError):
        metadata.direct_annotations(rows, members)
    assert metadata.direct_annotations(rows.limit(1), members).first()["node_id"] == "i_1"


def test_strict_documents_hold_one_tree(spark):
    docs = spark.createDataFrame([("one", "(A,B)R;"), ("two", "(A,B)R;(C,D)S;"), ("trailing", "(A,B)R;EXTRA")], "doc_id string, content string")
    assert {r["doc_id"] for r in newick.parse_forests(docs, strict=True)["errors"].collect()} == {"two", "trailing"}
    assert newick.parse_forests(docs)["errors"].count() == 0


def test_policies(spark):
    sizes = spark.createDataFrame([(d, r) for d, r in enumerate([1, 3, 4, 9, 10, 40])], "depth long, visible long")
    got = {r["policy"]: r["cuts"] for r in tiers.compare_policies(sizes).collect()}
    # Twice 1 is passed by 3, twice 3 by 9, twice 9 by the last; nearest prefers 4 to 9 about 6, then 9 about 8, then 10 and 40 about 18.
    assert got == {"threshold": [0, 1, 3, 5], "nearest": [0, 1, 2, 3, 4, 5], "doubling": [0, 1, 2, 4, 5]}


def test_overlay_thresholds(spark):
    for value, whole in ((-1, False), (float("inf"), False), (1.5, True), (True, False)):
        with pytest.raises(ValueError):
            patristic.check_threshold(value, whole)
    patristic.check_threshold(2.0, True)


def test_profile_overlay_and_fold_edits(spark):
    rows = [("A", 0, list("1111")), ("B", 1, list("1112")), ("C", 2, list("1122")), ("D", 3, list("9999"))]
    found = bundles.ingest_profiles(spark.createDataFrame(rows, "isolate_id string, input_pos long, alleles array<string>"), 3, 2)
    index = forest.index_forest(found.edges, found.roots)
    groups = profiles.group_profiles(spark.createDataFrame(rows, "isolate_id string, input_pos long, alleles array<string>"))
    assert [tuple(r) for r in patristic.overlay_profiles(groups, index, found.edges, 2).collect()] == [("distance:a:c", "a", "c", 2)]
    with pytest.raises(ValueError):
        patristic.overlay_profiles(groups, index, found.edges, 2, most=0)
    folds = reads.collapse_roots(index.limit(0).select("component", "node_id", "dfs_start", "dfs_end"), index)
    assert [r["node_id"] for r in folds.collect()] == ["b"] and reads.unfold(folds, "b").count() == 0
    assert reads.collapse(folds, index, "d").count() == 1


def test_leaves_of_a_forest_go_through_no_rounds(spark, monkeypatch):
    """A forest is taken apart leaf by leaf; loops, pairs, parallel edges, stars and a cycle keep the smallest node of each component."""
    from silvaspan.operators import components as C

    saved, save = [], C.Scratch.save
    monkeypatch.setattr(C.Scratch, "save", lambda self, df, name="t": saved.append(name) or save(self, df, name))
    tree = [(k, (k - 1) // 5) for k in range(1, 120)]
    odd = [(500, 501), (501, 500), (600, 600), (700, None)] + [(800, 801 + k) for k in range(9)] + [(899 - k, 890) for k in range(5)]
    got = {r["node"]: r["component"] for r in C.components_of_edges(spark.createDataFrame(tree + odd, "a long, b long"), local=0).collect()}
    assert got == {k: 0 for k in range(120)} | {500: 500, 501: 500, 600: 600} | {k: 800 for k in range(800, 810)} | {k: 890 for k in [890, *range(895, 900)]}
    assert "small" not in saved
    ring = [(k, (k + 1) % 7) for k in range(7)] + [(k % 7, 10 + k) for k in range(30)]
    got = {r["node"]: r["component"] for r in C.components_of_edges(spark.createDataFrame(ring, "a long, b long"), local=0).collect()}
    assert got == {k: 0 for k in [*range(7), *range(10, 40)]} and "small" in saved


def test_search_sizes_are_those_of_the_stored_pieces(spark, tmp_path):
    from silvaspan.operators import search

    ids = spark.createDataFrame([("abc",), ("abcd",), ("b",)], "node_id string")
    none = spark.createDataFrame([], "node_id string, key string, value string"), spark.createDataFrame([], "node_id string, isolate_id string")
    tables = search.search_tables(ids, *none)
    want = {tuple(r) for r in tables.pop("sizes").collect()}
    stored = search.write_search(tables, str(tmp_path / "index"))
    assert {tuple(r) for r in stored["sizes"].collect()} == want and ("abc", False, 2) in want


def test_no_order_is_made_where_none_is_asked_for(spark, monkeypatch):
    """Boundaries, inner edges and path overlays need clusters and components, which the paths name, not the preorder."""
    from silvaspan.plans import inputs, more

    def index(*_):
        raise AssertionError("an index was made")

    for module, name in ((inputs, "index"), (inputs, "index_forest"), (forest, "index_forest")):
        monkeypatch.setattr(module, name, index)
    owners, clusters, asked = more._asked_clusters(spark, "/root/testdata/sf0.001")
    assert {r["parent"] for r in owners.where("node_id like 'R%'").collect()} == {None}
    assert {r["component"][0] for r in owners.select("component").distinct().collect()} == {"R"}
    assert asked.count() and {r["level"] for r in clusters.select("level").distinct().collect()} == {1}
    assert more.path_overlay(spark, "/root/testdata/sf0.001").columns == ["id", "source", "target", "distance"]


def test_coarse_edges_make_the_asked_tier(spark, monkeypatch):
    from silvaspan.plans import more

    seen = []
    geometry = summaries.cluster_geometry
    monkeypatch.setattr(summaries, "cluster_geometry", lambda clusters, positions: seen.append({r[0] for r in clusters.select("level").distinct().collect()}) or geometry(clusters, positions))
    more.coarse_edges(spark, "/root/testdata/sf0.001")
    assert seen == [{0}]


def test_boundary_of_several_clusters_of_one_request(spark):
    """a - b - c - d - e: what lies in any asked cluster is not outside."""
    names = "abcde"
    edges = spark.createDataFrame([(f"e{x}", x, y, 1.0) for x, y in zip(names, names[1:])], "edge_id string, source string, target string, distance double")
    home = {"a": "a", "b": "b", "c": "b", "d": "d", "e": "d"}
    clusters = spark.createDataFrame([(0, f"lod_0_{home[x]}", home[x], x) for x in names], "level int, cluster_id string, representative string, node_id string")
    asked = spark.createDataFrame([(1, "lod_0_b"), (2, "lod_0_b"), (2, "lod_0_d")], "request_id int, cluster_id string")
    found = reads.expansion_boundary(asked, clusters, edges)
    assert {(r["request_id"], r["inner"], r["outer"], r["outer_representative"]) for r in found.collect()} == {(1, "b", "a", "a"), (1, "c", "d", "d"), (2, "b", "a", "a")}
    assert {tuple(r) for r in reads.boundary_faults(asked.where("request_id = 1"), clusters, edges, found).collect()} == {(1, 2)}
