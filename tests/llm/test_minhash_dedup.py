import itertools
import random

import corpus_pipeline as C
import numpy as np
from pyspark.sql import types as T

from silvaspan.llm import minhash_dedup as M
from silvaspan.llm import simhash_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_least(rows):
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def edited(draw, words, n):
    out = list(words)
    for k in draw.sample(range(len(out)), n):
        out[k] = f"z{draw.randrange(10**6)}"
    return " ".join(out)


def odd_rows():
    draw = random.Random(5)
    rows = [(9, None), (4, ""), (7, " \t "), (1, "Hello there"), (3, "hello  THERE"), (None, "alone here now"), (8, "x " * 30_000), (8, "x " * 30_000), (8, "a b c d e f g")]
    for k in range(30):
        base = [f"w{draw.randrange(3000)}" for _ in range(400)]
        rows += [(100 + 10 * k + j, edited(draw, base, n)) for j, n in enumerate((0, 1, 4, 7, 12, 40))]
    return draw, rows


def test_stage_drops_edited_copies_that_two_bits_of_simhash_keep(spark):
    draw, rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS)
    far = [t for i, t in rows if i and i >= 100 and (i - 100) % 10 in (0, 3)]
    bits = [bin(simhash_dedup.simhash(a.encode()) ^ simhash_dedup.simhash(b.encode())).count("1") for a, b in zip(far[::2], far[1::2])]
    assert sum(b > 2 for b in bits) >= 20 and all(M.jaccard(M.shingles(a.encode()), M.shingles(b.encode())) >= 0.8 for a, b in zip(far[::2], far[1::2]))
    rows = [r for r in rows if r[0] is not None]
    groups = {}
    for (i, _), k in zip(rows, plain_least([(k, t) for k, (_, t) in enumerate(rows)])):
        groups[k] = min(i, groups.get(k, i))
    # One document of each group, its smallest id, also where an id repeats with another text.
    got = sorted(r["doc_id"] for r in C.drop_near_duplicates(spark, docs.where("doc_id is not null"), "").collect())
    assert got == sorted(groups.values())


def test_groups_equal_brute_force_in_small_and_large_blocks(spark):
    draw, rows = odd_rows()
    base = [f"v{k}" for k in range(300)]
    rows += [(5000 + k, edited(draw, base, draw.choice((0, 1, 2, 3, 8)))) for k in range(120)]
    want = sorted(zip([i or 0 for i, _ in rows], [x or 0 for x in plain_least(rows)]))
    for dense, tile in ((2, 4096), (2, 40), (10_000, 4096)):
        got = M.near_duplicates(spark.createDataFrame(rows, DOCS), dense=dense, tile=tile).collect()
        assert sorted((r["id"] or 0, r["component_id"] or 0) for r in got) == want


def test_large_block_of_near_copies_gives_few_candidates():
    draw = random.Random(1)
    base = [f"v{k}" for k in range(2000)]
    sigs = np.stack([M.signature(M.shingles(edited(draw, base, draw.randrange(3, 80)).encode())) for _ in range(400)])
    assert len(list(M.spanning_pairs(np.arange(400), sigs))) < 5 * 400


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_links_are_candidates_of_their_own(spark, monkeypatch):
    """The pigeonhole blocks find all kinds within two bits, up to stars of one fingerprint, and the exact check decides on them without any band."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(words)) for k in range(2)] + [(10 + k, edited(draw, words, 1)) for k in range(30)] + [(50, "nothing like it at all here"), (51, None)]
    kinds = M.sketches(spark.createDataFrame(rows, DOCS), "doc_id", "text", 5).groupBy("kind").agg({"fp": "first", "id": "min"}).toDF("kind", "fp", "first_id")
    fps = {r["kind"]: r["fp"] for r in kinds.collect() if r["fp"] is not None}
    root = {k: k for k in fps}

    def find(k):
        return k if root[k] == k else find(root[k])

    near = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 2}
    got = {tuple(r) for r in M.simhash_pairs(kinds).collect()}
    for a, b in got:
        root[find(a)] = find(b)
    assert got <= near and len(near) > 10 and all(find(a) == find(b) for a, b in near)

    monkeypatch.setattr(M, "candidates", lambda kinds, dense, tile: kinds.select("kind", "kind").toDF("a", "b").limit(0))
    least = {r["id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(v == 0 for k, v in least.items() if k >= 10) > 10 and least[50] == 50 and least[51] == 51
