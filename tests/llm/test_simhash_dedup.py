import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F, types as T

from silvaspan.llm import simhash_dedup as S
from silvaspan.operators.components import components_of_edges

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() if w]
    pieces = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_the_majority_vote():
    for text in ("", "One", "one TWO", "a b c d e f", "Über x\ty\n\x0bz x y z", None, "q " * 500):
        assert S.simhash(None if text is None else text.encode()) == plain_fingerprint(text)


def test_spark_xxhash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_lose_no_component_sparse_or_dense(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(20)]
    fps = {b ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for b in base for _ in range(25)} | set(base)
    fps |= {base[0] ^ (1 << k) for k in range(64)} | {base[1] ^ sum(1 << k for k in draw.sample(range(64), 5)) for _ in range(60)}
    fps = sorted(fps)
    want = plain_components(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for dense in (1, 8, 10_000):
        found = {r["node"]: r["component"] for r in components_of_edges(S.links(df, dense)).collect()}
        got = [found.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64))) for f in fps]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_whole_query_equals_brute_force_on_odd_rows(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    long = [draw.choice(words) for _ in range(400)]
    rows = [(9, None), (4, ""), (7, " \t "), (1, "Hello"), (3, "hello"), (None, "alone here now"), (8, "x " * 30_000), (8, "x " * 30_000)]
    for k in range(40):
        edit = list(long)
        edit[draw.randrange(400)] = "zz"
        rows.append((100 + k, " ".join(edit)))
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = sorted((r["id"] is None, r["id"] or 0, r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((i is None, i or 0, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comp))
    assert got == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
