import math
import random
import re

import numpy as np
import pytest

from silvaspan.llm import lexical_search as ls

DOCS, ITEMS = "doc_id long, text string, item_id int, rank string", "item_id long, text string, doc_id int, score int"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """Every document against every item."""
    known = [(i, terms(t)) for i, t, *_ in docs if terms(t)]
    n_docs, n_terms = len(known), sum(len(t) for _, t in known)
    df = {}
    for _, t in known:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text, *_ in items:
        scored = []
        for i, t in known:
            m = 10 + (90 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in set(terms(text)) if x in t)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, parts=3):
    found = ls.search(ls.build_index(spark.createDataFrame(docs, DOCS).repartition(parts)), spark.createDataFrame(items, ITEMS))
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, found.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ärger", "naïve", "x1", "ÉCOLE", "日本"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice((3, 10, 40)))), 1, "r") for k in range(n)]
    docs += [(n + k, docs[7][1], 1, "r") for k in range(30)]  # copies: equal scores
    docs += [(None, docs[7][1], 1, "r"), (3, docs[8][1], 1, "r"), (9000, None, 1, "r"), (9001, "", 1, "r"), (9002, "-- !? \x00", 1, "r"), (9003, "w9_W5-w9\x00w17 " * 4000, 1, "r")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((1, 4, 25)))), 1, 1) for k in range(20)]
    return docs, items + [(50, docs[7][1], 1, 1), (51, None, 1, 1), (52, "", 1, 1), (53, "unknown words", 1, 1), (54, "w1 w1 W1", 1, 1), (54, "w1 w1 W1", 1, 1), (None, "w2", 1, 1)]


def test_against_all_documents(spark):
    docs, items = corpus(400, 5)
    assert got(spark, docs, items) == plain(docs, items)


def test_small_blocks_shards_and_batches(spark, monkeypatch):
    for name, value in (("DOCS", 60), ("TOKENS", 900), ("BLOCK", 4), ("BATCH", 5), ("WINDOW", 8)):
        monkeypatch.setattr(ls, name, value)
    docs, items = corpus(500, 6)
    assert got(spark, docs, items, 2) == plain(docs, items)


def test_blocks_stay_closed(spark):
    """Once ten documents hold a rare term, blocks of the frequent one that hold no candidate aren't decompressed."""
    tokens, sizes = [], []
    for k in range(4000):
        own = [0] * (1 + k % 3) + ([1] * 5 if k % 400 == 7 or k < 10 else [])
        tokens += own
        sizes.append(len(own))
    rows = ls.shard_rows(0, list(range(4000)), sizes, np.array(tokens), [b"often", b"rare"]).to_pylist()
    damped = ls.damping(np.array(rows[0]["ends"]), 4000, sum(sizes))
    often, rare = (ls.Postings(x, damped, 4000, sum(sizes)) for x in rows[1:])
    ids, scores = ls.best_documents([(1, often), (5000, rare)], np.arange(4000), 10)
    assert len(ids) == 10 and len(often.open) < len(often.ends) / 2
    every = np.zeros(4000, np.int64)
    for w, p in ((1, often), (5000, rare)):
        for b in range(len(p.ends)):
            docs, f = p.block(b)
            every[docs] += w * f
            assert f.max() == p.tops[b] and docs[-1] == p.ends[b]
    want = np.lexsort((np.arange(4000), -every))[:10]
    assert (ids == want).all() and (scores == every[want]).all()


def test_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**31 - 1, 5], np.int64)
    data, ends = ls.pack_numbers(x)
    assert (ls.unpack_numbers(data) == x).all() and ends[-1] == len(data)


def test_edges(spark):
    docs, items = corpus(20, 1)
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    with pytest.raises(ValueError, match="whole numbers"):
        ls.build_index(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    df = ls.op12_lexical_search(spark, sf).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(ls.ORACLE).fetchall())
