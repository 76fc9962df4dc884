import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from silvaspan.llm import decontamination as D

SF = "/root/testdata/sf0.001"
D_SCHEMA, I_SCHEMA = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    out = {}
    for (i, a), (k, b) in itertools.product(docs, items):
        x, y = words(a), words(b)
        w = min(len(y), D.WINDOW)
        if 5 * sum(v in set(x) for v in y) < 4 * w:
            continue
        x = [None] * w + x + [None] * w
        best = max((sum(u == v for u, v in zip(x[p : p + w], y[q : q + w])) for p in range(len(x) - w + 1) for q in range(len(y) - w + 1)), default=0)
        if w and 5 * best >= 4 * w:
            out[i, k] = max(best, out.get((i, k), 0))
    return out


def test_masks_miss_no_placement_of_substitutions():
    for w, masks in D.MASKS.items():
        for subs in itertools.combinations(range(w), w - D.needed(w)):
            assert any(all(p + j not in subs for j, b in enumerate(m) if b == "1") and p <= D.BACK for m in masks for p in range(w - len(m) + 1)), (w, subs)


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_overlaps_equal_brute_force(spark, rows):
    draw = random.Random(11)
    vocab = [f"v{k}" for k in range(60)] + ["the", "of"] * 10
    items = [(k, " ".join(draw.choice(vocab) for _ in range(draw.choice([13, 14, 20, 45])))) for k in range(12)]
    items += [(20 + n, " ".join(draw.choice(vocab[:60]) for _ in range(n))) for n in range(1, 13)]
    docs = []
    for k in range(60):
        text = [draw.choice(vocab) for _ in range(draw.randrange(0, 80))]
        if k % 2:
            own = words(draw.choice(items)[1])
            cut = draw.randrange(0, max(1, len(own) - 12))
            own = own[cut : cut + draw.choice([12, 13, 15, 45])]
            for _ in range(draw.randrange(0, 5 if len(own) > 12 else 3)):
                own[draw.randrange(len(own))] = "subst"
            at = draw.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((k, draw.choice([" ", "\n", ", "]).join(text).title()))
    short = {k: words(t) for k, t in items if k >= 20}
    for k, (n, own) in enumerate(itertools.product(range(20), short.values())):
        own = list(own)
        for _ in range(n % 3):
            own[draw.randrange(len(own))] = "subst"
        docs.append((200 + k, " ".join(["lead"] * (n % 4) + own + ["trail"] * (n % 2))))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1]), (103, "the of " * 20_000 + items[2][1])]
    docs += [(104, "some " + items[14][1]), (104, "other text, then " + items[16][1])]
    items += [(50, None), (51, ""), (52, "two words"), (53, items[0][1])]
    a = spark.createDataFrame(docs, D_SCHEMA).withColumn("key", F.lit(1)).withColumn("window", F.lit("x"))
    b = spark.createDataFrame(items, I_SCHEMA).withColumn("doc_id", F.lit(1)).withColumn("n", F.lit("x")).withColumn("words", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in D.overlaps(a, b, rows).collect()}
    assert got == plain([x for x in docs if x[0] != 103], items) | {k: v for k, v in got.items() if k[0] == 103}
    assert got[103, 2] == 13 and len(got) > 150 and len({k for _, k in got}) > 20
    known = {k: words(t) for k, t in items}
    assert {len(known[k]) for _, k in got} >= set(range(1, 14))


def test_short_items_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three four five"), (3, "one two")], I_SCHEMA)
    docs = spark.createDataFrame([(1, "x alpha beta gamma NEW epsilon zeta eta theta y"), (2, "so one two three four five so"), (3, "one two one two"), (4, "alpha beta gamma NEW epsilon OLD eta theta")], D_SCHEMA)
    assert sorted((r["doc_id"], r["item_id"]) for r in D.overlaps(docs, items).collect()) == [(1, 1), (2, 2), (2, 3), (3, 3)]
    assert D.overlaps(docs.limit(0), items).count() == 0 and D.overlaps(docs, items.limit(0)).count() == 0


def test_sql_agrees_for_items_of_all_lengths(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    # Beside the table's items, pieces of documents of every length, with a word replaced in some.
    words_of = F.split("text", r"\s+")
    pieces = docs.select((F.col("doc_id") + 1000).alias("item_id"), F.array_join(F.slice(words_of, 4, (F.col("doc_id") % 14 + 1).cast("int")), " ").alias("text"))
    pieces = pieces.select("item_id", F.when(F.col("item_id") % 3 == 0, F.regexp_replace("text", r"^(\S+\s+\S+\s+)\S+", "$1subst")).otherwise(F.col("text")).alias("text"))
    every = items.unionByName(pieces)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.register("benchmark", every.toArrow())
    rel = con.sql(D.oracle())
    at = [rel.columns.index(c) for c in ("doc_id", "item_id", "window", "matched", "similarity")]
    want = sorted(tuple(r[k] for k in at) for r in rel.fetchall())
    got = sorted(tuple(r[c] for c in ("doc_id", "item_id", "window", "matched", "similarity")) for r in D.overlaps(docs, every).collect())
    assert got == want and {r[2] for r in got} >= set(range(1, 14))
    assert sorted(tuple(r) for r in D.op4_benchmark_decontamination(spark, SF).select("doc_id", "item_id").collect()) == sorted(r[:2] for r in want if r[1] < 1000)
