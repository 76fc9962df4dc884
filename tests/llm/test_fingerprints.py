import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from silvaspan.llm import fingerprints as P

SCHEMA = "doc_id long, text string"
M = (1 << 64) - 1


def plain_fp(text):
    h = []
    for w in [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]:
        h.append((xxhash.xxh64_intdigest(w.encode(), 42) & ~15 | min(len(w), 15)) & M)
    terms = list(zip(h, h[1:])) or ([(h[0], None)] if h else [])
    votes, total = defaultdict(int), 0

    def long_hash(x, seed):
        return xxhash.xxh64_intdigest((x & M).to_bytes(8, "little"), seed)

    for a, b in terms:
        n = (a & 15) + ((b or 0) & 15)
        total += n
        one = long_hash(a, 42)
        one = one if b is None else long_hash(b, one)
        two = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), one)
        for k, x in enumerate((one, two)):
            for j in range(64):
                votes[k, j] += n * (x >> j & 1)
    return "".join(f"{sum(1 << j for j in range(64) if 2 * votes[k, j] > total):016x}" for k in (0, 1))


def like(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


def test_report_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "PER_RANGE", 7)
    draw = random.Random(2)
    rows = [(k * 3 + 1, " ".join(draw.choice(["über", "b", "cc", "dddd", "long" * 6]) for _ in range(draw.randrange(0, 60)))) for k in range(60)]
    rows += [(400, "near copy " * 30), (200, "near copy " * 30), (300, "near copy " * 30 + "x"), (-5, "日本語テキスト a"), (500, None), (501, ""), (502, "w " * 20_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("fp", F.lit(1)).withColumn("place", F.lit("clash"))
    got = {r["doc_id"]: r for r in P.fingerprint_report(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    fps = {i: plain_fp(t) for i, t in order}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fps[i] and r["edited_fingerprint"] == plain_fp(edited)
        assert r["near_edited"] == like(fps[i], plain_fp(edited)) and r["near_next"] == like(fps[i], fps[after[0]])
        near = sum((1 - like(fps[i], f)) * 128 <= P.RADIUS for f in fps.values()) - 1
        assert r["n_near"] == (near if i % 100 == 0 else None)


def test_ties_nulls_and_empty(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "null id"), (None, "null id"), (2, "x y z w")]
    got = P.fingerprint_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "2", "None", "None"]
    assert len({r["fingerprint"] for r in got}) == 4
    one = P.fingerprint_report(spark.createDataFrame([(7, "abcd")], SCHEMA)).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1.0
    assert P.fingerprint_report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("per_range, most", [(5, 1 << 16), (2, 1 << 16), (2, 9)])
def test_repeated_rows_and_null_ids_spread_over_ranges(spark, monkeypatch, per_range, most):
    monkeypatch.setattr(P, "PER_RANGE", per_range)
    monkeypatch.setattr(P, "RANGES", most)
    rows = [(7, "hot row of words")] * 90 + [(None, f"null {k} id {k * k}") for k in range(40)] + [(3, f"one id {k} word") for k in range(40)] + [(k + 10, f"text {k} of its own") for k in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    texts = P.edited_texts(df)
    assert max(r["count"] for r in texts.groupBy("range").count().collect()) < (60 if most > 9 else 200) and texts.agg(F.sum("copies")).first()[0] == len(rows)
    got = P.fingerprint_report(df).collect()
    assert len(got) == len(rows)

    def signed(t):
        return xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((str(i), plain_fp(t), hashlib.sha256(edited.encode()).hexdigest(), like(plain_fp(t), plain_fp(after))))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["edited_sha256"], r["near_next"]) for r in got) == sorted(want)


def test_block_tables_lose_nothing(spark):
    draw = random.Random(9)
    base = [draw.getrandbits(128) for _ in range(10)]
    fps = [b ^ sum(1 << k for k in draw.sample(range(128), draw.randrange(0, 7))) for b in base for _ in range(20)]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    df = spark.createDataFrame([([signed(f & M), signed(f >> 64)],) for f in fps], "fp array<long>")
    for radius, dense in ((0, 4096), (3, 4096), (3, 4), (5, 2)):
        got = {(tuple(r["query"]), tuple(r["fp"])) for r in P.within(df.limit(50), df, radius, dense).collect()}
        pick = [tuple(r["fp"]) for r in df.limit(50).collect()]
        every = {(signed(f & M), signed(f >> 64)): f for f in fps}
        want = {(a, b) for a in pick for b, f in every.items() if bin(every[a] ^ f).count("1") <= radius}
        assert got == want
