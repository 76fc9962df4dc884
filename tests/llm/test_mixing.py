import random

import pytest
from pyspark.sql import functions as F, types as T

from silvaspan.llm import mixing as M

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


def plain_targets(sizes):
    """By the rule as told: share by weight, hold at three times, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def rows(seed=1):
    draw = random.Random(seed)
    out = [(k, " ".join("w" for _ in range(draw.randrange(0, 90))), draw.choice(["a"] * 9 + ["b", "é", None, "c", "z"])) for k in range(1500)]
    return out + [(None, "some words", "a"), (7, None, "b"), (8, "", "empty"), (9, " \n", "empty"), (3, "w w", "a"), (3, "w w", "a"), (5, "y " * 40_000, "big")]


def test_targets_words_and_caps(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("size", F.lit("clash")).withColumn("chance", F.lit(1))
    got = M.mix(df, block=64, merge=2).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    taken, most = {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= most[s]


def test_reruns_and_other_partitions_agree(spark):
    df = spark.createDataFrame(rows(2), SCHEMA)
    a = sorted(map(str, M.mix(df.repartition(7)).collect()))
    assert a == sorted(map(str, M.mix(df.repartition(2, "source")).collect()))


def test_equal_rows_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN", 7)
    data = [(1, "same text here", "a")] * 1000 + [(None, "x y", "a")] * 300 + [(k, "w " * (k % 50 + 1), "b") for k in range(2, 900)]
    df = spark.createDataFrame(data, SCHEMA)
    own = M.numbered(df.select("doc_id", "source", M.word_count().alias("size"))).collect()
    assert sorted(r["rank"] for r in own if r["doc_id"] == 1) == list(range(1000)) and len(own) == len(data)
    got = M.mix(df.repartition(5), block=64, merge=4).collect()
    assert len(got) == len(data)
    words = sum(r["taken"] for r in got if r["source"] == "a")
    assert abs(words - next(r["target"] for r in got if r["source"] == "a")) <= 3
    assert 1 < len({r["copies"] for r in got if r["doc_id"] == 1}) < 4


def test_flight_keeps_counts_and_words():
    draw = random.Random(4)
    sizes = [draw.randrange(1, 500) for _ in range(400)]
    chances = M.fly(sizes, [0.37] * 400, random.Random(1))
    assert sum(0 < p < 1 for p in chances) <= 2
    assert sum(chances) == pytest.approx(148) and sum(p * s for p, s in zip(chances, sizes)) == pytest.approx(0.37 * sum(sizes))
    landed = M.land(sizes, chances, random.Random(1))
    assert set(landed) <= {0.0, 1.0}


def test_each_chance_holds_on_average():
    got = [0.0] * 5
    for seed in range(4000):
        draw = random.Random(seed)
        for k, p in enumerate(M.land([3, 1, 4, 1, 5], M.fly([3, 1, 4, 1, 5], [0.3] * 5, draw), draw)):
            got[k] += p / 4000
    assert all(abs(p - 0.3) < 0.03 for p in got)


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
