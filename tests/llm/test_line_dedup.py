import hashlib

import numpy as np
import pytest

from silvaspan.llm import line_dedup

SCHEMA = "doc_id long, text string, kept string, n int"
LONG = "The quick brown fox jumps over the lazy dog, again"


def plain(rows, shortest=40, least=5):
    """The rule, line by line."""
    holders = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\v\f\r")
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
            if len(key) >= shortest:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
            own = holders.get(key, set())
            if len(own) < least or i == max(own, key=lambda x: -1 if x is None else x):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows():
    out = [(k, f"own line {k}\n \t{LONG.upper() if k % 2 else LONG}\r\n{LONG}!\ntail", "x", k) for k in range(7)]
    out += [(10 + k, f"É{'é' * 38}É\n{LONG} four" if k < 5 else f"{'é' * 39}", "x", k) for k in range(6)]
    out += [(30 + k, f"{LONG} four times", None, 1) for k in range(4)] + [(34, None, "x", 1), (35, "", "x", 1), (36, "\n", "x", 1)]
    # An id that repeats is one document; without an id all rows are one.
    out += [(40, f"{LONG} of an id", "x", 1)] * 5 + [(None, f"{LONG} without", "x", 1)] * 3 + [(50 + k, f"{LONG} without", "x", 1) for k in range(4)]
    out += [(60, "\n".join([LONG + " again and again"] * 3), "x", 1)] + [(61 + k, LONG + " again and again", "x", 1) for k in range(4)]
    return out + [(70, " ".join(["word"] * 60_000), "x", 1)]


def test_rule(spark):
    data = rows()
    assert got(line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA).repartition(5))) == plain(data)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD", 7)
    data = [(k, "\n".join(f"line {j} of those that stand in many documents" for j in range(k % 60, k % 60 + 40)), "", 0) for k in range(200)]
    assert got(line_dedup.dedup_lines(spark.createDataFrame(data, SCHEMA).repartition(4))) == plain(data)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        hi, lo = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)
        found = line_dedup.PerfectHash.of(hi, lo)
        assert sorted(found.slots(hi, lo)) == list(range(n))
        shard = line_dedup.Shard(line_dedup._pack(hi, lo, np.arange(n) + 5, np.arange(n)))
        known, count, last = shard.probe(hi, lo)
        assert known.all() and (last == np.arange(n)).all() and (count == np.arange(n) + 5).all()
        if n:
            assert not shard.probe(lo + np.uint64(1), hi)[0].any()


def test_cache(tmp_path, monkeypatch):
    """A worker keeps the last shards in bounded bytes and reads the others again."""
    rng = np.random.default_rng(4)
    keys = [(rng.integers(0, 2**64, 100, np.uint64), rng.integers(0, 2**64, 100, np.uint64)) for _ in range(5)]
    for k, (hi, lo) in enumerate(keys):
        (tmp_path / f"shard-{k:08d}").write_bytes(line_dedup._pack(hi, lo, np.full(100, 9), np.arange(100)))
    monkeypatch.setattr(line_dedup, "CACHE", 10_000)
    shards = line_dedup.Shards(f"file://{tmp_path}")
    for _ in range(2):
        for k, (hi, lo) in enumerate(keys):
            assert (shards.get(k).probe(hi, lo)[2] == np.arange(100)).all()
            assert shards.bytes <= 10_000 and k in shards.kept
    assert len(shards.kept) < 5 and shards.get(7) is None


def test_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        line_dedup.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError, match="two documents"):
        line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA), least=1)


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = line_dedup.op13_line_dedup(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(line_dedup.ORACLE).fetchall())
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).selectExpr("sha2('', 256)").first()[0]
