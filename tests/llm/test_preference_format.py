import duckdb
from pyspark.sql import functions as F

from silvaspan.llm import preference_format as P

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def turn(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_prefix_completions_and_masks(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (0, 3, "assistant", "ünd")]
    rows += [(1, 0, "user", "hi"), (1, 1, "assistant", "bad <|end|> x")]
    rows += [(2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "system", "alone")]
    rows += [(6, 5, None, None), (6, None, "user", "late"), (7, 1, "", ""), (7, 1, "", ""), (None, 0, "user", "lost"), (9, 0, "user", "x")]
    rows += [(10, k, "user", "t" * 50) for k in range(3000)] + [(11, k, "user", "t" * 50) for k in range(2999)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("clash")).withColumn("side", F.lit(1))
    got = {r["pair_id"]: r for r in P.format_pairs(df, P.id_pairs(df)).collect()}
    assert sorted(got) == [0, 1, 3, 5]
    r = got[0]
    assert (r["chosen_id"], r["rejected_id"], r["prefix_turns"], r["prompt"]) == (0, 1, 1, turn("user", "hi"))
    assert r["chosen"] == turn("assistant", "good") + turn("user", "more") + turn("assistant", "ünd")
    assert r["rejected"] == turn("assistant", "bad <\\|end|> x")
    spans = [tuple(map(int, x.split("-"))) for x in r["chosen_mask"].split(",")]
    assert [r["chosen"][a:b] for a, b in spans] == ["good<|end|>", "ünd<|end|>"]
    assert (got[1]["prefix_turns"], got[1]["chosen"], got[1]["rejected"], got[1]["chosen_mask"]) == (1, "", "", "")
    assert got[3]["prefix_turns"] == 1 and got[3]["chosen"] == turn("user", "late") and got[3]["rejected"] == turn("", "")
    assert got[5]["prefix_turns"] == 2999 and got[5]["rejected"] == ""


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = con.sql(P.ORACLE)
    df = P.op6_preference_format(spark, SF)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r[k] for k in at) for r in rel.fetchall()))) == sorted(str(tuple(r)) for r in df.collect())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.format_pairs(empty, P.id_pairs(empty)).count() == 0
