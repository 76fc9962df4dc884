import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from silvaspan.llm import lm_scoring as L

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain(rows, order):
    """Scores by a trie of dictionaries, byte by byte."""
    trie, words, total, ends = [defaultdict(dict) for _ in range(order + 1)], defaultdict(int), 0, 0
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows if i is not None}

    def code(text):
        own = (text or "").encode().lower().split()
        return own, b"\xfe" * order + b" ".join(own) + b"\xff"

    for i, text in rows:
        if i is None or fold[i] == 1:
            continue
        own, s = code(text)
        for w in own:
            words[w] += 1
        total, ends = total + len(own) + 1, ends + 1
        for k in range(order, len(s)):
            node = trie[order][s[k - order : k]]
            node[s[k]] = node.get(s[k], 0) + 1
    for level in range(order - 1, -1, -1):
        for context, node in trie[level + 1].items():
            for x in node:
                short = trie[level][context[1:]]
                short[x] = short.get(x, 0) + 1
    v = len(words) + (ends > 0)
    out = []
    for i, text in rows:
        own, s = code(text)
        base = sum(math.log10((words.get(w, 0) + 0.5) / (total + 0.5 * (v + 1))) for w in own)
        base += math.log10((ends + 0.5) / (total + 0.5 * (v + 1)))
        lp = 0.0
        for k in range(order, len(s)):
            gone = set()
            for level in range(order, -1, -1):
                node = trie[level].get(s[k - level : k])
                if not node:
                    continue
                rest = {x: n for x, n in node.items() if x not in gone}
                if s[k] in rest:
                    lp += math.log10((rest[s[k]] - 0.5) / sum(rest.values()))
                    break
                if rest:
                    lp += math.log10(0.5 * len(rest) / sum(rest.values()))
                gone = set(node)
            else:
                lp -= math.log10(255 - len(gone))
        held = i is not None and fold[i] == 1
        out.append((str(i), held, len(own) + 1, sum(w in words for w in own) + (ends > 0), total, base, lp))
    return sorted(out)


ROWS = [(k, f"the cat {k} sat on THE mat {'again ' * (k % 4)}über {k * 7919 % 97}") for k in range(30)]
ROWS += [(31, None), (32, ""), (None, "no id here"), (3, ROWS[3][1]), (40, "zz\tqq\x0bzz " * 300), (42, "日本 q"), (43, "a long text of words " * 60_000)]


@pytest.mark.parametrize("bound", [1 << 22, 40])
def test_scores_equal_a_plain_trie(spark, bound):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in L.score(df, bound=bound).collect())
    for a, b in zip(got, plain(ROWS, L.ORDER), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:])


def test_pieces_and_flushed_tallies_change_nothing(spark, monkeypatch):
    """Texts longer than a piece, and tallies that are given out in parts, on the driver's side of the tasks' code."""
    words = L.words_of(b"the cat sat on the mat again and again " * 9)
    whole = [int(x) for g in L.windows(words) for x in g]
    assert len(whole) == len(b" ".join(words)) + 1
    monkeypatch.setattr(L, "_PIECE", 10)
    assert [int(x) for g in L.windows(words) for x in g] == whole
    monkeypatch.setattr(L, "_MANY", 4)
    tally, given = L._Tally(), defaultdict(int)
    for k in range(50):
        tally.add(*map(np.asarray, ([k % 7, 7 + k], [1, 2])))
        for keys, n in [x for x in [tally.over()] if x]:
            for a, b in zip(keys, n):
                given[int(a)] += int(b)
        assert tally.size <= 10
    for a, b in zip(*tally.merged()):
        given[int(a)] += int(b)
    assert given == {**{j: sum(k % 7 == j for k in range(50)) for j in range(7)}, **{7 + k: 2 for k in range(50)}}


def test_probabilities_of_all_followers_sum_to_one(spark):
    train = [b"\xfe" * 2 + b"abab" + b"\xff", b"\xfe" * 2 + b"abb" + b"\xff"]
    seen = defaultdict(int)
    for s in train:
        for k in range(2, len(s)):
            seen[int.from_bytes(s[k - 2 : k + 1], "big")] += 1
    for context in (b"ab", b"\xfea", b"zb", b"zz"):
        every = {int.from_bytes(context, "big") << 8 | x for x in range(256) if x != 0xFE}
        rows = [(int(k), seen.get(k, 0), 1) for k in every | set(seen)]
        priced = L.prices(spark.createDataFrame(rows, "key long, train long, total long"), order=2)
        assert sum(10 ** r["price"] for r in priced.collect() if r["key"] in every) == pytest.approx(1.0)


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], SCHEMA)).count() == 0
