import math
import random
import time
import re

from pyspark.sql import functions as F

from silvaspan.llm import license_scan as L

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, templates=L.TEMPLATES):
    w = words(text)
    at, base = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for k in range(len(w)):
            if w[k : k + len(p)] == p:
                at.append(k)
                base.add(label)
    found, best = set(base), 0.0
    for label, template in templates:
        t, most = set(words(template)), int(L.STRETCH * len(words(template)))
        need = math.ceil(L.CONTAINMENT * len(t) - 1e-9)
        for i in range(max(1, len(w) - most + 1)):
            common = len(t.intersection(w[i : i + most])) if t & set(w) else 0
            if t and common >= need:
                found.add(label)
                best = max(best, common / len(t))
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if at else best


def test_scan_equals_brute_force(spark):
    draw = random.Random(6)
    vocab = sorted({w for _, t in L.TEMPLATES for w in words(t)}) + ["über", "x9"]
    rows = []
    for k in range(150):
        text = [draw.choice(["Ärger", "foo", "bar"] + vocab) for _ in range(draw.randrange(0, 40))]
        own = draw.choice(L.TEMPLATES)[1].split()
        for _ in range(draw.randrange(0, 2 + len(own) // 20)):
            own[draw.randrange(len(own))] = draw.choice(["oops", "\n", "The"])
        rows.append((k, "".join(x + draw.choice([" ", " ", "\n", ", "]) for x in text) + draw.choice(["\n", " "]) + " ".join(own)))
    rows += [(200, None), (201, ""), (202, "cc by cc-by CC BY. general PUBLIC license all rights reserved"), (203, "all rights " * 1_000 + "reserved"), (None, "MIT"), (202, "cc by"), (204, "cc\x00by ccby cc été by")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("labels", F.lit("clash")).withColumn("n_words", F.lit("x"))
    got = sorted(str((r["doc_id"], *(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))) for r in L.scan(df).collect())
    assert got == sorted(str((i, *plain(t))) for i, t in rows)
    assert sum("mit" in x or "apache" in x or "cc-by-nc" in x for x in got) > 10


def test_wrapped_notices_long_lines_and_other_templates(spark):
    mit = L.TEMPLATES[1][1].split()
    rows = [(1, "lead " * 9 + " ".join(mit[:10]) + "\n" + " ".join(mit[10:]) + " trail" * 16), (2, " ".join(mit[:10]) + " word" * 40 + " ".join(mit[10:])), (3, "x " * 3000 + "released " + "y " * 3000 + "under the " + "z " * 3000 + "mit license"), (4, "Released under the Apache License.")]
    got = {r["doc_id"]: (r["labels"], [(b["start"], b["words"]) for b in r["blocks"]]) for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == ("mit", [(9, len(words(L.TEMPLATES[1][1])))]) and got[2][0] == got[3][0] == got[4][0] == ""
    own = spark.createDataFrame([("own", "the quick brown fox jumps over the lazy dog today at noon"), ("none", "")], "label string, text string")
    texts = [(k, t) for k, t in enumerate(["so the quick brown\nfox jumps over the lazy dog today at noon", "the quick brown fox jumps over the lazy dog today at", "quick fox", None])]
    got = {r["doc_id"]: r["labels"] for r in L.scan(spark.createDataFrame(texts, SCHEMA), own).collect()}
    assert got == {k: plain(t, [("own", "the quick brown fox jumps over the lazy dog today at noon")])[5] for k, t in texts} and got[0] == got[1] == "own"


def test_work_is_linear_in_the_text():
    index = L.Index({}, L.TEMPLATES)
    took = []
    for n in (100_000, 200_000):
        began = time.process_time()
        text = L.words_of(b"copyright all rights reserved software granted " * (n // 6))
        assert len(L.phrase_places(text)) == n // 6 and index.matches(text)
        took.append(time.process_time() - began)
    assert took[1] < 3.5 * took[0]


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0
