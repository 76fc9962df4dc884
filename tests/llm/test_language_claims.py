import numpy as np

import corpus_pipeline as C
from silvaspan.llm import language_id

SF = "/root/testdata/sf0.001"
FOREIGN = [
    "To jest zdanie w języku polskim, którego nikt tutaj nie zna, i nic więcej.",
    "Tämä on suomenkielinen lause, jota kukaan täällä ei tunne",
    "Это предложение на русском языке, и больше ничего",
    "Bu cümle Türkçe yazılmıştır ve burada kimse bilmiyor",
    "これは日本語です",
]
JUNK = ["a 12 34 %% 55", "zzzz qqqq xkcd jjjj", "1234567 890 a", "#### 0000 q 9999 ]] [[ 77"]


def test_unlearned_languages_and_junk_with_letters_go_and_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    clean = {r["doc_id"] for r in docs.collect()}
    more = spark.createDataFrame([(90_000 + k, t, None, "src0") for k, t in enumerate(FOREIGN + JUNK)], docs.schema)
    # Short pieces of texts of learned languages, without their other words.
    short = docs.selectExpr("doc_id + 50000 as doc_id", "substring(text, 1, 40) as text", "lang", "source").where("text rlike '^[A-ZÄÖÜÉÈÊÇÑa-zäöüßéèêçñóíá ,.\\n]+$'")
    pieces = {r["doc_id"] for r in short.collect()}
    kept = {r["doc_id"] for r in C.keep_known_languages(spark, docs.unionByName(more).unionByName(short), SF).collect()}
    assert len(pieces) > 50 and clean <= kept and pieces <= kept
    assert not {i for i in kept if i >= 90_000}


def test_all_languages_and_all_labelled_texts_are_learned(spark, monkeypatch):
    """No language is too rare to be learned, no labelled document is left out for its id, and blocks of languages change nothing."""
    random = np.random.default_rng(3)
    fold = language_id.fold("id")
    ids = {r["id"]: r["f"] for r in spark.range(400).select("id", fold.alias("f")).collect()}
    held_out, others = [i for i, f in ids.items() if f == 0], [i for i, f in ids.items() if f]
    rows = []
    for k in range(66):
        words = ["".join(chr(0x4E00 + 40 * k + int(c)) for c in random.integers(0, 40, 3)) for _ in range(12)]
        for _ in range(2 if k in (64, 65) else 4):
            rows.append(((held_out if k == 65 else others).pop(), " ".join(random.choice(words, 30)), f"l{k:02d}", "s"))
    rows.append((9999, "qwerty uiop asdf ghjkl zxcv bnm", None, "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = sorted(r["doc_id"] for r in C.keep_known_languages(spark, docs, SF).collect())
    assert kept == sorted(r[0] for r in rows if r[2])
    monkeypatch.setattr(language_id, "HELD", 9)
    assert sorted(r["doc_id"] for r in C.keep_known_languages(spark, docs, SF).collect()) == kept


def test_least_claim_of_all_labelled_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null")
    rows = [(r["lang"], r["text"].encode()) for r in docs.collect() if language_id.has_letter(r["text"].encode())]
    found = [language_id.counts(t) for _, t in rows]
    model = language_id.with_claims(language_id.Model((), np.empty(0)), [(np.flatnonzero(n), n[np.flatnonzero(n)]) for n in found], [lang for lang, _ in rows])
    totals = language_id.trigram_totals(docs)
    got = language_id._best_claims(docs.select("lang", "text"), totals, sorted({lang for lang, _ in rows}), "text", None).collect()
    assert all(abs(r["claim"] - language_id.claim(model, r["text"].encode())) < 1e-9 for r in got if language_id.has_letter(r["text"].encode()))
