"""Language ID by hierarchical discrimination: the family first, then pairwise linear SVMs within it.

A text is a vector of hashed byte trigrams of its whole lower-cased content (square roots of the
counts, unit length). One linear support vector machine per family tells it from all others; inside
the winning family one machine per pair of languages votes, and the larger sum of margins settles ties.
Machines are fitted by dual coordinate descent on at most ``sample`` labelled documents per language, of
the ``languages`` most frequent ones (ties by code): both bounds are parameters. A language's sample are
the ids of the smallest hashes, one text (that of the smallest hash) for an id that repeats, so what reaches the
driver is ``sample * languages`` rows at most, however often a row or an id repeats. Rows are thinned by
their hash where they are read, before anything is shuffled by language. The fitted table, a fixed
number of floats per machine, goes to the tasks; every text is scored whole, in pieces of bounded size.

Families come from ``FAMILIES``; a language that it lacks is a family of its own.

The machines only tell learned languages apart. Whether any of them claims a text at all is told by
``claim``: how much likelier, in nats per trigram, the text's trigrams are in the fitted sample of the
language that suits best than among trigrams drawn evenly. Texts below the model's ``least`` claim are in
no learned language; it is set on the sample, each of whose documents is scored without itself. The score
is the machines' confidence times that of the claim, so text that no learned language claims scores near 0.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text when
nothing can be learned; with one language learned, every text with letters is that language. A null id
is neither held out nor learned from. Repeated rows stay repeated. Columns named like the results are
replaced; other columns pass through unread.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
DIMS = 1 << 13
SAMPLE = 300
LANGUAGES = 64
#: Part of the hash by which rows are thinned and ranked.
_DRAW = 1 << 30
EPOCHS = 12
FOLDS = 5
_PIECE = 1 << 20
_SLOPE = 6.0
#: A text is claimed at this much below the claim that all but ``ODD`` of the sample reach, and at 0, an even draw, at the latest.
SLACK = 1.0
ODD = 0.01
#: Where all texts are learned from: languages in memory at once, and steps of a nat in which claims are counted.
HELD = 256
STEPS = 4096


@dataclass(frozen=True)
class Model:
    """languages by family, and one column of weights per machine: the families, then the pairs in order."""

    families: tuple[tuple[str, tuple[str, ...]], ...]
    weights: np.ndarray
    #: A row per language: logarithms of its trigrams' shares, times DIMS.
    shares: np.ndarray | None = None
    least: float = -np.inf

    @property
    def pairs(self) -> list[tuple[int, int, int]]:
        return [(f, i, j) for f, (_, langs) in enumerate(self.families) for i, j in itertools.combinations(range(len(langs)), 2)]


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), f"={lang}")


def counts(text: bytes) -> np.ndarray:
    """Occurrences of each hashed byte trigram of the lower-cased text, a space before and after."""
    padded = b" " + text.lower() + b" "
    out = np.zeros(DIMS, np.int64)
    for k in range(0, max(1, len(padded) - 2), _PIECE):
        b = np.frombuffer(padded[k : k + _PIECE + 2], np.uint8).astype(np.uint32)
        gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        out += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=DIMS)
    return out


def vector(found: np.ndarray) -> np.ndarray:
    return np.sqrt(found / max(1, found.sum())).astype(np.float32)


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a linear L1-loss support vector machine without a bias (rows of x have unit length; y is -1 or 1)."""
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            step = np.clip(alpha[i] + 1 - y[i] * float(x[i] @ w), 0, cost) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
    return w


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    if not langs:
        return None
    names = sorted(set(langs))
    families = tuple((f, tuple(x for x in names if family_of(x) == f)) for f in sorted({family_of(x) for x in names}))
    lang, columns = np.array(langs), []
    for _, own in families:
        columns.append(svm(x, np.where(np.isin(lang, own), 1, -1)) if len(families) > 1 else np.zeros(DIMS, np.float32))
    model = Model(families, np.empty(0))
    for f, i, j in model.pairs:
        a, b = families[f][1][i], families[f][1][j]
        at = np.flatnonzero((lang == a) | (lang == b))
        columns.append(svm(x[at], np.where(lang[at] == a, 1, -1)))
    return Model(families, np.stack(columns, axis=1))


def log_shares(total: np.ndarray) -> np.ndarray:
    return np.log((total + 0.5) / (total.sum() + 0.5 * DIMS) * DIMS)


def claim(model: Model | None, text: bytes | None) -> float:
    """The claim of the language that suits the text best; minus infinity without a letter or a model with shares."""
    if model is None or model.shares is None or not text or not has_letter(text):
        return -np.inf
    return claim_of(model, counts(text))


def claim_of(model: Model, found: np.ndarray) -> float:
    at = np.flatnonzero(found)
    return float(np.max(model.shares[:, at] @ found[at]) / found.sum())


def with_claims(model: Model | None, found: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model | None:
    """The model with shares and the least claim, from the places and counts of the trigrams of the sample's texts."""
    if model is None:
        return None
    names = sorted(set(langs))
    totals = np.zeros((len(names), DIMS), np.int64)
    for (at, n), lang in zip(found, langs):
        totals[names.index(lang), at] += n
    shares = np.stack([log_shares(t) for t in totals])
    sums = totals.sum(axis=1)
    claims = []
    for (at, n), lang in zip(found, langs):
        own = names.index(lang)
        by_lang = shares[:, at] @ n
        by_lang[own] = np.log((totals[own, at] - n + 0.5) / (sums[own] - n.sum() + 0.5 * DIMS) * DIMS) @ n
        claims.append(by_lang.max() / n.sum())
    return replace(model, shares=shares, least=min(0.0, float(np.quantile(claims, ODD)) - SLACK))


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def predict(model: Model | None, text: bytes | None) -> tuple[str, float]:
    """The language and a confidence from 0 to 1."""
    if model is None or not text or not has_letter(text):
        return "und", 0.0
    margins = vector(found := counts(text)) @ model.weights
    n, score = len(model.families), 1.0 if model.shares is None else logistic(_SLOPE * (claim_of(model, found) - model.least))
    by_family = margins[:n]
    best = int(np.argmax(by_family))
    if n > 1:
        second = np.max(np.delete(by_family, best))
        score *= logistic(_SLOPE * (by_family[best] - second) / 2)
    langs = model.families[best][1]
    if len(langs) == 1:
        return langs[0], score
    votes = np.zeros((len(langs), 2))
    worst = np.full(len(langs), np.inf)
    for (f, i, j), m in zip(model.pairs, margins[n:]):
        if f == best:
            for k, own in ((i, m), (j, -m)):
                votes[k] += (own > 0, own)
                worst[k] = min(worst[k], own)
    top = max(range(len(langs)), key=lambda k: (votes[k][0], votes[k][1], -k))
    return langs[top], score * logistic(_SLOPE * worst[top])


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def chosen_texts(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """(lang, h, text): the sample, at most ``sample`` rows for each of at most ``languages`` languages.

    Ids are counted by language in one bounded sketch each. A row passes to the ranking if its hash is
    in the part of all hashes that should hold twice the sample, so about that many distinct hashes per language
    meet; equal ones are merged where they are read. Only the texts of the ranked leave their task.
    """
    scratch = Scratch(docs.sparkSession, "sample")
    rows = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("doc_id").alias("h"), "text")
    draw = F.pmod("h", F.lit(_DRAW))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("h").alias("n"))
    # At most ``languages`` rows are broadcast.
    sizes = scratch.save(sizes.orderBy(F.col("rows").desc(), "lang").limit(languages).select("lang", "n"), "sizes")
    thin = rows.select("lang", "h").join(F.broadcast(sizes), "lang").where(draw * F.col("n") < F.lit(2.0 * sample * _DRAW))
    thin = thin.select("lang", "h").distinct()
    ranked = thin.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(draw, "h"))).where(F.col("k") <= sample)
    chosen = scratch.save(ranked.select("lang", "h"), "chosen")
    # sample * languages rows at most are broadcast; a repeated id keeps one text, merged before the shuffle.
    found = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi")
    return found.groupBy("lang", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def learn(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """Fits on documents (doc_id, text, lang) whose fold is not 0: at most ``sample`` per language, of at most ``languages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                if has_letter(text.as_py()):
                    found = counts(text.as_py())
                    at = np.flatnonzero(found)
                    out.append((lang.as_py(), at.astype(np.int32).tobytes(), found[at].tobytes()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary()))], ["lang", "at", "n"])

    found = chosen_texts(docs, sample, languages).select("lang", "text").mapInArrow(run, "lang string, at binary, n binary").collect()
    found.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    x = np.zeros((len(found), DIMS), np.float32)
    for k, r in enumerate(found):
        dense = np.zeros(DIMS, np.int64)
        dense[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
        x[k] = vector(dense)
    langs = [r["lang"] for r in found]
    return with_claims(fit(x, langs), [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int64)) for r in found], langs)


def _plain(docs: DataFrame) -> DataFrame:
    """docs with columns named by place: Spark does not take names with dots into such functions."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of docs, with the predicted language and its score."""
    kept = [c for c in docs.columns if c not in (lang_pred, score)]
    rows = _plain(docs.select(*(F.col(f"`{c}`") for c in kept)))
    schema = T.StructType([*rows.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(shared.value, t.as_py()) for t in batch.column(at).cast(pa.binary())]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, lang_pred, score)


def trigram_totals(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each trigram stands in all texts (lang, text) with a letter of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            at = {lang: np.flatnonzero(n) for lang, n in held.items()}
            langs = pa.array([lang for lang in held for _ in range(len(at[lang]))], pa.string())
            grams, n = (np.concatenate([np.empty(0, np.int64), *found]) for found in (at.values(), (held[lang][at[lang]] for lang in held)))
            return pa.RecordBatch.from_arrays([langs, pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                if has_letter(text.as_py()):
                    if len(held) == HELD and lang.as_py() not in held:
                        yield told()
                        held.clear()
                    held[lang.as_py()] = held.get(lang.as_py(), 0) + counts(text.as_py())
        yield told()

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _best_claims(rows: DataFrame, totals: DataFrame, langs: list[str], text: str, own: str | None) -> DataFrame:
    """rows with ``claim``: of the language that suits the text best, minus infinity without a letter. With ``own``, a text's own language is taken without it.

    At most HELD languages are in memory at once: a row meets one block of them after the other.
    """
    spark = rows.sparkSession
    out = rows.withColumn("claim", F.lit(float("-inf")))
    at = [out.columns.index(c) for c in (text, own or text, "claim")]
    for k in range(0, len(langs), HELD):
        names = langs[k : k + HELD]
        found = totals.where(F.col("lang").between(names[0], names[-1])).toArrow()
        table = np.zeros((len(names), DIMS), np.int64)
        table[[names.index(x) for x in found["lang"].to_pylist()], found["gram"].to_numpy()] = found["n"].to_numpy()
        shared = spark.sparkContext.broadcast((names, table, np.stack([log_shares(t) for t in table])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, table, shares = shared.value
            sums = table.sum(axis=1)
            for batch in batches:
                claims = []
                for x, lang, before in zip(batch.column(at[0]).cast(pa.binary()), batch.column(at[1]), batch.column(at[2])):
                    best = before.as_py()
                    if x.as_py() and has_letter(x.as_py()):
                        grams = np.flatnonzero(n := counts(x.as_py()))
                        n = n[grams]
                        by_lang = shares[:, grams] @ n
                        if own and lang.as_py() in names:
                            j = names.index(lang.as_py())
                            by_lang[j] = np.log((table[j, grams] - n + 0.5) / (sums[j] - n.sum() + 0.5 * DIMS) * DIMS) @ n
                        best = max(best, float(by_lang.max() / n.sum()))
                    claims.append(best)
                columns = list(batch.columns)
                columns[at[2]] = pa.array(claims, pa.float64())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def claimed_by_any(docs: DataFrame) -> DataFrame:
    """The rows of docs (text, lang and any others) that have a letter and that a language of docs claims, whole.

    All labelled texts of all languages are learned from, and all of them, each claimed without itself, set the least claim: the highest step of 1 / STEPS that all
    but ``ODD`` of them reach, less ``SLACK``, and 0 at most. Work grows with the number of languages, memory does not.
    """
    scratch = Scratch(docs.sparkSession, "claims")
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    totals = scratch.save(trigram_totals(labelled), "totals")
    langs = [r["lang"] for r in totals.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    if not langs:
        return docs.where(F.lit(False))
    steps = _best_claims(labelled, totals, langs, "text", "lang").where(F.col("claim") > float("-inf")).groupBy(F.floor(F.col("claim") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    # Claims lie between fixed bounds, so steps are a bounded number.
    steps = scratch.save(steps, "steps")
    below = F.sum("n").over(W.orderBy("step"))
    n = steps.agg(F.sum("n")).first()[0]
    low = steps.withColumn("below", below).where(F.col("below") > F.lit(ODD) * F.lit(n - 1)).agg(F.min("step")).first()[0]
    rows = _plain(docs)
    text = rows.columns[docs.columns.index("text")]
    found = _best_claims(rows, totals, langs, text, None)
    return found.where(F.col("claim") >= min(0.0, low / STEPS - SLACK)).drop("claim").toDF(*docs.columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
