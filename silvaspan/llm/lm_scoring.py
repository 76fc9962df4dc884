"""Language-model scores by prediction by partial matching over bytes.

A text is its lower-cased words with single spaces, then an end symbol. Its model is a trie of byte
contexts of length 0 to ``ORDER``; the longest known context predicts the next byte by its counts, each
less a half. An unseen byte costs an escape (half a unit for each distinct follower of the context,
method D) and goes to the next shorter context, where the followers of the longer one are excluded;
below the empty context the rest of the alphabet is uniform. A shorter context counts a follower once
for each longer context that it follows, as if it were only updated on escapes. A document's score is the sum of the log10 probabilities
of all its bytes, under the trie of the training documents.

The trie is a set of Spark tables. One pass counts every (context, next byte) window of ORDER + 1
bytes, and every word, of all documents; summing windows by their suffixes gives the shorter contexts,
joins of neighbouring levels give the exclusions, and two joins per level price every distinct window
of the corpus. A document then only adds the prices of its windows. What is counted and priced grows
with the input.

Prices reach the documents on two ways that give the same sums. Windows (and words) of at least a
threshold of occurrences go to all tasks as a sorted array; the threshold is the least power of two
that leaves ``bound`` entries at most, so the size of what is broadcast is checked before. All others,
the tail, go by a shuffle: each document emits its own tail keys with counts, joined with the prices.
No tail key is frequent, so that join has no hot key. Where all entries fit, the tail is empty. Rows are
numbered before they are stored, and the stored number ties a document to its tail. The tables of contexts of
up to two bytes have at most 2^16 rows and are broadcast; where a context of three bytes is joined, its
windows are dealt over ``SALTS`` tasks.

Defined results: null text counts as empty, one end symbol; a null id is neither held out nor learned
from; repeated rows stay repeated; with no training document every byte is uniform and every word
unknown; extra columns are not read. Windows are matched whole (48 bits), words by XXH64.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

ORDER = 5
#: Bytes that UTF-8 never has: the start of a text, as context only, and its end.
START, END = b"\xfe", b"\xff"
ALPHABET = 255
FOLDS = 5
BOUND = 1 << 20
SALTS = 16
GRAM, WORD = 0, 1
_PIECE = 1 << 20
_MANY = 1 << 20
_NO_KEY = np.uint64(2**64 - 1)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def windows(words: list[bytes], order: int = ORDER) -> Iterator[np.ndarray]:
    """All windows of order + 1 bytes that end at a byte of the text or at its end symbol, in bounded pieces."""
    text = START * order + b" ".join(words) + END
    for k in range(0, len(text) - order, _PIECE):
        b = np.frombuffer(text[k : k + _PIECE + order], np.uint8)
        n = len(b) - order
        gram = np.zeros(n, np.uint64)
        for j in range(order + 1):
            gram = (gram << np.uint64(8)) | b[j : j + n]
        yield gram


def word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 1, F.lit(False))


class _Tally:
    """Counts of 64-bit keys, kept as sorted arrays of a bounded size."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def over(self) -> tuple[np.ndarray, np.ndarray] | None:
        """What is to be given out, as merging has not made it small enough to go on; Spark adds up what is given out in parts."""
        if self.size <= 2 * _MANY:
            return None
        found = self.merged()
        self.parts, self.size = [found], len(found[0])
        if self.size <= _MANY:
            return None
        self.parts, self.size = [], 0
        return found

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[starts], np.add.reduceat(counts, starts)


def tallies(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, train, total): occurrences of every window and word in the training documents and in all."""
    rows = docs.select(F.col("text").cast("binary"), held_out().alias("held"), F.col("doc_id").isNull().alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = {(kind, train): _Tally() for kind in (GRAM, WORD) for train in (False, True)}
        pending: dict[bool, list[np.ndarray]] = {False: [], True: []}
        waiting = {False: 0, True: 0}
        seen: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def flush(train: bool, last: bool) -> Iterator[pa.RecordBatch]:
            if pending[train] and (last or waiting[train] > _MANY):
                tally[GRAM, train].add(*np.unique(np.concatenate(pending[train]), return_counts=True))
                pending[train], waiting[train] = [], 0
            if seen[train] and (last or len(seen[train]) > _MANY // 4):
                hashes = word_hashes(seen[train])
                at = np.argsort(hashes)
                tally[WORD, train].add(hashes[at], np.fromiter(seen[train].values(), np.int64)[at])
                seen[train] = Counter()
            for kind in (GRAM, WORD):
                found = tally[kind, train].merged() if last else tally[kind, train].over()
                if found is not None:
                    yield from given(kind, train, *found)

        def given(kind: int, train: bool, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), _MANY):
                part, own = keys[k : k + _MANY].view(np.int64), n[k : k + _MANY].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(own if train else own * 0), pa.array(own)], ["kind", "key", "train", "total"])

        for batch in batches:
            for text, held, lost in zip(*batch.columns):
                words, train = words_of(text.as_py()), not held.as_py() and not lost.as_py()
                for gram in windows(words, order):
                    pending[train].append(gram)
                    waiting[train] += len(gram)
                    yield from flush(train, False)
                for k in range(0, len(words), _MANY // 4):
                    seen[train].update(words[k : k + _MANY // 4])
                    yield from flush(train, False)
        for train in (False, True):
            yield from flush(train, True)

    found = rows.mapInArrow(run, "kind byte, key long, train long, total long")
    return found.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def prices(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, total, price): log10 probability of the last byte of every window after the bytes before it.

    grams: (key, train, total). One level of the trie per turn, the longest context first.
    """
    scratch = Scratch(grams.sparkSession, "trie")
    symbol = F.col("key").bitwiseAND(F.lit(255))

    def context(level: int) -> Column:
        return F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * level) - 1))

    longest = grams.where("train > 0").select("key", F.col("train").alias("n"))
    levels: dict[int, DataFrame] = {}
    for level in range(order, -1, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * (level + 1)) - 1)).alias("key")
        counted = F.sum("n") if level == order else F.count(F.lit(1))
        levels[level] = scratch.save(longest.select(suffix, "n").groupBy("key").agg(counted.alias("n")), f"level{level}")
        longest = levels[level]
    salt, salts = F.pmod(F.col("key"), F.lit(SALTS)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))

    def met(rows: DataFrame, found: DataFrame, key: str, size: int) -> DataFrame:
        """rows with what is found for their last ``size`` bytes: at most 256^2 rows are broadcast; three bytes, which a great part of all windows can share, are salted."""
        if size <= 2:
            return rows.join(F.broadcast(found), key, "left")
        if size == 3:
            return rows.withColumn("salt", salt).join(found.withColumn("salt", salts), [key, "salt"], "left").drop("salt")
        return rows.join(found, key, "left")

    state = grams.select("key", "total", F.lit(0.0).alias("lp"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("q_above"), F.lit(None).cast("long").alias("n_above"))
    for level in range(order, -1, -1):
        nodes = levels[level].select(context(level).alias("c"), symbol.alias("s"), "n", "key")
        if level:
            # n_short: what the next shorter context holds for the same byte; summed, the part that it excludes.
            short = levels[level - 1].select(F.col("key").alias("short"), F.col("n").alias("n_short"))
            nodes = nodes.withColumn("short", F.col("key").bitwiseAND(F.lit((1 << 8 * level) - 1))).join(short, "short")
            below = F.sum("n_short").alias("x_below")
        else:
            below = F.lit(0).cast("long").alias("x_below")
        stats = nodes.groupBy("c").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("q"), below)
        hits = levels[level].select(F.col("key").alias("node"), "n")
        at = state.withColumn("c", context(level)).withColumn("node", F.col("key").bitwiseAND(F.lit((1 << 8 * (level + 1)) - 1)))
        at = met(met(at, stats, "c", level), hits, "node", level + 1)
        known = F.col("all").isNotNull()
        left = F.col("q") - F.coalesce("q_above", F.lit(0))
        room = F.col("all") - F.coalesce("n_above", F.lit(0))
        hit = ~F.col("done") & F.col("n").isNotNull()
        miss = ~F.col("done") & F.col("n").isNull() & known
        lp = F.when(hit, F.col("lp") + F.log10((F.col("n") - 0.5) / room)).when(miss & (left > 0), F.col("lp") + F.log10(left * 0.5 / room)).otherwise(F.col("lp"))
        state = at.select(
            "key", "total", lp.alias("lp"), (F.col("done") | hit).alias("done"),
            F.when(known, F.col("q")).otherwise(F.col("q_above")).alias("q_above"),
            F.when(known, F.col("x_below")).otherwise(F.col("n_above")).alias("n_above"),
        )
        state = scratch.save(state, f"state{level}")
    rest = F.lit(float(ALPHABET)) - F.coalesce("q_above", F.lit(0))
    return state.select("key", "total", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") - F.log10(rest)).alias("price"))


def head(entries: DataFrame, weight: str, value: str, bound: int, *more: str) -> tuple[int, list[np.ndarray]]:
    """The threshold, and the sorted keys, the values and further columns of the entries of at least threshold occurrences, ``bound`` of them at most."""
    sizes = entries.groupBy((F.length(F.bin(weight)) - 1).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    at, n = 0, sum(r["n"] for r in sizes)
    for r in sorted(sizes, key=lambda r: r["p"]):
        if n <= bound:
            break
        at, n = r["p"] + 1, n - r["n"]
    found = entries.where(F.col(weight) >= 2**at).select("key", value, *more).toArrow()
    columns = []
    while found.num_columns:  # one column at a time, for the driver's memory
        columns.append(found.column(0).to_numpy())
        found = found.remove_column(0)
    keys = columns[0].view(np.uint64)
    order = np.argsort(keys)
    return 2**at, [keys[order], *(c[order] for c in columns[1:])]


class Slots:
    """Values by 64-bit key. A key's hash names one slot; where keys meet, the most frequent has it and the others are searched."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weights: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.keys, self.values = np.append(keys, _NO_KEY), np.append(values, 0.0)
        self.slot = np.full(1 << (64 - int(self.shift)), len(keys), np.int32)
        order = np.argsort(weights, kind="stable")
        self.slot[self._at(keys[order])] = order
        lost = self.slot[self._at(keys)] != np.arange(len(keys))
        self.rest = keys[lost], values[lost]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def sum(self, keys: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of the values of all keys that are known, and the others, sorted."""
        at = self.slot[self._at(keys)]
        hit = self.keys[at] == keys
        values, found = look_up(missed := keys[~hit], *self.rest)
        return float(self.values[at[hit]].sum()) + float(values.sum()), missed[~found]


def look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of keys, which are sorted in place so that the search runs along both arrays; which of them are known."""
    keys.sort()
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return np.where(hit, values[at], 0.0), hit


def score(docs: DataFrame, order: int = ORDER, bound: int = BOUND) -> DataFrame:
    """Scores of every row of docs (doc_id, text), as op5 returns them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    docs = docs.select("doc_id", "text")
    counted = scratch.save(tallies(docs, order), "counted")
    words = counted.where((F.col("kind") == WORD) & (F.col("train") > 0))
    ends = docs.where(~held_out() & F.col("doc_id").isNotNull()).count()
    v, n = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("train"), F.lit(0))).first()
    v, n = v + (ends > 0), n + ends
    floor = n + 0.5 * (v + 1)
    priced = scratch.save(prices(counted.where(F.col("kind") == GRAM).select("key", "train", "total"), order), "prices")
    words = words.select("kind", "key", "train", F.log10((F.col("train") + 0.5) / F.lit(floor)).alias("price"))
    w_least, known_words = head(words, "train", "price", bound)
    g_least, known_grams = head(priced, "total", "price", bound, "total")
    shared = spark.sparkContext.broadcast((Slots(*known_grams), *known_words))
    del known_grams, known_words
    g_tail, w_tail = g_least > 1, w_least > 1
    unknown, end = math.log10(0.5 / floor), math.log10((ends + 0.5) / floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, w_keys, w_values = shared.value
        for batch in batches:
            out, ends_at, kinds, keys, counts = [], [0], [], [], []

            def tail(kind: int, missed: np.ndarray) -> None:
                own, n = _unique(missed)
                kinds.append(np.full(len(own), kind, np.int8))
                keys.append(own)
                counts.append(n)
                ends_at[-1] += len(own)

            for text in batch.column(1):
                words, lp = words_of(text.as_py()), 0.0
                ends_at.append(ends_at[-1])
                for gram in windows(words, order):
                    known, unknown_grams = slots.sum(gram)
                    lp += known
                    if g_tail:
                        tail(GRAM, unknown_grams)
                hashes = word_hashes(words)
                values, hit = look_up(hashes, w_keys, w_values)
                known, base = int(hit.sum()), float(values.sum()) + end
                if w_tail:
                    tail(WORD, hashes[~hit])
                else:
                    base += unknown * (len(words) - known)
                out.append((len(words) + 1, known + (ends > 0), base, lp))
            if not out:
                continue
            cols = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64())))]
            # The tails stay flat arrays, a few bytes an entry.
            flat = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((kinds, np.int8), (keys, np.int64), (counts, np.int64)))
            entries = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["kind", "key", "n"])
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), entries)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "tail"])

    rows = docs.select("doc_id", F.col("text").cast("binary"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_tokens long, n_known long, base_score double, score double, tail array<struct<kind: byte, key: long, n: long>>").fields])
    found = rows.mapInArrow(run, schema)
    if g_tail or w_tail:
        # Stored with the rows, so that both reads below see the same numbers.
        found = scratch.save(found.withColumn("row", F.monotonically_increasing_id()), "heads")
        keyed = found.select("row", F.explode("tail").alias("t")).select("row", "t.*")
        value = priced.where(F.col("total") < g_least).select(F.lit(GRAM).cast("byte").alias("kind"), "key", F.col("price").alias("v"))
        value = value.unionByName(words.where(F.col("train") < w_least).select("kind", "key", F.col("price").alias("v")))
        is_word = F.col("kind") == WORD
        each = keyed.join(value, ["kind", "key"], "left").groupBy("row").agg(
            F.sum(F.when(is_word & F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("k"),
            F.sum(F.when(is_word, F.col("n") * F.coalesce("v", F.lit(unknown))).otherwise(0.0)).alias("b"),
            F.sum(F.when(~is_word, F.col("n") * F.col("v")).otherwise(0.0)).alias("s"),
        )
        found = found.join(each, "row", "left").select(
            "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
            (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
        )
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _unique(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(sorted_keys, return_counts=True)
    return keys.view(np.int64), n


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents."""
    return score(table(spark, sf_dir, "documents"))
