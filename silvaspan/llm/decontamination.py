"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Tokens are runs of letters and digits of the text with A-Z lower-cased. A mask reads the words under its
ones and ignores those under its zeros. Hashes of the masks at all places of the benchmark items are
joined with those of the documents; around a hit, document and item are laid side by side and every
window of ``WINDOW`` tokens of the item that holds the hit (of a shorter item the whole) is compared word by
word. An overlap stands if 0.8 of a window's words are equal, so substitutions are tolerated; places beyond
the document's ends count as different.

``MASKS`` names the masks by the window's length, so that no window within the tolerance is left out: windows
of 10 to 13 words may hold two substitutions, those of 5 to 9 one, shorter ones none, and
wherever they are, one of the masks fits unbroken somewhere (tested over all cases). A document only
makes hashes of masks that some item needs.

The hash table of the benchmark holds a bounded number of bytes per row, the words around its place, and is
broadcast only if its counted rows are at most ``BROADCAST_ROWS``; then a document's windows are compared
where its text was read, and only overlaps are shuffled. Beyond that, hashes are joined by a shuffle in which
every hash is spread over ``SALTS`` tasks, and hits meet their document's tokens again by row.

Defined results: null and empty texts and items have no overlap; null ids are kept; repeated rows of
documents repeat their overlaps as one row per (doc_id, item_id), and so do ids that repeat with other
texts, with the most equal words of any; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from silvaspan.llm.words import LOWER, NOT_ALNUM, UPPER, words
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

WINDOW = 13
SIMILARITY = 0.8
#: Masks by window length: each set leaves no placement of the substitutions that SIMILARITY allows unseen.
MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",),
    5: ("1111", "10111", "11011", "11101"), 6: ("1111", "11011"), 7: ("1111", "11011"), 8: ("11111", "111011"), 9: ("11111", "111011"),
    10: ("11111", "111011", "11010011"), 11: ("11111", "111011", "11010011"), 12: ("11111", "111011"), 13: ("11010011",),
}
ALL_MASKS = tuple(sorted({m for own in MASKS.values() for m in own}, key=lambda m: (len(m), m)))
#: A hit's mask starts at most this many words behind the first word of its window.
BACK = 8
BROADCAST_ROWS = 1 << 18
SALTS = 16


def tokens(text: str = "text") -> Column:
    """Hashes of the text's words, in order."""
    return F.transform(words(F.col(text), NOT_ALNUM), lambda w: F.xxhash64(w))


def needed(window: int) -> int:
    """How many words of a window have to be equal."""
    return math.ceil(SIMILARITY * window - 1e-9)


def seeds(rows: DataFrame, array: str, pos: str, masks: tuple[str, ...], window: str | None = None) -> DataFrame:
    """One row for each place and mask: columns of rows, ``pos`` from 0 and the hash ``key``; with ``window``, only masks of that window length."""
    least = min(map(len, masks), default=1)
    # No filter on the array's size: it would be pushed below and compute the array twice.
    places = F.when(F.size(array) >= least, F.sequence(F.lit(0), F.size(array) - least))
    placed = rows.withColumn(pos, F.explode(places))
    keys = []
    for mask in masks:
        under = [F.get(array, F.col(pos) + j) for j, bit in enumerate(mask) if bit == "1"]
        key, fits = F.xxhash64(F.lit(ALL_MASKS.index(mask)), *under), F.col(pos) + len(mask) <= F.size(array)
        if window:
            fits = fits & F.col(window).isin([n for n, own in MASKS.items() if mask in own])
        keys.append(F.when(fits, key) if window or len(mask) > least else key)
    return placed.withColumn("key", F.explode(F.array(*keys))).where("key is not null")


def around(array: str, pos: str) -> Column:
    """(near, off): the words that any window of a hit at pos can hold, and the place of the hit among them."""
    lo = F.greatest(F.col(pos) - BACK, F.lit(0))
    return F.struct(F.slice(array, lo + 1, F.col(pos) + WINDOW - lo).alias("near"), (F.col(pos) - lo).alias("off"))


def compared(hits: DataFrame, *keys: str) -> DataFrame:
    """keys, ``window`` and ``matched``: the most equal words in a window of the item that starts at most ``BACK`` words before the hit.

    The few words around a hit are cut out first, by a generator, through which Spark pushes nothing
    back: the scan of all places stays a small loop, and no row carries its document on.
    """
    rows = hits.select(*keys, "q", "n", "item", "window", F.explode(F.array(around("doc", "p"))).alias("x")).select(*keys, "q", "n", "item", "window", "x.near", "x.off")
    matched = F.expr(f"""
        element_at(transform(
            array(transform(sequence(-{BACK}, {WINDOW - 1}), j -> if(coalesce(get(near, off + j) = get(item.near, item.off + j), false), 1, 0))),
            e -> if(window < {WINDOW}, aggregate(e, 0, (a, x) -> a + x),
                array_max(transform(filter(sequence(-{BACK}, 0), s -> q + s >= 0 and q + s + {WINDOW} <= n),
                                    s -> aggregate(slice(e, s + {BACK + 1}, {WINDOW}), 0, (a, x) -> a + x))))), 1)""")
    return rows.select(*keys, "window", matched.alias("matched"))


def overlaps(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, window, matched, similarity): every pair of a document (doc_id, text) and an item (item_id, text) with an overlap."""
    scratch = Scratch(docs.sparkSession, "seeds")
    known = items.select("item_id", tokens().alias("words")).withColumn("n", F.size("words")).withColumn("window", F.least("n", F.lit(WINDOW)))
    table_ = seeds(known, "words", "q", ALL_MASKS, "window").select("key", "item_id", "q", "n", "window", around("words", "q").alias("item"))
    table_ = scratch.save(table_, "items")
    lengths = {r["window"] for r in table_.select("window").distinct().collect()}
    masks = tuple(m for m in ALL_MASKS if any(m in MASKS[n] for n in lengths))
    rows = docs.select("doc_id", tokens().alias("doc"))
    if table_.count() <= broadcast_rows:
        hits = seeds(rows, "doc", "p", masks).join(F.broadcast(table_), "key")
    else:
        rows = rows.withColumn("row", F.struct(F.xxhash64("doc"), "doc_id"))
        # The words of a passage that very many documents share are dealt over SALTS tasks; the items' side, the smaller one, is repeated.
        own = seeds(rows, "doc", "p", masks).select("row", "p", "key", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
        asked = table_.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = own.join(asked, ["key", "salt"]).drop("key", "salt").dropDuplicates(["row", "item_id", "p", "q"])
        hits = hits.join(rows.dropDuplicates(["row"]), "row")
    need = F.element_at(F.array(*(F.lit(needed(n)) for n in range(1, WINDOW + 1))), F.col("window"))
    verified = compared(hits, "doc_id", "item_id").where(F.col("matched") >= need)
    found = verified.groupBy("doc_id", "item_id", "window").agg(F.max("matched").alias("matched"))
    return found.withColumn("similarity", F.col("matched") / F.col("window"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """The same rows by comparing all words of all documents with all words of all items."""
    split = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH d AS (SELECT doc_id, {split} AS t FROM documents), i AS (SELECT item_id, {split} AS t FROM benchmark),
        dt AS (SELECT doc_id, md5(array_to_string(t, ' ')) AS row, unnest(t) AS tok, generate_subscripts(t, 1) AS p FROM d),
        it AS (SELECT item_id, len(t) AS n, least(len(t), {WINDOW}) AS w, unnest(t) AS tok, generate_subscripts(t, 1) AS q FROM i),
        eq AS (SELECT DISTINCT doc_id, row, item_id, n, w, p - q AS diag, q FROM dt JOIN it USING (tok)),
        cand AS (SELECT doc_id, row, item_id, n, w, diag, count(*) AS m FROM eq GROUP BY ALL HAVING count(*) >= (4 * w + 4) // 5),
        every AS (SELECT *, unnest(range(1, n + 1)) AS q FROM cand WHERE w = {WINDOW}),
        hit AS (SELECT e.*, CASE WHEN eq.q IS NULL THEN 0 ELSE 1 END AS same FROM every e LEFT JOIN eq ON e.doc_id IS NOT DISTINCT FROM eq.doc_id AND e.row = eq.row AND e.item_id IS NOT DISTINCT FROM eq.item_id AND e.diag = eq.diag AND e.q = eq.q AND e.n = eq.n),
        slid AS (SELECT doc_id, item_id, w, sum(same) OVER win AS m, count(*) OVER win AS c FROM hit
                 WINDOW win AS (PARTITION BY doc_id, row, item_id, n, diag ORDER BY q ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)),
        found AS (SELECT doc_id, item_id, w, m FROM slid WHERE c = {WINDOW} AND m >= {needed(WINDOW)} UNION ALL SELECT doc_id, item_id, w, m FROM cand WHERE w < {WINDOW})
        SELECT doc_id, item_id, CAST(w AS INTEGER) AS "window", CAST(max(m) AS INTEGER) AS matched, max(m) / CAST(w AS DOUBLE) AS similarity
        FROM found GROUP BY doc_id, item_id, w"""
