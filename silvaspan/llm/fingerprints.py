"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are pairs of neighbouring words (a single word where there is one only), weighted by their
lengths, which stands for rarity; every occurrence votes. A term's two XXH64 values give 128 signs, and
a bit of the fingerprint is set if more than half of the weight votes for it. Votes are summed two
bits to a long, in 64 sums per text, where the text's words already are: no word is shuffled.

``within`` finds all fingerprints inside a Hamming radius by permuted block tables: 128 bits are cut
into radius + 2 blocks, radius differing bits leave two blocks whole, so one table per pair of blocks,
keyed by them, holds every answer; candidates are verified. A key that more than ``DENSE`` fingerprints share
is dealt over as many tasks as it takes, with the queries, the smaller side, repeated.

``edited_texts`` needs each document's successor in descending id order. The order's distinct keys, ids and
hashes of texts, are cut into ranges of about ``PER_RANGE`` rows (``RANGES`` at most, then of more rows) by Spark's range
partitioning; their first keys are a constant of the plan, in which each text finds its range by halving: one shuffle of the texts, no
join, and nothing that grows with the number of ranges travels with a row. A window inside each range reads the next row, and each range's last row takes the first of the next. As
hashes of texts are part of the key, rows of one id, or of none, are split over ranges too; only
rows of equal id and text stay together, and where they are a large part of the table they travel as one row with
a count.

Defined results: null text counts as empty; no words give fingerprint zero; null ids come last in the
order; rows of equal id are ordered by the hash of their text, and are each other's neighbours; extra columns
are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from silvaspan.llm.skew import HEAVY, spread_join
from silvaspan.llm.words import BLANK, words
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

BITS = 128
RADIUS = 3
PER_RANGE = 4096
#: Ranges at most: a row for each is ordered in one task.
RANGES = 1 << 16
DENSE = 4096
_PAIR = (1 << 32) | 1


def hashed_words(text: str) -> Column:
    """A long per word: its XXH64 with the lowest four bits replaced by its length, 15 at most."""
    return F.transform(words(F.col(text), BLANK), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-16)).bitwiseOR(F.least(F.length(w), F.lit(15)).cast("long")))


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and ``fp``, an array of two longs, one row for each row of rows; keys tell rows apart."""
    hashed = rows.select(*keys, hashed_words(text).alias("_w"))
    size = F.size("_w")
    places = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0))))
    terms = hashed.select(*keys, "_w", F.explode_outer(places).alias("_i"))
    a, b = F.get("_w", F.col("_i")), F.get("_w", F.col("_i") + 1)
    weight = a.bitwiseAND(F.lit(15)) + F.coalesce(b.bitwiseAND(F.lit(15)), F.lit(0))
    terms = terms.select(*keys, F.xxhash64(a, b).alias("_h0"), F.xxhash64(a, b, F.lit(1)).alias("_h1"), weight.alias("_n"))
    sums = [F.sum(F.shiftrightunsigned(f"_h{k}", j).bitwiseAND(F.lit(_PAIR)) * F.col("_n")).alias(f"_s{k}_{j}") for k in (0, 1) for j in range(32)]
    voted = terms.groupBy(*keys).agg(F.sum("_n").alias("_all"), *sums)
    longs = []
    for k in (0, 1):
        parts = []
        for j in range(32):
            low = F.col(f"_s{k}_{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("_all")
            high = F.shiftrightunsigned(f"_s{k}_{j}", 32) * 2 > F.col("_all")
            parts += [F.when(low, F.lit(1 << j)).otherwise(F.lit(0)).cast("long"), F.when(high, F.lit(((1 << (j + 32)) + (1 << 63)) % (1 << 64) - (1 << 63))).otherwise(F.lit(0)).cast("long")]
        total = parts[0]
        for p in parts[1:]:
            total = total.bitwiseOR(p)
        longs.append(F.coalesce(total, F.lit(0)).cast("long"))
    return voted.select(*keys, F.array(*longs).alias("fp"))


def distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in (0, 1)), F.lit(0))


def likeness(a: str, b: str) -> Column:
    return (F.lit(1.0) - distance(a, b) / F.lit(float(BITS))).cast("double")


def hex_of(fp: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.get(fp, F.lit(k)))), 16, "0") for k in (0, 1)))


def block_keys(fp: str, radius: int) -> Column:
    """One key per pair of blocks, as an array of longs."""
    n = radius + 2
    cuts = [BITS * k // n for k in range(n + 1)]
    blocks = []
    for lo, hi in zip(cuts, cuts[1:]):
        parts = []
        for k in (0, 1):
            a, b = max(lo, 64 * k) - 64 * k, min(hi, 64 * k + 64) - 64 * k
            if a < b:
                parts.append(F.shiftrightunsigned(F.shiftleft(F.get(fp, F.lit(k)), 64 - b), 64 - b + a))
        blocks.append(parts)
    return F.array(*(F.xxhash64(F.lit(t), *blocks[i], *blocks[j]) for t, (i, j) in enumerate(itertools.combinations(range(n), 2))))


def within(queries: DataFrame, rows: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(query, fp, distance): all distinct fingerprints (column fp) of rows within the radius of each distinct one of queries."""
    scratch = Scratch(rows.sparkSession, "within")
    held = scratch.save(rows.select("fp").distinct().withColumn("key", F.explode(block_keys("fp", radius))), "held")
    asked = queries.select(F.col("fp").alias("query")).distinct().withColumn("key", F.explode(block_keys("query", radius)))
    large = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
    large = scratch.save(large.select("key", F.ceil(F.col("n") / F.lit(float(dense))).cast("long").alias("parts")), "large")
    near = held.join(large, "key", "left_anti").join(asked, "key").select("query", "fp")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    spread = asked.join(large, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    near = near.unionByName(held.join(large, "key").withColumn("part", part).drop("parts").join(spread, ["key", "part"]).select("query", "fp"))
    return near.withColumn("distance", distance("query", "fp")).where(F.col("distance") <= radius).distinct()


def _keys(starts: list[str]) -> Column:
    """An array of keys, given as JSON texts."""
    return F.from_json(F.lit(f"[{','.join(starts)}]"), "array<struct<lost: boolean, down: bigint, hash: bigint>>")


def _place_of(key: str, starts: list[str]) -> Column:
    """The place of the last of the starts, in ascending order, that is not above the key, by halving."""
    if not starts:
        return F.lit(0)
    array = _keys(starts)
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when(s["hi"] - s["lo"] <= 1, s).when(F.get(array, middle) <= F.col(key), pair(middle, s["hi"])).otherwise(pair(s["lo"], middle))

    steps = F.sequence(F.lit(1), F.lit(len(starts).bit_length()))
    return F.aggregate(steps, pair(F.lit(0), F.lit(len(starts))), halve, lambda s: s["lo"])


def edited_texts(docs: DataFrame) -> DataFrame:
    """(range, place, copies, doc_id, text, edited, next_range, next_place) for the rows of docs (doc_id, text).

    edited: the last half of the text's code points replaced by the first ones of the successor's text.
    (range, place) names a row; (next_range, next_place) its successor. copies: how many rows of docs it stands for.
    """
    scratch = Scratch(docs.sparkSession, "order")
    # Ascending in this key is descending in the id, nulls last; ids are whole numbers.
    order = F.struct(F.col("doc_id").isNull().alias("lost"), F.bitwise_not("doc_id").alias("down"), F.xxhash64("text").alias("hash"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", order.alias("key"), F.lit(1).cast("long").alias("copies"))
    counted = scratch.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counted")
    n, most = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > 1 and most * HEAVY > n:
        # Fewer than HEAVY keys. All but one of their rows are followed by an equal row.
        heavy = F.broadcast(counted.where((F.col("n") * HEAVY > n) & (F.col("n") > 1)).select("key"))
        merged = rows.join(heavy, "key", "left_semi").groupBy("key", "doc_id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        merged = merged.select("doc_id", "text", "key", F.explode(F.array(F.col("n") - 1, F.lit(1).cast("long"))).alias("copies"))
        rows = rows.join(heavy, "key", "left_anti").select(*merged.columns).unionByName(merged)
    # The ranges are cut over the keys alone, which are distinct here. Their first keys, RANGES rows at most whatever the table's size, are a constant of the plan.
    dealt = counted.select("key").repartitionByRange(min(max(1, n // PER_RANGE), RANGES), "key").select("key", F.spark_partition_id().alias("part"))
    starts = dealt.groupBy("part").agg(F.min("key").alias("key")).orderBy("key").select(F.to_json("key").alias("key"))
    starts = [r["key"] for r in starts.collect()]
    rows = rows.withColumn("range", _place_of("key", starts))
    # One row per range: its first text is what the last row of the range before is edited with.
    firsts = F.broadcast(docs.sparkSession.range(1).select(F.explode(_keys(starts)).alias("key")))
    tops = scratch.save(rows.select("key", "range", "text").join(firsts, "key").groupBy("range").agg(F.first("text").alias("first_text")), "tops")
    by = W.orderBy("range")
    after = tops.select("range", F.coalesce(F.lead("range").over(by), F.min("range").over(W.partitionBy())).alias("after"))
    after = after.join(tops.select(F.col("range").alias("after"), "first_text"), "after")
    inside = W.partitionBy("range").orderBy("key", F.col("copies").desc())
    seen = rows.select("range", "doc_id", "text", "copies", F.row_number().over(inside).alias("place"), F.lead("text").over(inside).alias("next"))
    seen = seen.join(after, "range", "left")
    last = F.col("next").isNull()
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce("next", "first_text"), F.lit(1), half))
    return seen.select(
        "range", "place", "copies", "doc_id", "text", edited.alias("edited"),
        F.when(last, F.col("after")).otherwise(F.col("range")).alias("next_range"), F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, the likenesses asked for, and for ids divisible by 100 how many documents are near."""
    return fingerprint_report(table(spark, sf_dir, "documents"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "fingerprints")
    both = edited_texts(docs).select(
        "range", "place", "copies", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "next_range", "next_place",
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"),
    )
    keys = ["range", "place", "copies", "doc_id", "n_chars", "edited_sha256", "next_range", "next_place", "which"]
    found = scratch.save(simhash(both.select(*keys[:-1], "x.which", "x.t"), keys, "t"), "fps")
    own = found.where("which = 0").drop("which")
    edited = found.where("which = 1").select("range", "place", F.col("fp").alias("edited_fp"))
    after = own.select(F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.col("fp").alias("next_fp"))
    rows = scratch.save(own.join(edited, ["range", "place"]).join(after, ["next_range", "next_place"]), "rows")
    sizes = scratch.save(own.groupBy("fp").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("units")), "sizes")
    near = within(own.where("doc_id % 100 = 0"), own).join(sizes.select("fp", "n"), "fp").groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("n_near"))
    near = scratch.save(near.join(sizes.select("fp", "units"), "fp"), "near")
    rows = spread_join(rows, near, "fp", "units", rows.count(), "left")
    asked = F.col("doc_id") % 100 == 0
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "n_chars", "edited_sha256", hex_of("fp").alias("fingerprint"), hex_of("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), F.when(asked, F.col("n_near")).alias("n_near"),
    )
