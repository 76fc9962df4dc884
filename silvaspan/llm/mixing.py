"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target, a share of all words by weight, held at ``cap`` times the source's own
size; what is above goes to the other sources by weight until none is above (a water level). A document
of a source with rate m = target / size is taken floor(m) times, and once more with probability
frac(m). That last choice is drawn by the cube method: the inclusion probabilities of a block of
documents move along directions that change neither the expected number of documents nor the expected
number of words, until each is zero or one; at most two documents of a block stay open. The open ones
of all blocks form new blocks of the same source, until one block is left, and only its last two
documents are landed: first keeping the word total, then by a draw.

Rows of equal id, size and source are counted first and numbered from 0; the block comes from a hash of the id,
the size and that number, never from Spark's partitions, and draws come from a generator seeded by source,
block and round: reruns and lost executors give the same rows. No text leaves its task; a block holds
a bounded number of (id, size) rows, however large its source and however often a row or an id repeats.

Targets need an order of all sources: the table of one row per source, not of documents, is sorted in one
task. It may hold ``MOST_SOURCES`` rows; beyond that an error is raised.

Defined results: null text has size 0; null sources are one source, the last; sources without words
have target 0 and nothing is taken; null ids are allowed; repeated rows are separate documents (equal
ones are interchangeable); extra columns are not read.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
BLOCK = 4096
#: Blocks of open documents that meet in the next round; each brings two at most.
MERGE = 1024
MOST_SOURCES = 1 << 20
#: Equal rows that one row stands for while they are numbered.
RUN = 1 << 16
SEED = 20
_EPS = 1e-9


def word_count(text: str = "text"):
    """The number of runs without white space (space, and the controls from tab to carriage return)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    The water level L solves sum(min(cap * size, L * weight)) = total. Sources are sorted by the level at
    which they are full; one running sum over this table of one row per source finds L.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("full", F.lit(cap) * F.col("source_size"))
    by_level = W.orderBy((F.col("full") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(W.partitionBy()))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source in this order that the level does not fill sets the level for it and all after it.
    per = per.withColumn("open_level", F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level")))
    per = per.withColumn("water", F.first("open_level", ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("full"), F.col("water") * F.col("weight")), F.col("full"))
    return per.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def fly(sizes: list[int], chances: list[float], draw: random.Random) -> list[float]:
    """Flight phase: the chances after all moves that keep their sum and their sum weighted by size; two are open at most."""
    chances = list(chances)
    open_: list[int] = []
    for k in range(len(sizes)):
        if not _EPS < chances[k] < 1 - _EPS:
            chances[k] = float(round(chances[k]))
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = (sizes[i] for i in open_)
        step = (float(b - c), float(c - a), float(a - b))
        if step == (0.0, 0.0, 0.0):
            step = (1.0, -1.0, 0.0)
        _move(open_, step, chances, draw)
        open_ = [i for i in open_ if 0 < chances[i] < 1]
    return chances


def land(sizes: list[int], chances: list[float], draw: random.Random) -> list[float]:
    """Landing phase: the number of documents is given up first, then the words; every chance ends at zero or one."""
    open_ = [i for i, p in enumerate(chances) if 0 < p < 1]
    while len(open_) > 1:
        a, b = (sizes[i] for i in open_[:2])
        _move(open_[:2], (float(b), float(-a)) if a or b else (1.0, -1.0), chances, draw)
        open_ = [i for i in open_ if 0 < chances[i] < 1]
    for i in open_:
        chances[i] = float(draw.random() < chances[i])
    return chances


def _move(at: list[int], step: tuple[float, ...], chances: list[float], draw: random.Random) -> None:
    """One random step to a face of the cube, along the line of step, that keeps every chance in expectation."""
    ahead = min(((1 - chances[i]) if s > 0 else chances[i]) / abs(s) for i, s in zip(at, step) if s)
    back = min((chances[i] if s > 0 else (1 - chances[i])) / abs(s) for i, s in zip(at, step) if s)
    by = ahead if draw.random() * (ahead + back) < back else -back
    for i, s in zip(at, step):
        p = chances[i] + by * s
        chances[i] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p


def take(units: DataFrame, block: int = BLOCK, merge: int = MERGE, seed: int = SEED) -> DataFrame:
    """Adds ``copies`` to rows (source, size, n_docs, rate, ...): how often the mix takes each.

    Besides these columns the rows hold ``key``, a long that orders a block; further columns are kept.
    """
    scratch = Scratch(units.sparkSession, "mix")
    rows = units.withColumn("base", F.floor("rate").cast("int")).withColumn("chance", F.col("rate") - F.floor("rate"))
    n_blocks = F.ceil(F.col("n_docs") / F.lit(block)).cast("long")
    rows = rows.withColumn("block", F.pmod(F.shiftrightunsigned("key", 8), n_blocks)).withColumn("blocks", n_blocks)
    rows = scratch.save(rows, "units")
    most = rows.agg(F.max("blocks")).first()[0] or 0
    schema = rows.schema
    done, level, spread = [], 0, 1
    order = [c for c in ("key", "size") if c in rows.columns]

    def settle(last: bool, level: int):
        def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
            draw = random.Random(f"{seed}|{keys[0]!r}|{keys[1]}|{level}")
            sizes = [int(x) for x in pdf["size"]]
            chances = fly(sizes, pdf["chance"].tolist(), draw)
            pdf["chance"] = land(sizes, chances, draw) if last else chances
            return pdf

        return run

    while most:
        at = F.floor(F.col("block") / F.lit(spread)).cast("long")
        last = most <= spread
        flown = rows.groupBy(F.col("source").alias("_s"), at.alias("_b")).applyInPandas(settle(last, level), schema)
        flown = scratch.save(flown, f"round{level}")
        done.append(flown.where("chance = 0 or chance = 1"))
        if last:
            break
        rows, level, spread = flown.where("chance > 0 and chance < 1"), level + 1, spread * merge
    out = done[0] if done else rows
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("base") + F.col("chance").cast("int")).drop("base", "chance", "block", "blocks")


def numbered(sizes: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, rank): equal rows are counted and come back as many times, numbered from 0."""
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_m"))
    runs = units.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {RUN}"))))
    first, last = F.col("_run") * RUN, F.least(F.col("_run") * RUN + (RUN - 1), F.col("_m") - 1)
    return runs.select("doc_id", "source", "size", F.explode(F.sequence(first, last)).alias("rank"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK, merge: int = MERGE) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs (doc_id, text, source)."""
    scratch = Scratch(docs.sparkSession, "sizes")
    sizes = scratch.save(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    targets = scratch.save(source_targets(sizes, weights, cap), "targets")
    if targets.count() > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    # One row per source, MOST_SOURCES at most: Spark broadcasts it only below its own size threshold.
    rows = numbered(sizes)
    rated = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("rate", rate).withColumn("key", F.xxhash64("doc_id", "size", "rank", F.lit(SEED))).drop("rank")
    taken = take(rated, block, merge)
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
