"""Near duplicates by SimHash with pigeonhole blocks.

A document's fingerprint is the majority vote, bit by bit, of the XXH64 values of its word shingles.
Two fingerprints are linked when they differ in at most two bits, and the components of the links are
the groups of near duplicates.

Links are searched among *distinct* fingerprints, so a thousand exact copies are one row. The 64 bits
are split into four blocks of 16. Two differing bits touch at most two blocks, hence every linked pair
agrees on at least one of the six pairs of blocks: six block tables with 32-bit keys, a join on the
key, and a check of the Hamming distance find all links.

A block that holds more than ``dense`` fingerprints would join quadratically. Its fingerprints are
split further, by every point one bit away: two fingerprints at distance two or less share such a
point, and two that share one are at distance two or less, so each point is a clique that a star from
its smallest member spans. A point has at most 65 members. No link is lost on either way.

Defined results: null and empty texts have fingerprint zero and are linked like others; texts of one
or two words have one shingle, the whole sequence; repeated rows stay repeated; null ids are ignored
by the minimum (a component of null ids only has a null id); extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from silvaspan.llm.skew import spread_join
from silvaspan.operators.components import components_of_edges
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCK_BITS = 16
DENSE = 64
_VOTES = 1 << 16


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        pieces: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        pieces = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned 64-bit hashes."""
    n = len(hashes)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, _VOTES):
        bits = np.unpackbits(hashes[k : k + _VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    schema = T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, schema)


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within two bits."""
    scratch = Scratch(distinct.sparkSession, "links")
    n_blocks = 64 // BLOCK_BITS
    keep = (1 << BLOCK_BITS) - 1
    block = [F.shiftrightunsigned("fp", BLOCK_BITS * k).bitwiseAND(F.lit(keep)) for k in range(n_blocks)]
    tables = [(i, j) for i in range(n_blocks) for j in range(i + 1, n_blocks)]
    keys = [F.lit(t << 32).cast("long") + F.shiftleft(block[i], BLOCK_BITS) + block[j] for t, (i, j) in enumerate(tables)]
    blocks = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A key that a large part of all fingerprints share is broadcast, so its rows stay where they are.
    n_rows = len(tables) * distinct.count()
    placed = scratch.save(spread_join(blocks, shared, "key", "n", n_rows), "blocks")

    few = placed.where(F.col("n") <= dense)
    x, y = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))

    many = placed.where(F.col("n") > dense).select("fp").distinct()
    flipped = F.expr("transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k))")
    points = many.select("fp", F.explode(F.concat(F.array("fp"), flipped)).alias("point"))
    stars = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select("a", F.explode("all").alias("b")).where("a <> b")
    return near.select("a", "b").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """(id, fingerprint, component_id, fp) for every row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, id_col, text_col), "fps")
    kinds = scratch.save(fps.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "kinds")
    members = components_of_edges(links(kinds.select("fp"), dense)).select(F.col("node").alias("fp"), "component")
    rooted = scratch.save(kinds.join(members, "fp", "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("component")), "rooted")
    groups = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("kinds"))
    n_kinds, n_rows = rooted.agg(F.count(F.lit(1)), F.sum("n")).first()
    classes = scratch.save(spread_join(rooted, groups, "component", "kinds", n_kinds).select("fp", "n", "component_id"), "classes")
    # One fingerprint may stand for a third of all rows, and one component for a third of all fingerprints: neither meets in one task.
    named = spread_join(fps, classes, "fp", "n", n_rows or 0)
    return named.select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
