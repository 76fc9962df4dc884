"""Ranked lexical search over shards of an inverted index by Block-Max MaxScore.

Terms are runs of ASCII letters, ASCII digits and characters beyond ASCII, with A-Z lower-cased. A document scores, over an
item's terms once each, w * ((1000000000 * tf) div (1000 * tf + 8 * m)), where w falls with the term's document frequency and m
grows with the document's length (all whole numbers, see ``weight`` and ``damping``).

*Index.* Tasks turn their documents into shards of at most ``DOCS`` documents: a row per term with its postings in blocks of
``BLOCK``, each compressed (gaps and frequencies of variable length) beside the block's last document and the pairs
(frequency, length) that no other posting of the block beats, from which its exact maximum follows whatever the collection. So
shards never change when others are added: document frequencies, the number of documents and that of terms are sums over shards.

*Search.* Only the lists of terms that items hold leave the index. They meet by (shard, batch of items), and there each item's lists are
ordered by their largest contribution. Lists whose bounds together stay below the threshold are non-essential: documents
that stand in them alone are never looked at. Candidates of the essential lists are held against the block maxima of the others,
and only blocks that still hold a candidate are decompressed. Documents go in windows that double, so the threshold, the
item's k-th score in the shard, rises early. The shards' best are merged by a ranking that Spark cuts to k before the shuffle.
Candidates that could only equal the threshold are kept, since the smaller id wins ties.

Scale: a shard is bounded by documents and by ``TOKENS``, and a task reads the lists of one shard and batch after the other. The pairs
(batch, term) are broadcast only up to ``BROADCAST_ROWS``. A batch has some ``BATCH`` items, whatever their number; each batch reads
each shard's lists once.

Defined results: null texts and texts without a term are in no count and never found; items without a term have no rows; every row
of the items is an item of its own, so repeated ones have repeated results; rows of documents with one id are ranked one by one;
null ids stand last among equal scores; document ids are whole numbers (others are an error); empty tables give no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from silvaspan.llm.words import NOT_ALNUM, words
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

K = 10
#: Documents and terms of a shard at most (a longer document is alone), postings of a block, items of a batch, documents of the first window.
DOCS, TOKENS, BLOCK, BATCH, WINDOW = 1 << 13, 1 << 21, 128, 64, 256
#: Shards that share one copy of a batch's items on their way, and rows of (batch, term) up to which these are broadcast.
SHARE, BROADCAST_ROWS = 64, 1 << 20
_NO_ID = np.iinfo(np.int64).max
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "shard long, term binary, df int, total long, ends array<int>, stops array<int>, front array<int>, data binary"
_COLUMNS = ["shard", "term", "df", "total", "ends", "stops", "front", "data"]


def weight(df: Column, n_docs: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((F.lit(2) * n_docs + F.lit(2)).cast("double") / (F.lit(2) * df + F.lit(1)).cast("double")))


def damping(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms, of which all n_docs have n_terms."""
    return 100 - 90 + (90 * n.astype(np.int64) * n_docs) // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def pack_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of whole numbers, seven bits a byte and the eighth set but in the last, and where each number ends."""
    x = x.astype(np.uint64)
    size = 1 + sum((x >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(5):
        some = size > k
        more = (size[some] > k + 1).astype(np.uint8) << 7
        out[(ends - size)[some] + k] = ((x[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def shard_rows(shard: int, ids: list[int], sizes: list[int], tokens: np.ndarray, terms: list[bytes], most: int = BLOCK) -> pa.RecordBatch:
    """Rows of one shard: a row without a term (documents' ids and lengths), then a row per term. tokens: numbers of the terms of all documents in turn."""
    n_docs = len(ids)
    lengths = np.array(sizes, np.int64)
    key, tf = np.unique(tokens.astype(np.int64) * n_docs + np.repeat(np.arange(n_docs), lengths), return_counts=True)
    term, doc = key // n_docs, key % n_docs
    first = np.searchsorted(term, np.arange(len(terms) + 1))  # where a term's postings begin
    df = np.diff(first)
    # Blocks: runs of a term's postings.
    rank = np.arange(len(term)) - first[term]
    begins = np.flatnonzero(rank % most == 0)
    count = np.diff(np.append(begins, len(term)))
    block = np.repeat(np.arange(len(begins)), count)
    block_of_term = np.searchsorted(begins, first)
    gap = np.diff(doc, prepend=0)
    gap[begins] = doc[begins]
    # A block is its gaps, then its frequencies.
    inside = np.arange(len(term)) - begins[block]
    mixed = np.zeros(2 * len(term), np.int64)
    mixed[2 * begins[block] + inside] = gap
    mixed[2 * begins[block] + count[block] + inside] = tf
    data, ends = pack_numbers(mixed)
    stop = ends[2 * (begins + count) - 1]
    byte_of_term = np.append(0, stop)[block_of_term]
    # Per block the pairs that no other beats: by falling frequency, those shorter than all before.
    n = lengths[doc]
    order = np.lexsort((n, -tf, block))
    falling = n[order] - block[order] * (int(lengths.max()) + 1)
    best = np.ones(len(order), bool)
    best[1:] = falling[1:] < np.minimum.accumulate(falling)[:-1]
    kept = order[best]
    front = np.stack((block[kept] - block_of_term[term[kept]], tf[kept], n[kept]), 1)
    front_of_term = 3 * np.searchsorted(term[kept], np.arange(len(terms) + 1))
    own = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(terms), shard)), pa.array(terms, pa.binary()), pa.array(df, pa.int32()), pa.array(np.add.reduceat(tf, first[:-1])),
            _lists(block_of_term, doc[begins + count - 1]), _lists(block_of_term, stop - np.repeat(byte_of_term[:-1], np.diff(block_of_term))), _lists(front_of_term, front.ravel()),
            pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(byte_of_term.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
        ],
        names=_COLUMNS,
    )
    about = [[shard], [None], [n_docs], [int(lengths.sum())], [sizes], [None], [None], [np.array(ids, np.int64).tobytes()]]
    head = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(about, own.schema.types)], names=own.schema.names)
    return pa.Table.from_batches([head, own]).combine_chunks().to_batches()[0]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of all documents, as a stored table."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError("ids are whole numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    most_docs, most_tokens, block = DOCS, TOKENS, BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids, sizes, tokens, held = [], [], [], 0
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        for batch in batches:
            for i, t in zip(*batch.columns):
                found = (t.as_py() or b"").translate(_FLAT).split()
                if not found:
                    continue
                if ids and (len(ids) >= most_docs or held + len(found) > most_tokens):
                    yield shard_rows(shard, ids, sizes, np.concatenate(tokens), list(numbers), block)
                    shard += 1
                    ids, sizes, tokens, held = [], [], [], 0
                    numbers.clear()
                i = i.as_py()
                ids.append(_NO_ID if i is None else i)
                sizes.append(len(found))
                tokens.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                held += len(found)
        if ids:
            yield shard_rows(shard, ids, sizes, np.concatenate(tokens), list(numbers), block)

    return Scratch(docs.sparkSession, "index").save(rows.mapInArrow(run, INDEX), "shards")


class Postings:
    """A term's list in one shard; blocks are decompressed when they are asked for, once."""

    def __init__(self, row: dict, damped: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ends, self.stops = np.array(row["ends"]), row["stops"]
        self.data, self.damped = np.frombuffer(row["data"], np.uint8), damped
        front = np.array(row["front"]).reshape(-1, 3)
        tops = impact(front[:, 1], damping(front[:, 2], n_docs, n_terms))
        self.tops = np.maximum.reduceat(tops, np.flatnonzero(np.diff(front[:, 0], prepend=-1)))
        self.top = int(self.tops.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's documents and their impacts."""
        if b not in self.open:
            both = unpack_numbers(self.data[self.stops[b - 1] if b else 0 : self.stops[b]])
            docs = np.cumsum(both[: len(both) // 2])
            self.open[b] = docs, impact(both[len(both) // 2 :], self.damped[docs])
        return self.open[b]


def best_documents(lists: list[tuple[int, Postings]], ids: np.ndarray, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k highest-scoring documents of a shard; lists: weights above 0 and postings."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    bounds = np.cumsum([w * p.top for w, p in lists])
    top_ids, top_scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    start, size = 0, window
    while start < len(ids):
        stop = min(len(ids), start + size)
        # Documents in the first ``split`` lists alone stay below the threshold.
        split = int(np.searchsorted(bounds, threshold, "left"))
        sums = np.zeros(stop - start, np.int64)
        for w, p in lists[split:]:
            for b in range(int(np.searchsorted(p.ends, start)), min(len(p.ends), int(np.searchsorted(p.ends, stop - 1)) + 1)):
                docs, f = p.block(b)
                a, z = np.searchsorted(docs, (start, stop))
                sums[docs[a:z] - start] += w * f[a:z]
        at = np.flatnonzero(sums)
        bound = sums[at]
        at = at + start
        if split and len(at):
            alive = bound + bounds[split - 1] >= threshold
            at, bound = at[alive], bound[alive]
            # Every non-essential list adds its block's maximum at most; a document behind a list's last block gets nothing from it.
            tops = np.zeros((split, len(at)), np.int64)
            homes = np.zeros((split, len(at)), np.int64)
            for i, (w, p) in enumerate(lists[:split]):
                homes[i] = np.searchsorted(p.ends, at)
                tops[i] = w * np.append(p.tops, 0)[homes[i]]
            bound = bound + tops.sum(0)
            for i in range(split - 1, -1, -1):
                alive = bound >= threshold
                at, bound, tops, homes = at[alive], bound[alive], tops[:, alive], homes[:, alive]
                w, p = lists[i]
                bound -= tops[i]
                for b in np.unique(homes[i]):
                    if b < len(p.ends):
                        own = np.flatnonzero(homes[i] == b)
                        docs, f = p.block(int(b))
                        spot = np.searchsorted(docs, at[own])
                        bound[own] += np.where(docs[spot] == at[own], w * f[spot], 0)
        alive = bound >= threshold
        top_ids, top_scores = np.append(top_ids, ids[at[alive]]), np.append(top_scores, bound[alive])
        order = np.lexsort((top_ids, -top_scores))[:k]
        top_ids, top_scores = top_ids[order], top_scores[order]
        if len(order) == k:
            threshold = max(1, int(top_scores[-1]))
        start, size = stop, 2 * size
    return top_ids, top_scores


def search(index: DataFrame, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every item."""
    scratch = Scratch(index.sparkSession, "search")
    heads = index.where("term is null")
    n_docs, n_terms, n_shards = heads.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(1)), F.count(F.lit(1))).first()
    asked = items.select(F.col(id_col).alias("item_id"), F.array_distinct(words(F.col(text_col), NOT_ALNUM)).alias("terms")).where(F.size("terms") > 0)
    asked = scratch.save(asked.withColumn("key", F.monotonically_increasing_id()), "items")
    n_batches = max(1, -(-asked.count() // BATCH))
    pairs = scratch.save(asked.select("key", F.pmod(F.xxhash64("key"), F.lit(n_batches)).alias("batch"), F.explode("terms").alias("t")).select("key", "batch", F.col("t").cast("binary").alias("term")), "pairs")

    used = pairs.select("term").distinct()
    df = index.join(used, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weights = scratch.save(df.select("term", weight(F.col("df"), F.lit(n_docs)).alias("w")).where("w > 0"), "weights")
    queries = pairs.join(weights, "term").groupBy("batch", "key").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    queries = scratch.save(queries.groupBy("batch").agg(F.collect_list(F.struct("key", "terms")).alias("queries")), "queries")

    # The lists that a batch needs, and to every shard and batch a head: the shard's documents and the batch's items.
    wanted = scratch.save(pairs.select("batch", "term").distinct().join(weights.select("term"), "term", "left_semi"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    lists = index.join(wanted, "term").select("shard", "batch", "term", "ends", "stops", "front", "data")
    copies = max(1, n_shards // SHARE)  # of the items, so that no batch is one key for all shards
    spread = queries.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    heads = heads.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1)))).withColumn("copy", F.pmod(F.xxhash64("shard"), F.lit(copies)).cast("int"))
    heads = heads.withColumn("batch", F.col("batch").cast("long")).join(spread, ["batch", "copy"]).select("shard", "batch", "term", "ends", "data", "queries")
    met = lists.unionByName(heads, allowMissingColumns=True).repartition("shard", "batch").sortWithinPartitions("shard", "batch", F.col("term").asc_nulls_first())
    met, window = met.select("queries", "term", "ends", "stops", "front", "data"), WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, damped, by_term = [], None, None, {}

        def answered() -> Iterator[pa.RecordBatch]:
            for q in queries:
                own = [(t["w"], by_term[t["term"]]) for t in q["terms"] if t["term"] in by_term]
                if own:
                    found, scores = best_documents(own, ids, k, window)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q["key"])), pa.array(found, mask=found == _NO_ID), pa.array(scores)], ["key", "doc_id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for x in batch.slice(at, 512).to_pylist():
                    if x["term"] is None:  # a head: what came before is whole
                        yield from answered()
                        queries, by_term = x["queries"], {}
                        ids, damped = np.frombuffer(x["data"], np.int64), damping(np.array(x["ends"]), n_docs, n_terms)
                    else:
                        by_term[x["term"]] = Postings(x, damped, n_docs, n_terms)
        yield from answered()

    found = met.mapInArrow(run, "key long, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring of all documents for every benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term"
ORACLE = f"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL), d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
    s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), q AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
    x AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
        FROM q JOIN f USING (term) JOIN t USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
