"""Repeated lines dropped by a sharded minimal perfect hash.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least ``shortest`` code points
that stand in at least ``least`` documents lose their lines in all documents but the one of the largest id.

The keys are known by a 128-bit hash. One aggregation counts the documents of every distinct hash; those that reach the threshold
are dealt into shards of about ``SHARD`` keys, and each shard becomes one small file in the shared folder: the bit
levels of a minimal perfect hash, and by its slots the arrays of 64-bit fingerprints, counts and last ids. Then the documents are read
once more, and their lines probe the arrays: no line is shuffled for that and no document is joined. Hashes below the
threshold never cost a line, so they have no slot; the fingerprint tells their lines apart.

Scale: counting shuffles 24 bytes per distinct line of a document, twice, the second time summed up. A shard takes
some 21 bytes a key. A task opens a shard at most once for each ``PIECE`` of its texts and keeps the last shards in
``CACHE`` bytes, so memory is bounded whatever the index's size, and an index that fits there is read once per worker. A shard's file
is written under the attempt's name and then renamed; its content depends on its keys alone, so repeated tasks do no harm.

Defined results: null and empty texts are one empty line; rows of one id are one document, and rows with a null id are together one
that stands below all others; a text that loses all lines is empty; ``least`` is at least 2; ids are whole numbers (others are an
error); repeated rows stay; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from silvaspan.llm.words import BLANK
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

SHORTEST, LEAST = 40, 5
#: Keys of a shard on average, bytes of text that one probe takes, and bytes of shards that a worker keeps.
SHARD, PIECE, CACHE = 1 << 15, 1 << 24, 1 << 27
#: Bits of a level for each key that is left.
ROOM = 2
_BLANK = BLANK.encode()
_CONTINUED = bytes(range(0x80, 0xC0))
_NO_ID = np.iinfo(np.int64).min


def key_of(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """The key of a line, or None if it is too short."""
    if len(line) < shortest:
        return None
    key = line.strip(_BLANK).lower()
    n = len(key) if key.isascii() else len(key.translate(None, _CONTINUED))
    return key if n >= shortest else None


def _hashed(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the keys' 128-bit hashes, unsigned."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _spot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys stand in a level: another mixture of both halves for each level."""
    x = hi + lo * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash: a key's slot is the rank of the bit that it has to itself in the first level where it has one."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int32)

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """The hash of distinct keys."""
        sizes, levels = [], []
        while len(hi):
            sizes.append(max(64, ROOM * len(hi)))
            at = _spot(hi, lo, len(sizes), sizes[-1])
            alone = np.bincount(at, minlength=sizes[-1]) == 1
            levels.append(alone)
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each key; some slot or -1 for others."""
        out, start = np.full(len(hi), -1, np.int64), 0
        left = np.arange(len(hi))
        for level, size in enumerate(self.sizes, 1):
            at = start + _spot(hi[left], lo[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]] - 1
            left, start = left[~hit], start + size
        return out


def _pack(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, last: np.ndarray) -> bytes:
    """The bytes of a shard: number of keys and levels, level sizes, bits, and the three arrays in slot order."""
    found = PerfectHash.of(hi, lo)
    order = np.argsort(found.slots(hi, lo))
    head = np.array([len(hi), len(found.sizes), *found.sizes], np.int64)
    arrays = lo[order], np.minimum(counts, 2**32 - 1).astype(np.uint32)[order], last[order]
    return b"".join(x.tobytes() for x in (head, np.packbits(found.bits), *arrays))


class Shard:
    """A shard that was read: which documents' lines it knows."""

    def __init__(self, data: bytes) -> None:
        n, levels = np.frombuffer(data, np.int64, 2)
        sizes = np.frombuffer(data, np.int64, levels, 16).tolist()
        at, total = 16 + 8 * int(levels), sum(sizes)
        self.hash = PerfectHash(sizes, np.unpackbits(np.frombuffer(data, np.uint8, (total + 7) // 8, at), count=total).astype(bool))
        at += (total + 7) // 8
        self.prints, self.counts, self.last = np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.uint32, n, at + 8 * n), np.frombuffer(data, np.int64, n, at + 12 * n)
        self.bytes = len(data) + 5 * total

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, count, last id) of each key."""
        slot = self.hash.slots(hi, lo)
        known = (slot >= 0) & (self.prints[slot] == lo)
        return known, self.counts[slot], self.last[slot]


class Shards:
    """The shards under a folder, of which a worker keeps the last ones."""

    def __init__(self, root: str) -> None:
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(root)
        self.kept: OrderedDict[int, Shard] = OrderedDict()
        self.bytes = 0

    def get(self, k: int) -> Shard | None:
        if k not in self.kept:
            path = f"{self.base}/shard-{k:08d}"
            if self.fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
                return None  # no key fell into it
            with self.fs.open_input_file(path) as file:
                self.kept[k] = Shard(file.read())
            self.bytes += self.kept[k].bytes
            while self.bytes > CACHE and len(self.kept) > 1:
                self.bytes -= self.kept.popitem(last=False)[1].bytes
        self.kept.move_to_end(k)
        return self.kept[k]


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(hi, lo, n, last): of every distinct key the halves of its hash, in how many documents it stands, and the largest id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for t in batch.column(1):
                own = {k for line in (t.as_py() or b"").split(b"\n") if (k := key_of(line, shortest)) is not None}
                keys += own
                sizes.append(len(own))
            if keys:
                hi, lo = _hashed(keys)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), ids], ["hi", "lo", "id"])

    found = rows.mapInArrow(run, "hi long, lo long, id long")
    n = F.count_distinct("id") + F.max(F.col("id").isNull().cast("long"))
    return found.groupBy("hi", "lo").agg(n.alias("n"), F.max("id").alias("last"))


def write_shards(counts: DataFrame, root: str) -> int:
    """Writes rows of ``line_counts`` as shards under root; returns into how many they are dealt."""
    n_shards = max(1, -(-counts.count() // SHARD))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("hi", "ascending"), ("lo", "ascending")])
        k = group.column("shard")[0].as_py()
        column = lambda c: group.column(c).fill_null(int(_NO_ID)).combine_chunks().to_numpy(zero_copy_only=False)
        data = _pack(column("hi").view(np.uint64), column("lo").view(np.uint64), column("n"), column("last"))
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        own = f"{base}/attempt-{TaskContext.get().taskAttemptId()}-{k}"
        with fs.open_output_stream(own, compression=None) as out:
            out.write(data)
        fs.move(own, f"{base}/shard-{k:08d}")
        return pa.table({"shard": [k], "keys": [group.num_rows], "bytes": [len(data)]})

    dealt = counts.withColumn("shard", F.pmod(F.col("hi"), F.lit(n_shards)).cast("long"))
    dealt.groupBy("shard").applyInArrow(build, "shard long, keys long, bytes long").write.parquet(f"{root}/written")
    return n_shards


def drop_lines(docs: DataFrame, root: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(id, n_lines, n_dropped, kept) for every row of docs, from the shards under root; kept is binary."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    schema = T._parse_datatype_string("id long, n_lines long, n_dropped long, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(root)

        def probed(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
            lines = [t.split(b"\n") for t in texts]
            keys, doc, line = [], [], []
            for i, own in enumerate(lines):
                for j, x in enumerate(own):
                    if (k := key_of(x, shortest)) is not None:
                        keys.append(k)
                        doc.append(i)
                        line.append(j)
            n_dropped = np.zeros(len(ids), np.int64)
            if keys:
                hi, lo = _hashed(keys)
                mine = np.array([_NO_ID if i is None else i for i in ids], np.int64)[doc]
                home = hi.view(np.int64) % n_shards
                order = np.argsort(home, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                    if shard := shards.get(int(home[at[0]])):
                        known, count, last = shard.probe(hi[at], lo[at])
                        for k in at[known & (count >= least) & (last != mine[at])]:
                            lines[doc[k]][line[k]] = None
                            n_dropped[doc[k]] += 1
            kept = [b"\n".join([x for x in own if x is not None]) for own in lines]
            arrays = [pa.array(ids, pa.int64()), pa.array([len(own) for own in lines], pa.int64()), pa.array(n_dropped), pa.array(kept, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(*batch.columns):
                ids.append(i.as_py())
                texts.append(t.as_py() or b"")
                held += len(texts[-1])
                if held >= PIECE:
                    yield probed(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:  # the next batch may come late; what is done goes on
                yield probed(ids, texts)
                ids, texts, held = [], [], 0

    return rows.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(id, n_lines, n_dropped, kept) for every row of docs; kept is the text that is left."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError("ids are whole numbers")
    if least < 2:
        raise ValueError("a repeated line stands in at least two documents")
    scratch = Scratch(docs.sparkSession, "lines")
    counts = scratch.save(line_counts(docs, id_col, text_col, shortest).where(F.col("n") >= least), "counts")
    root = scratch.path("shards")
    found = drop_lines(docs, root, write_shards(counts, root), id_col, text_col, shortest, least)
    return found.withColumn("kept", F.col("kept").cast("string"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the hash of what is left, of every document."""
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    d AS (SELECT k.*, coalesce(k.doc_id <> f.last, FALSE) AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""
