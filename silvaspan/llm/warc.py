"""WARC archives as seekable Zstandard bundles.

Every page becomes one WARC record: a response with the page's payload, or, where another page of the
same payload has a larger id, a revisit that refers to it and holds no payload. Tasks write their rows
as archives: records are grouped into independent Zstandard frames of about ``FRAME`` bytes, and a
skippable frame at the end holds the seek table (sizes of all frames), so any frame is found from the
footer alone. The index, a Parquet table beside the archives, maps each record to its frame and to its
place inside the frame.

Archive names hold the task attempt, and the index, committed by Spark, names only archives of the
attempts that succeeded: a lost executor's half-written files are never read. A payload group is one
number (its largest id) after a partial aggregation, and pages are joined with it by their digest, those of
a group that holds a large part of all pages where they are. Archives are read back by groups of ``READ``
frames, dealt over tasks by a number that follows their sizes.

Defined results: null html is an empty payload; null urls have no target line; line breaks in urls
become %0D and %0A; a null id never becomes the referred response unless its whole group has null ids,
then all of it are responses; rows that repeat the largest id of their payload are all responses, and rows of
one id and payload share a record id, since they are one record written twice; an
empty table writes no archive and reads back as no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from silvaspan.llm.skew import spread_join
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

FRAME = 1 << 18
ARCHIVE = 1 << 26
LEVEL = 3
#: Frames that one row of the read-back stands for, and the compressed bytes that a task of it should read.
READ, READ_BYTES = 64, 1 << 25
#: Fixed values of the Zstandard seekable format and of the record's layout.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
INDEX = "archive string, frame int, frame_start long, frame_bytes long, start long, length long, record_id string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def render(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> tuple[str, bytes]:
    """The record's id and its bytes."""
    digest = payload_digest(payload)
    name = record_id(page_id, digest)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"WARC-X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header lines, payload and end of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(fields["Content-Length"])
    block = data[stop + 4 : end]
    return fields, block[block.index(b"\r\n\r\n") + 4 :], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame at the end of an archive, from (compressed, plain) sizes of its frames."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, read from the end of the file."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    out, start = [], 0
    for packed, _ in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((start, packed))
        start += packed
    return out


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, revisit) for every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    rows = rows.withColumn("size", F.octet_length("html"))
    keyed = rows.where(F.col("size") >= least_bytes).select("page_id", "sha")
    top = keyed.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null")
    top = Scratch(pages.sparkSession, "payloads").save(top, "top")
    found = spread_join(rows, top, "sha", "n", pages.count(), "left")
    refers = F.when((F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"), refers.isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, root: str, frame: int = FRAME, archive: int = ARCHIVE) -> None:
    """Writes rows of ``with_references`` as archives under root, and their index as root/index."""
    columns = T._parse_datatype_string(INDEX).names
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(f"{base}/archives", recursive=True)
        task = TaskContext.get()
        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        out, sizes, name, written, files = None, [], "", 0, 0
        held: list[tuple[str, bytes]] = []
        held_bytes = 0

        def flush() -> pa.RecordBatch:
            nonlocal written, held_bytes
            plain = b"".join(x for _, x in held)
            packed = pack.compress(plain)
            out.write(packed)
            rows, at = [], 0
            for record, x in held:
                rows.append((name, len(sizes), written, len(packed), at, len(x), record))
                at += len(x)
            sizes.append((len(packed), len(plain)))
            written += len(packed)
            held.clear()
            held_bytes = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*batch.columns):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.zst"
                    out, sizes, written, files = fs.open_output_stream(f"{base}/archives/{name}", compression=None), [], 0, files + 1
                held.append(render(page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py(), revisit.as_py()))
                held_bytes += len(held[-1][1])
                if held_bytes >= frame:
                    yield flush()
                    if written >= archive:
                        out.write(seek_table(sizes))
                        out.close()
                        out = None
        if out is not None:
            if held:
                yield flush()
            out.write(seek_table(sizes))
            out.close()

    rows = pages.select("page_id", "url", F.encode("html", "UTF-8").alias("html"), "refers_to", "revisit")
    rows.mapInArrow(run, INDEX).write.parquet(f"{root}/index")


def read_archives(spark: SparkSession, root: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id) of every record, from the archives that the index names."""
    index = spark.read.schema(INDEX).parquet(f"{root}/index")
    frames = index.groupBy("archive", "frame").agg(F.max("frame_bytes").alias("bytes"))
    parts = frames.groupBy("archive", F.expr(f"frame div {READ}").alias("part")).agg(F.sum("bytes").alias("bytes"))
    total, n = parts.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    # A number that is given is not coalesced at run time: the parts of one archive go to many tasks.
    names = parts.select("archive", "part").repartition(max(1, min(n, total // READ_BYTES + 8)), "archive", "part")
    schema = f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, url string, record_id string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/archives/{name}") as file:
                    for start, size in read_seek_table(file, file.size())[READ * part : READ * (part + 1)]:
                        file.seek(start)
                        data = unpack.decompress(file.read(size))
                        rows, at = [], 0
                        while at < len(data):
                            fields, payload, at = parse(data, at)
                            kind = fields["WARC-Type"]
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and payload_digest(payload) != digest:
                                raise ValueError(f"a payload of {name} differs from its digest")
                            rows.append((fields.get("WARC-X-Page-ID"), int(fields["WARC-X-Payload-Length"]), digest, kind, fields.get("WARC-X-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"]))
                        ids, n, digests, kinds, refers, urls, records = zip(*rows)
                        number = (lambda x: x if x is None else int(x)) if id_type != "string" else (lambda x: x)
                        kind_of = pa.int64() if id_type == "long" else pa.int32() if id_type == "int" else pa.string()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(map(number, ids), kind_of), pa.array(n, pa.int64()), pa.array(digests), pa.array(kinds), pa.array(map(number, refers), kind_of), pa.array(urls, pa.string()), pa.array(records)],
                            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"],
                        )

    return names.mapInArrow(run, schema)


def read_records(spark: SparkSession, root: str, record_ids: DataFrame) -> DataFrame:
    """(record_id, record) for the ids of record_ids (column record_id): each frame that holds one is read once, alone."""
    at = spark.read.schema(INDEX).parquet(f"{root}/index").join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    at = at.repartition("archive", "frame").sortWithinPartitions("archive", "frame_start", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        last, data = None, b""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (key := (r["archive"], r["frame_start"])) != last:
                    with fs.open_input_file(f"{base}/archives/{r['archive']}") as file:
                        file.seek(r["frame_start"])
                        last, data = key, zstandard.ZstdDecompressor().decompress(file.read(r["frame_bytes"]))
                out.append((r["record_id"], data[r["start"] : r["start"] + r["length"]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary()))], ["record_id", "record"])

    return at.mapInArrow(run, "record_id string, record binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives in the shared folder and returns what is read back."""
    root = Scratch(spark, "warc").root
    write_archives(with_references(table(spark, sf_dir, "pages")), root)
    return read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
