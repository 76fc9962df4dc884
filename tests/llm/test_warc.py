import base64
import hashlib

from pyspark.sql import functions as F

from silvaspan.llm import warc as A
from silvaspan.scratch import Scratch

SCHEMA = "page_id long, url string, html string"
SF = "/root/testdata/sf0.001"


def plain(rows):
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(i, best.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = best.get(html or "")
        kind, refers = ("response", None) if top is None or i == top else ("revisit", top)
        out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, refers))
    return sorted(out, key=str)


def read(df):
    return sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_round_trip_of_odd_rows(spark):
    rows = [(k, f"http://h/{k}\r\nX: y", f"<p>{k % 7}</p>\r\n\r\nWARC/1.1" * (k % 5)) for k in range(60)]
    rows += [(99, None, None), (98, "u", ""), (None, "u", "only null"), (None, "u", "x"), (97, "u", "x"), (97, "u", "x"), (96, "u", "é" * 400_000), (95, "u", "é" * 400_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("revisit", F.lit("clash")).withColumn("sha", F.lit(1))
    root = Scratch(spark, "warc").root
    A.write_archives(A.with_references(df), root, frame=5000, archive=20_000)
    back = A.read_archives(spark, root)
    assert read(back) == plain(rows)
    index = spark.read.parquet(f"{root}/index")
    assert index.count() == len(rows) and index.select("archive", "frame").distinct().count() > 4
    assert {r["url"] for r in back.where("page_id = 5").collect()} == {"http://h/5%0D%0AX: y"}
    picked = A.read_records(spark, root, index.where("start > 0").select("record_id")).collect()
    assert len(picked) == index.where("start > 0").count()
    for r in picked:
        fields, payload, end = A.parse(bytes(r["record"]))
        assert fields["WARC-Record-ID"] == r["record_id"] and end == len(r["record"])
        if fields["WARC-Type"] == "response":
            assert A.payload_digest(payload) == fields["WARC-Payload-Digest"][5:]


def test_all_pages_and_no_pages(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert read(A.op10_warc(spark, SF)) == plain(rows)
    root = Scratch(spark, "warc").root
    A.write_archives(A.with_references(spark.createDataFrame([], SCHEMA)), root)
    assert A.read_archives(spark, root).count() == 0


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], SCHEMA)
    got = {r["page_id"]: r["refers_to"] for r in A.with_references(df, 3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
