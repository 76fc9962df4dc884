import math
import random
import re
import sys
import zlib

from pyspark.sql import functions as F

from silvaspan.llm import url_filter as U

SCHEMA = "page_id long, url string, html string"


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=(None, None, None))
    return host, path, best[1] and best[1] + best[2], best[0]


URLS = [
    "http://a.example.net/en/1", "HTTPS://A.Example.NET/de/1", "http://example.net/en/", "http://xexample.net/en/2?x=/de/", "http://net/", "http://net", "x://b.example.com/de/7#top",
    "http://b.example.com/de", "http://notexample.com/de/5", "ftp://a.org/fr/9", "http://a.org/fr", "http://org.a/fr/", "no scheme/net/", "", None, "http://", "http://u:p@h.net:80/q", "a://b://c.net/", "http://h.net?x", "http://ÄB.net/ä", "//x.net/", "http://a.net/" + "d/" * 40_000,
]


def plain_templates(paths):
    """Template of every path (host, segments) with its (pages, labelled, bad), by recursion over the tree, segment by segment."""
    out = {}

    def go(host, template, rows):
        kids = {}
        for full, rest, counts in rows:
            if rest:
                kids.setdefault(rest[0], []).append((full, rest[1:], counts))
            else:
                out[host, full] = template
        sums = {seg: [sum(c[k] for _, _, c in own) for k in range(3)] for seg, own in kids.items()}
        all_n, all_m, all_bad = (sum(x[k] for x in sums.values()) for k in range(3))
        rate = all_bad / all_m if all_m else 0.0
        groups = {}
        for seg, own in kids.items():
            n, m, bad = sums[seg]
            alike = len(kids) > 1 and m > 0 and abs(bad / m - rate) <= U.Z * math.sqrt(rate * (1 - rate) / m)
            rare = len(kids) > U.FAN and n < U.SHARE * all_n
            near = abs((bad + U.WEIGHT * rate) / (m + U.WEIGHT) - rate) <= U.Z * math.sqrt(rate * (1 - rate) / (m + U.WEIGHT))
            groups.setdefault("*" if alike or rare and near else seg, []).extend(own)
        for to, own in groups.items():
            go(host, (*template, to), own)

    by_host = {}
    for (host, segs), counts in paths.items():
        by_host.setdefault(host, []).append((segs, segs, counts))
    for host, rows in by_host.items():
        go(host, (), rows)
    return out


def variable(s):
    return "*" if re.search("[0-9]", s) and re.search(r"^[0-9]+(\.[A-Za-z0-9]+)?$|^[0-9A-Fa-f-]{8,}$", s) else s


def plain_judge(rows, labels):
    """page_id to (verdict, template) by plain loops; labels: page_id to bad."""
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    own, paths = {}, {}
    for i, url in rows:
        host, path, _, told = plain(url)
        segs = tuple(variable(s) for s in path.split("/") if s)
        own[i] = host, path, segs, told
        c = paths.setdefault((host, segs), [0, 0, 0])
        c[0] += 1
        if i in labels and i not in held:
            c[1] += 1
            c[2] += labels[i]
    tree = plain_templates(paths)
    counts, prior = {}, sum(c[2] for c in paths.values()) / max(1, sum(c[1] for c in paths.values()))
    for (host, segs), c in paths.items():
        t = counts.setdefault((host, tree[host, segs]), [0, 0])
        t[0], t[1] = t[0] + c[1], t[1] + c[2]
    out = {}
    for i, (host, path, segs, told) in own.items():
        template = tree[host, segs]
        m, bad = counts[host, template]
        by_method = "block" if (bad + U.WEIGHT * prior) / (m + U.WEIGHT) >= U.REJECT and (host or path) else "allow"
        out[i] = told or by_method, "/" + "/".join(template)
    return out


def test_host_path_and_rules(spark):
    df = spark.createDataFrame([(k, u, "<p>text") for k, u in enumerate(URLS)] + [(None, URLS[0], None), (3, URLS[3], "x")], SCHEMA)
    df = df.withColumn("host", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("verdict", F.lit("x")).withColumn("bad", F.lit(7)).withColumn("segs", F.lit("x")).withColumn("rest", F.lit("x"))
    got = U.judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, told = plain(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
            assert r["verdict"] == (told or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_tree_equals_plain_recursion(spark):
    draw = random.Random(13)
    rows, labels = [], {}
    for i in range(3000):
        host = draw.choice(["a.io", "a.io", "b.io", "c.example.com"])
        depth = draw.randrange(0, 8)
        segs = [draw.choice(["x", "y", "z", "12", "34.html", "s" + draw.choice("abcdefghijklmnopqrstu"), "*"]) for _ in range(depth)] if draw.random() < 0.7 else ["deep"] * draw.randrange(3, 30) + [draw.choice(["good", "evil"])]
        rows.append((i, f"http://{host}/" + "/".join(segs)))
        if draw.random() < 0.8:
            labels[i] = int(draw.random() < (0.9 if "evil" in segs or "y" in segs[:2] else 0.05))
    pages = spark.createDataFrame([(i, u, None) for i, u in rows], SCHEMA)
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in U.judge(pages, spark.createDataFrame(list(labels.items()), "page_id long, bad int")).collect()}
    assert got == plain_judge(rows, labels)
    assert len({t for _, t in got.values()}) > 30 and {v for v, _ in got.values()} == {"allow", "block"}


def test_templates_judge_pages_beyond_their_labels(spark):
    """A section of a host is bad by the html of four fifths of its pages; the words are in no url."""
    rows = [(k, f"http://shop.example.io/{('deals', 'books', 'toys')[k % 3]}/item{chr(97 + k // 3 % 7)}q", "<p>best casino bonus</p>" if k % 3 == 0 and k % 10 else "<p>plain text</p>") for k in range(900)]
    rows += [(10_000 + k, f"http://shop.example.io/deals/new{k}q", None) for k in range(20)]
    pages = spark.createDataFrame(rows, SCHEMA)
    labels = {r["page_id"]: r["bad"] for r in U.evidence(pages).collect()}
    assert len(labels) == 900 and sum(labels.values()) == 270
    judged = U.judge(pages)
    got = {r["page_id"]: r["verdict"] for r in judged.collect()}
    # All pages of the section go, those with clean html, held-out labels or none among them; no other page does.
    assert {i for i, v in got.items() if v == "block"} == {i for i, u, _ in rows if "/deals/" in u}
    report = {(r["bad"], r["verdict"]): r["pages"] for r in U.held_out_report(judged, U.evidence(pages)).collect()}
    assert report[True, "block"] > 30 and report[False, "allow"] > 80 and (True, "allow") not in report


def test_one_bad_section_of_thirty_is_blocked_and_the_others_are_not(spark):
    rows = [f"http://big.example.io/section{chr(97 + s // 5)}{chr(97 + s % 5)}/p{k}q" for s in range(29) for k in range(100)]
    rows += [f"http://big.example.io/games/p{k}q" for k in range(100)]
    labels = spark.createDataFrame([(k, "games" in u) for k, u in enumerate(rows)], "page_id long, bad boolean")
    got = U.judge(spark.createDataFrame([(k, u, None) for k, u in enumerate(rows)], SCHEMA), labels).collect()
    verdict = {rows[r["page_id"]]: r["verdict"] for r in got}
    assert {v for u, v in verdict.items() if "/games/" in u} == {"block"} and {v for u, v in verdict.items() if "/games/" not in u} == {"allow"}


def test_empty_table_and_no_labels(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.io/x", None)], SCHEMA)
    assert [r["verdict"] for r in U.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()] == ["allow"]


def test_whole_table_equals_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    labels = {r["page_id"]: int(r["bad"]) for r in U.evidence(pages).collect()}
    rows = [(r["page_id"], r["url"]) for r in pages.collect()]
    assert {r["page_id"]: (r["verdict"], r["template"]) for r in U.op3_url_filter(spark, sf).collect()} == plain_judge(rows, labels)


def test_long_paths_take_few_turns(spark, monkeypatch):
    """A url of 2,000 variable segments, and a family of urls that go on and on, end within ten turns."""
    turns = []
    step = U._down_the_chain
    monkeypatch.setattr(U, "_down_the_chain", lambda *a: turns.append(1) or step(*a))
    paths = {("a.io", tuple("*" for _ in range(2000))): [1, 0, 0], ("a.io", ("y", "z")): [2, 1, 1], ("a.io", ()): [1, 0, 0]}
    paths |= {("b.io", ("x",) * k): [1, k % 2, 0] for k in range(1, 400, 3)} | {("b.io", ("x",) * 50 + ("q", "*", "r")): [1, 1, 1], ("b.io", ("x",) * 50 + ("q", "*")): [1, 1, 0]}
    rows = [(k, host, list(segs), *c) for k, ((host, segs), c) in enumerate(paths.items())]
    got = {r["pid"]: tuple(r["template"]) for r in U.templates(spark.createDataFrame(rows, "pid long, host string, rest array<string>, n int, m int, bad int")).collect()}
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000)
    try:
        tree = plain_templates(paths)
    finally:
        sys.setrecursionlimit(limit)
    assert {(host, tuple(segs)): got[k] for k, host, segs, *_ in rows} == tree
    assert len(turns) <= 10


def test_copies_of_ruled_pages_are_labelled(spark):
    """What a rule says about a page holds for equal html elsewhere, whatever its words; blocked and allowed in equal number are bad."""
    rows = [(1, "http://a.net/x", "<p>calm"), (2, "http://b.io/1", "<p>calm"), (3, "http://c.org/fr/1", "<p>casino"), (4, "http://b.io/2", "<p>casino"), (5, "http://b.io/3", "<p>casino games"), (6, "http://b.io/4", "<p>other")]
    rows += [(7, "http://d.net/", "<p>both"), (8, "http://d.org/fr/", "<p>both"), (9, "http://d.io/", "<p>both"), (10, "http://e.io", ""), (11, "http://e.io", None)]
    got = {r["page_id"]: r["bad"] for r in U.evidence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: False, 9: True}
