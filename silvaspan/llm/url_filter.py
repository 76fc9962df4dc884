"""URL filters by a path-template tree per host.

A url is decided by the longest rule that fits; all others by the method. Some pages are labelled good or
bad. Each host's paths form a tree of segments, with the labelled and the bad pages below each node.
From the top down, segments that are variable (digits, long hexadecimal names) become a wildcard; so do,
under a node with more than ``FAN`` children, those with a small share of its pages, and under any node
those with labels, if their bad rate does not differ from the node's by more than ``Z`` standard errors:
statistically similar branches are merged and go on as one. The path that is left is a template; its purity is
(bad + WEIGHT * rate of all labelled pages) / (labelled + WEIGHT), and a template of purity of at least
``REJECT`` is rejected with all its pages, labelled or not.

Labels are a table (page_id, bad). By default they come from evidence outside the url's own words: what a
rule blocks is bad and what a rule allows is good, and so are copies of its html elsewhere; else a page is bad if its html holds a word of
``SEEDS`` as a word, and good if it has html without one. Pages whose crc32(page_id) mod 5 is 1 are held
out: their labels never enter the tree, and ``held_out_report`` tells how the templates judge them.

The tree is built over distinct paths, counted before any shuffle. Each turn decides one branching of
every node and passes what follows up to the next one, variable segments too: the number of turns is the
number of nodes on a path below which paths part, not its depth, and there is no bound on the depth. Counts per node are
sums, never lists, and a node that holds a large part of all paths is joined by a bounded broadcast.

Defined results: a null url, or one without ``://``, has empty host and path and is allowed; null ids are
kept, and are never labelled; repeated rows count as pages each; several labels of one id count as bad if any
is; an empty table gives no rows; without any label nothing is rejected; extra columns are not read.
Paths are told apart by 64-bit hashes of host and segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from silvaspan.llm.skew import spread_join
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

#: The rules of the contract, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SEEDS = ("adult", "bets", "casino", "pills", "porn", "spam", "viagra", "xxx")
FAN = 12
SHARE = 0.05
Z = 2.0
WEIGHT = 2.0
REJECT = 0.5
FOLDS = 5
ANY = "*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host, path), and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def segments() -> Column:
    """The path's segments, variable ones as wildcards."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$|^[0-9A-Fa-f-]{8,}$") & s.rlike("[0-9]"), F.lit(ANY)).otherwise(s))


def held_out(page_id: str = "page_id") -> Column:
    return F.coalesce(F.crc32(F.col(page_id).cast("string").cast("binary")) % FOLDS == 1, F.lit(False))


def evidence(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """(page_id, bad) of the pages (page_id, url, html) that a rule, equal html elsewhere or their html's words tell about.

    What rules say about most pages of one html, blocked ones if equal in number, holds for its copies at other urls too.
    """
    scratch = Scratch(pages.sparkSession, "evidence")
    told, html = rule_of(rules)[1], F.col("html")
    rows = pages.where("page_id is not null").select("page_id", host_of().alias("host"), path_of().alias("path"), "html")
    says = html.rlike(r"(?i)(?<![a-z])(?:" + "|".join(seeds) + r")(?![a-z])")
    sha = F.when(F.length("html") > 0, F.sha1(F.encode("html", "UTF-8")))
    rows = scratch.save(rows.select("page_id", told.alias("told"), sha.alias("sha"), F.when(F.length("html") > 0, says).alias("says")), "rows")
    ruled = F.when(F.col("told") == "block", 1).when(F.col("told") == "allow", -1)
    copies = rows.where("sha is not null").groupBy("sha").agg(F.sum(ruled).alias("sum"), F.count(ruled).alias("ruled"), F.count(F.lit(1)).alias("n")).where("ruled > 0 and ruled < n")
    copies = scratch.save(copies.select("sha", (F.col("sum") >= 0).alias("as_copy"), "n"), "copies")
    found = spread_join(rows, copies, "sha", "n", rows.count(), "left")
    bad = F.coalesce(F.col("told") == "block", F.col("as_copy"), F.col("says"))
    return found.select("page_id", bad.alias("bad")).where("bad is not null")


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y)
    at = F.array_position(differ, True)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def _down_the_chain(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (pid, host, rest, template, n, m, bad, at) moved on from each node ``at`` as far as it has no branching.

    Below a node stands a chain as long as every path is a beginning of the node's last path, in the order of segments, or leaves it later: a path that is alone,
    and a family of paths that go on and on, end in one step.
    """
    total = rows.count()
    last = rows.groupBy("at").agg(F.max("rest").alias("last"), F.count(F.lit(1)).alias("rows"))
    met = scratch.save(spread_join(rows, scratch.save(last, "last"), "at", "rows", total).withColumn("common", _shared(F.col("rest"), F.col("last"))), "met")
    # Only a path that leaves the chain, not one that ends on it, stops the others.
    leaves = F.when(F.col("common") < F.size("rest"), F.col("common")).otherwise(F.size("last"))
    free = met.groupBy("at").agg(F.min(leaves).alias("skip"), F.count(F.lit(1)).alias("rows"))
    out = spread_join(met.drop("rows"), scratch.save(free, "free"), "at", "rows", total)
    return out.select("pid", "host", F.expr("slice(rest, 1 + skip, size(rest))").alias("rest"), F.concat("template", F.expr("slice(rest, 1, skip)")).alias("template"), "n", "m", "bad")


def templates(paths: DataFrame) -> DataFrame:
    """(pid, host, template, n, m, bad) for every row of paths (pid, host, rest, n, m, bad).

    rest: the path's segments; n, m, bad: its pages, labelled pages and bad pages.
    """
    scratch = Scratch(paths.sparkSession, "templates")
    now = scratch.save(paths.select("pid", "host", "rest", F.array().cast("array<string>").alias("template"), "n", "m", "bad"), "paths")
    done, turn = [], 0
    while True:
        done.append(now.where(F.size("rest") == 0).select("pid", "host", "template", "n", "m", "bad"))
        here = now.where(F.size("rest") > 0).withColumn("key", F.xxhash64("host", "template", F.get("rest", F.lit(0))))
        total = here.count()
        if not total:
            break
        child = here.groupBy("key", "host", "template", F.get("rest", F.lit(0)).alias("seg")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("rows"))
        child = scratch.save(child, f"children{turn}")
        node = child.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("fan"))
        rate = F.coalesce(F.try_divide("all_bad", "all_m"), F.lit(0.0))
        alike = (F.col("fan") > 1) & (F.col("m") > 0) & (F.abs(F.try_divide("bad", "m") - rate) <= Z * F.sqrt(rate * (1 - rate) / F.col("m")))
        rare = (F.col("fan") > FAN) & (F.col("n") < SHARE * F.col("all_n"))
        # A rare segment's rate is drawn to the node's by WEIGHT pages first; without labels it is the node's.
        near = F.abs((F.col("bad") + WEIGHT * rate) / (F.col("m") + WEIGHT) - rate) <= Z * F.sqrt(rate * (1 - rate) / (F.col("m") + WEIGHT))
        to = F.when(alike | (rare & near), F.lit(ANY)).otherwise(F.col("seg"))
        named = child.join(node, ["host", "template"]).select("key", "rows", to.alias("to"))
        step = spread_join(here, scratch.save(named, f"named{turn}"), "key", "rows", total)
        step = step.select("pid", "host", F.expr("slice(rest, 2, size(rest))").alias("rest"), F.concat("template", F.array("to")).alias("template"), "n", "m", "bad", F.xxhash64("host", F.concat("template", F.array("to"))).alias("at"))
        now, turn = scratch.save(_down_the_chain(scratch.save(step, f"step{turn}"), scratch), f"turn{turn}"), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages (page_id, url; html too where no labels (page_id, bad) are given)."""
    scratch = Scratch(pages.sparkSession, "urls")
    labels = evidence(pages, rules) if labels is None else labels.where("page_id is not null")
    labels = scratch.save(labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")), "labels")
    rule, told = rule_of(rules)
    rows = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    rows = rows.select("*", rule.alias("rule"), told.alias("told"), segments().alias("rest"), F.when(~held_out(), F.col("page_id")).alias("asked"))
    rows = rows.withColumn("pid", F.xxhash64("host", "rest"))
    rows = scratch.save(rows.join(labels.withColumnRenamed("page_id", "asked"), "asked", "left").drop("asked"), "rows")
    paths = rows.groupBy("pid", "host", "rest").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = scratch.save(templates(paths), "tree")
    prior, total = tree.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("m")), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = tree.groupBy("host", "template").agg(F.sum("m").alias("m"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("paths"))
    counts = counts.select(F.xxhash64("host", "template").alias("key"), "paths", ((F.col("bad") + WEIGHT * prior) / (F.col("m") + WEIGHT)).alias("purity"))
    keyed = tree.select("pid", "n", "template", F.xxhash64("host", "template").alias("key"))
    judged = scratch.save(spread_join(keyed, counts, "key", "paths", tree.count()).select("pid", "n", "template", "purity"), "judged")
    found = spread_join(rows.select("page_id", "host", "path", "rule", "told", "pid"), judged, "pid", "n", total)
    no_url = (F.col("host") == "") & (F.col("path") == "")
    by_method = F.when((F.col("purity") >= REJECT) & ~no_url, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("told", by_method).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity",
    )


def held_out_report(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(bad, verdict, pages): how pages without a rule, whose labels were held out of the tree, are judged."""
    rows = judged.where(held_out() & F.col("rule").isNull()).join(labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")), "page_id")
    return rows.groupBy((F.col("bad") == 1).alias("bad"), "verdict").agg(F.count(F.lit(1)).alias("pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of all pages."""
    return judge(table(spark, sf_dir, "pages"))
