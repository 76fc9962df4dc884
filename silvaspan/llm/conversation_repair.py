"""Conversations repaired at least cost by weighted interval parsing.

A sound conversation has role initials ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant (3), Delete (4; a must for
blank and repeated rows), Insert an empty user or assistant row anywhere (3); a truncated row that stays adds 3. Of the
cheapest edits those whose initials, in order, are ASCII-least are taken.

*Grammar.* The symbols are pairs (p, q) of the places that a sound conversation passes: nothing yet, after the system row, after a user
row, after an assistant row. (p, q) derives the spans of rows that edits turn into what leads from p to q; its rules are in Chomsky
normal form: (p, q) -> (p, r) (r, q), and (p, q) -> one edited row, closed under insertions on both sides. A span's cell holds
for every symbol the least (cost, audit). Cells are combined bottom-up by span length, a span from its two halves: as the
places between are part of the symbols, another split gives the same cell. Audits of equal cost are never prefixes of each other
on the same rows (one would have more insertions), so least parts make least wholes.

*Spark.* Rows get their order by a range shuffle and a sort, and a number that follows it. Spans of ``SPAN`` numbers are parsed each in one
row; conversations of several spans go on by ``FAN`` spans a round, so one conversation of any length is many tasks until its
last round. The audit is then dealt back to the rows by their numbers. The digest of a conversation is read from sorted rows line by
line: its memory doesn't grow with the conversation.

Order: by turn, nulls first; rows of one turn by ``kind``, the SHA-256 of conversation, role and text. A row is a duplicate if role
and text stood earlier in that order, whatever the earlier row's own fault.

Defined results: null roles and texts are one space, and so are null ids and turns in the text that chooses the damage; a null
conv_id is a conversation; a row of an empty role fits nowhere as it is; repeated rows are duplicates of the first; conversations without rows have zeros, an empty audit and
the hash of the empty text; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from silvaspan.llm.skew import spread_join
from silvaspan.llm.words import BLANK
from silvaspan.scratch import Scratch
from silvaspan.sources.tables import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Row numbers of a span that is parsed at once, and spans of a conversation that one round combines.
SPAN, FAN = 1 << 10, 1 << 5
#: Places in a sound conversation, and which role leads from where to where.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
SOUND, FAULTS = (START, ASSISTANT), ("", "truncated", "duplicate", "blank")
ROLES = {"u": "user", "a": "assistant"}
#: The least roles that can be inserted on the way from one place to another.
INSERTS = {(p, p): "" for p in range(4)} | {(START, USER): "u", (START, ASSISTANT): "ua", (SYSTEM, USER): "u", (SYSTEM, ASSISTANT): "ua", (USER, ASSISTANT): "a", (ASSISTANT, USER): "u"}
SYMBOLS = sorted({*INSERTS, (START, SYSTEM)})
#: The cost of what a symbol can't derive: only a kept system row leads past it.
NEVER = 1 << 50
_AT = {s: k for k, s in enumerate(SYMBOLS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in SYMBOLS]
Cell = tuple[list[int], list[str]]


@cache
def row_cell(initial: str, fault: int) -> Cell:
    """The cell of one row: its edits, closed under insertions before and after."""
    edits: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for p in range(4):
        edits.setdefault((p, p), []).append((DELETE, "D"))
        if fault < 2:
            more = TRUNCATED if fault else 0
            for role in "sua":
                if (q := STEPS.get((p, role))) is not None:
                    own = [(KEEP + more, "K")] if role == initial else []
                    edits.setdefault((p, q), []).extend(own + ([(REROLE + more, "R")] if role in ROLES else []))
    costs, audits = [], []
    for p, q in SYMBOLS:
        every = [(c + INSERT * (len(a) + len(z)), "I" * len(a) + e + "I" * len(z)) for (x, y), some in edits.items() if (a := INSERTS.get((p, x))) is not None and (z := INSERTS.get((y, q))) is not None for c, e in some]
        cost, audit = min(every, default=(NEVER, ""))
        costs.append(cost)
        audits.append(audit)
    return costs, audits


def joined(x: Cell, y: Cell) -> Cell:
    """The cell of two neighbouring spans together."""
    costs, audits = [], []
    for rules in RULES:
        sums = [x[0][i] + y[0][j] for i, j in rules]
        least = min(NEVER, *sums)
        costs.append(least)
        audits.append(min(x[1][i] + y[1][j] for (i, j), c in zip(rules, sums) if c == least) if least < NEVER else "")
    return costs, audits


def parsed(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, bottom-up: all pairs of halves, then pairs of those."""
    while len(cells) > 1:
        cells = [joined(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the CRC-32 of each row's conversation and turn chooses."""
    blank = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    chosen = F.crc32(F.encode(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)), "UTF-8")) % 20
    rows = rows.withColumn("_k", chosen).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_k", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k")


def kind_of(conv: str, role: str, text: str) -> Column:
    """What rows of one conversation with equal role and text share."""
    mark = F.coalesce(F.concat(F.lit("1"), F.col(conv).cast("string")), F.lit("0"))
    return F.sha2(F.concat(mark, F.lit(":"), F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256)


def ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with ``kind`` and ``at``, a number that follows conversation, turn and kind."""
    rows = rows.withColumn("kind", kind_of("conv_id", "role", "text")).withColumn("_n", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "kind", "_n"]  # the last parts equal rows, whose order doesn't matter
    return scratch.save(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_n").withColumn("at", F.monotonically_increasing_id()), "ordered")


def faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, at, turn, initial, fault) for rows with kind and at; fault: the number of the first in FAULTS, by falling weight."""
    text = F.trim("text", F.lit(BLANK))
    own = F.when(text == "", 3).when(~F.right(text, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    slim = scratch.save(rows.select("conv_id", "at", "turn", "kind", F.left("role", F.lit(1)).alias("initial"), own.alias("own")), "slim")
    firsts = slim.groupBy("kind").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = spread_join(slim, scratch.save(firsts, "firsts"), "kind", "n", slim.count(), "left")
    fault = F.when((F.col("own") < 3) & (F.col("at") > F.col("first")), 2).otherwise(F.col("own"))
    return found.select("conv_id", "at", "turn", "initial", fault.cast("int").alias("fault"))


_PART = "n long, first_initial string, last_initial string, illegal long, blank long, duplicate long, truncated long, first_turn long, last_turn long, turns long, costs array<long>, audits array<string>, runs array<struct<at: long, n: long>>"
_LEGAL = {"su", "ua", "au"}


def _part_of_rows(rows: list[dict]) -> dict:
    """What a span of consecutive rows hands on."""
    initials, turns = [r["initial"] for r in rows], [r["turn"] for r in rows if r["turn"] is not None]
    costs, audits = parsed([row_cell(r["initial"], r["fault"]) for r in rows])
    count = lambda k: sum(r["fault"] == k for r in rows)
    return {
        "n": len(rows), "first_initial": initials[0], "last_initial": initials[-1], "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        "blank": count(3), "duplicate": count(2), "truncated": count(1), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
        "costs": costs, "audits": audits, "runs": [{"at": rows[0]["at"], "n": len(rows)}],
    }


def _part_of_parts(parts: list[dict]) -> dict:
    """What neighbouring spans hand on together."""
    with_turns = [p for p in parts if p["turns"]]
    costs, audits = parsed([(p["costs"], p["audits"]) for p in parts])
    total = lambda c: sum(p[c] for p in parts)
    return {
        "n": total("n"), "first_initial": parts[0]["first_initial"], "last_initial": parts[-1]["last_initial"], "illegal": total("illegal") + sum(a["last_initial"] + b["first_initial"] not in _LEGAL for a, b in zip(parts, parts[1:])),
        "blank": total("blank"), "duplicate": total("duplicate"), "truncated": total("truncated"), "first_turn": with_turns[0]["first_turn"] if with_turns else None, "last_turn": with_turns[-1]["last_turn"] if with_turns else None,
        "turns": total("turns") - sum(a["last_turn"] == b["first_turn"] for a, b in zip(with_turns, with_turns[1:])), "costs": costs, "audits": audits, "runs": [r for p in parts for r in p["runs"]],
    }


def _mapped(grouped: DataFrame, f, conv: T.StructField) -> DataFrame:
    """(conv_id, k, part) for rows (conv_id, k, list)."""
    schema = T.StructType([conv, T.StructField("k", T.LongType()), *T._parse_datatype_string(_PART).fields])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [f(rows) for rows in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array([x[c.name] for x in found], c.type) for c in list(arrow)[2:])], schema=arrow.set(0, pa.field("conv_id", piece.schema.types[0])))

    return grouped.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def cells(rows: DataFrame, scratch: Scratch, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """One row per conversation of rows (conv_id, at, turn, initial, fault): counts, cost, audit and the runs of its row numbers."""
    conv = rows.schema["conv_id"]
    entry = F.struct("at", F.col("turn").cast("long").alias("turn"), "initial", "fault")
    spans = rows.groupBy("conv_id", F.expr(f"at div {span}").alias("k")).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    parts = scratch.save(_mapped(spans, _part_of_rows, conv), "spans")
    while True:
        # Spans of one conversation stand in the order of k; all but the longest conversations have one or two.
        several = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("low")).where("m > 1")
        if not several.limit(1).count():
            break
        numbered = _numbered(parts, scratch)
        names = [f.name for f in T._parse_datatype_string(_PART).fields]
        met = numbered.groupBy("conv_id", F.expr(f"k div {fan}").alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", *names))).alias("rows"))
        new = scratch.save(_mapped(met, _part_of_parts, conv), "parts")
        scratch.drop(parts)
        parts = new
    cost, audit = (lambda s: F.get("costs", F.lit(_AT[START, s]))), (lambda s: F.get("audits", F.lit(_AT[START, s])))
    best = F.least(*(F.struct(cost(s).alias("cost"), audit(s).alias("audit")) for s in SOUND))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return parts.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.alias("best"), "runs").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "runs")


def _numbered(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """parts with k counted from 0 in each conversation: a window over spans, of which a conversation of a thousand million rows has a million."""
    from pyspark.sql import Window as W

    order = parts.select("conv_id", "k").withColumn("to", (F.row_number().over(W.partitionBy("conv_id").orderBy("k")) - 1).cast("long"))
    order = order.select(F.col("conv_id").alias("c"), F.col("k").alias("old"), "to")
    return parts.join(order, parts["conv_id"].eqNullSafe(order["c"]) & (parts["k"] == order["old"])).drop("c", "old", "k").withColumnRenamed("to", "k")


def edits(found: DataFrame) -> DataFrame:
    """(at, edit, role, before, after): each row's edit, its new role if that changes, and the roles inserted before it and, at the end, after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for audit, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = (r["at"] + k for r in runs for k in range(r["n"]))
                # A sound conversation alternates from its first user row on; only the first row left can be a system row, and only as it was.
                left = audit.replace("D", "")
                turn = 1 if len(left) % 2 else 0  # an odd number of rows has a system row ahead
                role = lambda k: "ua"[(k - turn) % 2]
                at, before, placed = None, [], 0
                for letter in audit:
                    if letter == "I":
                        before.append(ROLES[role(placed)])
                    else:
                        at = next(numbers)
                        out.append((at, letter, ROLES[role(placed)] if letter == "R" else None, before, []))
                        before = []
                    placed += letter != "D"
                    if len(out) >= 1 << 15 and not before:
                        last = out.pop()  # it may yet get what stands behind it
                        yield _edit_rows(out)
                        out = [last]
                if before:
                    out[-1][4].extend(before)
            if out:
                yield _edit_rows(out)

    return found.select("audit", "runs").mapInArrow(run, "at long, edit string, role string, before array<string>, after array<string>")


def _edit_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["at", "edit", "role", "before", "after"])


def repaired_rows(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(conv_id, at, place, edit, role, text): the rows of the repaired conversations, in the order of (at, place)."""
    new = lambda roles: F.transform(roles, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct("edit", F.coalesce("new_role", "role").alias("role"), "text"))
    every = F.concat(new("before"), F.when(F.col("edit") == "D", F.slice(own, 1, 0)).otherwise(own), new("after"))
    met = rows.select("conv_id", "at", "role", "text").join(changes.withColumnRenamed("role", "new_role"), "at")
    return met.select("conv_id", "at", F.posexplode(every).alias("place", "x")).select("conv_id", "at", "place", "x.edit", "x.role", "x.text")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations with rows, read line by line in order."""
    lines = repaired.select("conv_id", "at", "place", F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place").select("conv_id", "line")
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.types[0], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done])], schema.names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], schema.names)

    return lines.mapInArrow(run, schema)


def repair(rows: DataFrame, span: int = SPAN, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(found, repaired) of rows (conv_id, turn, role, text) without null roles and texts: what ``cells`` returns, and the repaired rows."""
    scratch = Scratch(rows.sparkSession, "repair")
    rows = ordered(rows.select("conv_id", "turn", "role", "text"), scratch)
    found = scratch.save(cells(faults(rows, scratch), scratch, span, fan), "found")
    return found, scratch.save(repaired_rows(rows, edits(found)), "repaired")


def repaired_conversations(conversations: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """Per original conv_id the counts, cost, audit and digest of its repair after the damage."""
    found, repaired = repair(damaged(conversations), span, fan)
    ids, hashed = conversations.select(F.col("conv_id").alias("_id")).distinct(), digests(repaired).withColumnRenamed("conv_id", "_c")
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(hashed, F.col("_id").eqNullSafe(F.col("_c")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage and repair."""
    return repaired_conversations(table(spark, sf_dir, "conversations"))


ORACLE = r"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS r(n))),
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
    chosen AS (SELECT named.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, CAST(i AS BIGINT), 1)) AS BIGINT))), lambda c, b: xor(c // 256, tab[CAST(xor(c, b) % 256 + 1 AS BIGINT)])), 4294967295) % 20 AS k FROM named, tab),
    damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM chosen, range(2) AS again(j) WHERE k <> 0 AND (j = 0 OR k = 3)),
    kinds AS (SELECT *, sha256(coalesce('1' || CAST(conv_id AS VARCHAR), '0') || ':' || length(role) || ':' || role || text) AS kind, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
    placed AS (SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w AS above FROM kinds WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, kind)),
    o AS (SELECT conv_id, turn, role, text, i, initial, above, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
    st AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE i > 1 AND above || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id),
    moves(p, init, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    ins(p, q, a, added) AS (SELECT p, p, '', CAST([] AS VARCHAR[]) FROM (VALUES (0), (1), (2), (3)) AS z(p) UNION ALL VALUES (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:'])),
    ed AS (SELECT p, 'D' AS e, p AS q, CAST(NULL AS VARCHAR) AS init FROM (VALUES (0), (1), (2), (3)) AS z(p) UNION ALL SELECT p, 'K', q, init FROM moves UNION ALL SELECT p, 'R', q, init FROM moves WHERE init <> 's'),
    v AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS rows FROM st
        UNION ALL SELECT conv_id, i, q, CAST(min(cost) AS BIGINT), arg_min(audit, (cost, audit)), arg_min(rows, (cost, audit)) FROM (SELECT v.conv_id, o.i, ed.q, v.cost + 3 * length(ins.a) + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, v.audit || ins.a || e AS audit,
            list_concat(v.rows, list_concat(ins.added, CASE e WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [role || ':' || text] ELSE [CASE init WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text] END)) AS rows
            FROM v JOIN o ON o.conv_id IS NOT DISTINCT FROM v.conv_id AND o.i = v.i + 1 JOIN ins ON ins.p = v.q JOIN ed ON ed.p = ins.q WHERE e = 'D' OR (fault IN ('none', 'truncated') AND (e = 'R' OR init = initial))) GROUP BY conv_id, i, q),
    best AS (SELECT v.conv_id, min(v.cost + 3 * length(ins.a)) AS cost, arg_min(v.audit || ins.a, (v.cost + 3 * length(ins.a), v.audit || ins.a)) AS audit, arg_min(list_concat(v.rows, ins.added), (v.cost + 3 * length(ins.a), v.audit || ins.a)) AS rows FROM v JOIN st ON st.conv_id IS NOT DISTINCT FROM v.conv_id AND st.n = v.i JOIN ins ON ins.p = v.q WHERE ins.q IN (0, 3) GROUP BY v.conv_id)
    SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rows, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS ids LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id"""
