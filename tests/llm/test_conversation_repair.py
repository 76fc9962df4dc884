import hashlib
import itertools
import random
import re
import zlib

import pytest

from silvaspan.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost int, kind string"
SPACE = " \t\n\v\f\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) over all edits with at most two insertions at a place."""
    found, inserts = faults_of(rows), ["", "u", "a", "ua", "au"]
    best = None
    for edits in itertools.product("KuaD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(found, edits)):
            continue
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost, lines = "", "", 0, []
            for k, extra in enumerate(more):
                for x in extra:
                    roles, audit, cost = roles + x, audit + "I", cost + 3
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if k < len(rows):
                    e, (role, text) = edits[k], rows[k]
                    audit += e if e in "KD" else "R"
                    cost += {"K": 0, "D": 4}.get(e, 3) + (3 if e != "D" and found[k] == "truncated" else 0)
                    if e != "D":
                        roles += (role[:1] or "?") if e == "K" else e
                        lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[e]}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def by_prefixes(rows):
    """The same by the best way to every place after every prefix."""
    found, now = faults_of(rows), {0: (0, "", [])}
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    inserts = {0: [(0, ""), (2, "u"), (3, "ua")], 1: [(1, ""), (2, "u"), (3, "ua")], 2: [(2, ""), (3, "a")], 3: [(3, ""), (2, "u")]}
    name = {"u": "user", "a": "assistant"}
    for k in range(len(rows) + 1):
        wide = {}
        for p, (cost, audit, lines) in now.items():
            for q, x in inserts[p]:
                new = cost + 3 * len(x), audit + "I" * len(x), lines + [f"{name[c]}:" for c in x]
                wide[q] = min(wide.get(q, new), new, key=lambda y: y[:2])
        if k == len(rows):
            return min((wide[q] for q in (0, 3) if q in wide), key=lambda y: y[:2])
        role, text = rows[k]
        now = {}
        for p, (cost, audit, lines) in wide.items():
            new = [(p, (cost + 4, audit + "D", lines))]
            if found[k] in ("", "truncated"):
                more = 3 if found[k] else 0
                for c in "sua":
                    if (q := steps.get((p, c))) is not None:
                        if c == role[:1]:
                            new.append((q, (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                        if c != "s":
                            new.append((q, (cost + 3 + more, audit + "R", [*lines, f"{name[c]}:{text}"])))
            for q, x in new:
                now[q] = min(now.get(q, x), x, key=lambda y: y[:2])


def ordered(rows):
    """Rows (conv, turn, role, text) in the operator's order."""
    def kind(c, role, text):
        return hashlib.sha256(f"{'0' if c is None else f'1{c}'}:{len(role)}:{role}{text}".encode()).hexdigest()

    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, kind(r[0], r[2], r[3])))


def damage(rows):
    out = []
    for c, t, role, text, *_ in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows, damaged=None):
    damaged = damage(rows) if damaged is None else damaged
    out = []
    for c in {r[0] for r in rows}:
        own = ordered([r for r in damaged if r[0] == c])
        pairs = [r[2:] for r in own]
        found = faults_of(pairs)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = by_prefixes(pairs)
        out.append((c, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def conversations(n, seed, longest=9):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ultra"])
            text = rng.choice(["yes.", "no", "\t \n", "", None, "Why?", f"text {rng.random()}.", f"cut {rng.random()}", "über!"])
            out.append((c if c else None, rng.choice([t, t, t + 2, None]), role, text, 1, "k"))
    return out


def test_parsing_against_all_edits():
    rng = random.Random(8)
    texts, roles = ["yes.", "no", " ", "", "Why?"], ["user", "assistant", "system", "tool", ""]
    for n, times in ((0, 1), (1, 40), (2, 60), (3, 12)):
        for _ in range(times):
            rows = [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]
            want = cheapest(rows)
            assert by_prefixes(rows) == want
            if rows:
                costs, audits = cr.parsed([cr.row_cell(role[:1], cr.FAULTS.index(f)) for (role, _), f in zip(rows, faults_of(rows))])
                assert min((costs[cr._AT[0, q]], audits[cr._AT[0, q]]) for q in cr.SOUND) == want[:2]


def test_splits_do_not_matter():
    rng = random.Random(2)
    for _ in range(30):
        leaves = [cr.row_cell(rng.choice("suat"), rng.randrange(4)) for _ in range(rng.randint(2, 12))]
        left = leaves[0]
        for x in leaves[1:]:
            left = cr.joined(left, x)
        assert cr.parsed(leaves) == left


def test_damage_and_repair(spark):
    rows = conversations(120, 3)
    rows += rows[5:9] + [(900, t, "user", "a.", 1, "k") for t in range(60)] + [(901, None, None, None, 1, "k")]
    # Rows of one turn with equal role and text under other damage can't differ: the damage goes by conversation and turn.
    assert got(cr.repaired_conversations(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(rows)


def test_long_conversation_in_spans(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"row {t}{rng.choice(['.', '', '!'])}", 1, "k") for t in range(700)] + conversations(30, 6)
    want = plain(rows)
    assert got(cr.repaired_conversations(spark.createDataFrame(rows, SCHEMA), span=16, fan=3)) == want
    found, repaired = cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA)), span=8, fan=2)
    assert found.count() <= 31
    ids = [r["role"][0] for r in repaired.where("conv_id = 1").orderBy("at", "place").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(ids))


def test_edges(spark):
    assert cr.repaired_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    # A conversation that loses all its rows stays.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x", 1, "k")]
    assert got(cr.repaired_conversations(spark.createDataFrame(rows, SCHEMA))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())] == plain(rows)
    long = [(5, 1, "user", "word " * 200_000 + ".", 1, "k"), (5, 2, "assistant", "fine.", 1, "k")]
    assert got(cr.repaired_conversations(spark.createDataFrame(long, SCHEMA))) == plain(long)


@pytest.mark.parametrize("extra", [False, True])
def test_sql(spark, extra):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    if extra:
        rows = conversations(40, 12)
        data = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "cost", "kind"]).astype({"conv_id": "Int64", "turn": "Int64"})
        con.register("conversations", data)
        df = cr.repaired_conversations(spark.createDataFrame(rows, SCHEMA))
    else:
        sf = "/root/testdata/sf0.001"
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        df = cr.op11_conversation_repair(spark, sf)
    rel = con.sql(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({cr.ORACLE})")
    assert got(df) == sorted(rel.fetchall(), key=str)
