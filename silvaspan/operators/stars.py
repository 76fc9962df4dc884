"""Crossings of segments that share ends: two stars cross as often as one order of their points is turned in the other.

Segments from one place never cross. Of two places A and B, the segment from A to p and the one from B to q cross if p and q lie on the same
side of the line AB, q is seen from A at a larger angle to AB than p, and from B at a smaller one. So the crossings of two stars are
counted from two orders of their points, in n log n, and are never looked at one by one.

Signs are those of the products of rounded differences that the plain test of two segments has: pairs that rounding decides are found and get that test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A source is the centre of a star from this many segments on, and of a 64th of all: such sources are at most 64.
LEAST, MOST = 256, 64
#: Segments of one star that a task takes: a pair of stars is tasks of two such tiles.
STAR = 1 << 18
#: Angles nearer than this, far above what rounding adds to them, leave the sign to the plain test; and so does a triangle flatter than FLAT.
NEAR, FLAT = 1e-13, 1e-11
#: Pairs that are tested at once.
_CHUNK = 1 << 20


def turned(pa: np.ndarray, pb: np.ndarray, qa: np.ndarray, qb: np.ndarray) -> int:
    """How many pairs have qa > pa and qb < pb: bit by bit of the rank by b, over rows in the order of a."""
    is_q = np.repeat([False, True], [len(pa), len(qa)])
    by_a, by_b = np.lexsort((~is_q, np.concatenate([pa, qa]))), np.lexsort((is_q, np.concatenate([pb, qb])))
    rank = np.empty(len(is_q), np.int64)
    rank[by_b] = np.arange(len(is_q))
    r, q, n = rank[by_a], is_q[by_a], 0
    for bit in reversed(range(len(r).bit_length())):
        # Ranks are all numbers, so those of equal higher bits stand at start, start + 1 and so on, in the order of a.
        one, start = (r >> bit) & 1, r >> (bit + 1) << (bit + 1)
        before = np.concatenate([[0], np.cumsum(one & ~q)])
        n += int(np.sum((before[1:] - before[start])[q & (one == 0)]))
        ones = np.cumsum(one) - one
        place = np.where(one == 1, start + (1 << bit) + ones - ones[start], np.arange(len(r)) - ones + ones[start])
        r[place], q[place] = r.copy(), q.copy()
    return n


def _pairs(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with lo[i] <= j < hi[i], a bounded number at once."""
    k = hi - lo
    ends = np.cumsum(k)
    first = 0
    while first < len(k):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _CHUNK, "right")))
        own = k[first:last]
        i = np.repeat(np.arange(first, last), own)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + lo[i]
        first = last


def star_crossings(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> int:
    """How many segments from a to points p (n, 2) cross segments from b to points q (m, 2)."""
    cross, dot = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0], lambda u, v: u[..., 0] * v[..., 0] + u[..., 1] * v[..., 1]
    # Without an angle to AB nothing crosses; the products are exactly zero in the plain test too.
    p, q = p[cross(p - a, b - a) != 0], q[cross(q - b, a - b) != 0]
    if not len(p) or not len(q):
        return 0

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        u, v = p[i] - a, q[j] - b
        return (cross(u, b - a) * cross(u, q[j] - a) < 0) & (cross(v, a - b) * cross(v, p[i] - b) < 0)

    def seen(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The angles at a and at b, and whether the triangle of a, b and x is flat."""
        u, v, w = x - a, x - b, b - a
        at_a, at_b, apex = np.abs(cross(u, w)), np.abs(cross(v, w)), np.abs(cross(u, v))
        lu, lv, lw = np.hypot(*u.T), np.hypot(*v.T), np.hypot(*w)
        return np.arctan2(at_a, dot(u, w)), np.arctan2(at_b, -dot(v, w)), (at_a <= FLAT * lu * lw) | (at_b <= FLAT * lv * lw) | (apex <= FLAT * lu * lv)

    (pa, pb, pf), (qa, qb, qf) = seen(p), seen(q)
    left_p, left_q = cross(p - a, b - a) < 0, cross(q - b, a - b) > 0
    n = 0
    flat, every = np.flatnonzero(pf), np.arange(len(q))
    for i, j in _pairs(np.zeros(len(flat), np.int64), np.full(len(flat), len(every))):
        n += int(np.count_nonzero(test(flat[i], every[j])))
    flat, every = np.flatnonzero(qf), np.flatnonzero(~pf)
    for i, j in _pairs(np.zeros(len(flat), np.int64), np.full(len(flat), len(every))):
        n += int(np.count_nonzero(test(every[j], flat[i])))
    for left in (False, True):
        ip, iq = np.flatnonzero(~pf & (left_p == left)), np.flatnonzero(~qf & (left_q == left))
        if not len(ip) or not len(iq):
            continue
        n += turned(pa[ip], pb[ip], qa[iq], qb[iq])
        for of_p, of_q, told in ((pa, qa, False), (pb, qb, True)):
            order = iq[np.argsort(of_q[iq])]
            for i, j in _pairs(np.searchsorted(of_q[order], of_p[ip] - NEAR), np.searchsorted(of_q[order], of_p[ip] + NEAR, "right")):
                i, j = ip[i], order[j]
                if told:  # by the angle at a already
                    new = ~((qa[j] >= pa[i] - NEAR) & (qa[j] <= pa[i] + NEAR))
                    i, j = i[new], j[new]
                n += int(np.count_nonzero(test(i, j))) - int(np.count_nonzero((qa[j] > pa[i]) & (qb[j] < pb[i])))
    return n


def centres(segments: DataFrame, n: int) -> DataFrame:
    """(source, n, x, y): the centres of stars among n segments (edge_id, source, target, ax, ay, bx, by)."""
    found = segments.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.first("ax").alias("x"), F.first("ay").alias("y"))
    return found.where(F.col("n") >= max(LEAST, -(-n // MOST)))


def crossings_of_stars(segments: DataFrame, hubs: list) -> DataFrame:
    """(n): crossings of segments of two stars; hubs: the rows of ``centres``, at most MOST."""
    hubs = sorted(hubs, key=lambda r: r["source"])
    tiles = [-(-r["n"] // STAR) for r in hubs]
    owner = [k for k, t in enumerate(tiles) for _ in range(t)]
    places = [np.array([r["x"], r["y"]]) for r in hubs]
    spark = segments.sparkSession
    own = spark.createDataFrame([(r["source"], k, owner.index(k), t) for k, (r, t) in enumerate(zip(hubs, tiles))], f"source {segments.schema['source'].dataType.simpleString()}, hub int, start int, tiles int")
    parts = spark.createDataFrame(list(enumerate(owner)), "other int, other_hub int")
    # As many copies of a segment as there are tiles of other stars.
    rows = segments.select("source", "edge_id", "bx", "by").join(F.broadcast(own), "source").withColumn("part", (F.col("start") + F.pmod(F.xxhash64("edge_id"), "tiles")).cast("int"))
    rows = rows.join(F.broadcast(parts), F.col("hub") != F.col("other_hub"))
    rows = rows.select(F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") < F.col("other")).alias("first"), "bx", "by")
    copies = sum(r["n"] * (len(owner) - t) for r, t in zip(hubs, tiles))
    rows = rows.repartition(min(4096, copies // STAR + 1), "lo", "hi")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        at, first = pdf[["bx", "by"]].to_numpy(), pdf["first"].to_numpy()
        return pd.DataFrame({"n": [star_crossings(places[owner[pdf["lo"].iloc[0]]], places[owner[pdf["hi"].iloc[0]]], at[first], at[~first])]})

    return rows.groupBy("lo", "hi").applyInPandas(count, "n long")
