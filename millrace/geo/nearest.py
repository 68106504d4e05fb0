"""Nearest positions: a balanced tree of boxes over unit vectors, descended for blocks of positions at once.

Chords grow with distances on the sphere, and boxes of vectors know no poles and no date line. A search keeps whatever may be
nearest by the bounds of boxes and, at the end, all positions within ``SLACK`` of the least chord: the caller computes their
distances and settles ties.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: chords (6 mm on the Earth) that count as equal here; more than the rounding of vectors and of 1e-6 km.
SLACK = 1e-9
#: Fixed: positions in a leaf, positions searched at once, and box pairs or points looked at together.
LEAF, BLOCK, WIDEST = 16, 4096, 1 << 20
#: Positions on the right in a region, and on the left in a group that searches one.
REGION, GROUP = 250_000, 100_000
#: Positions that the regions' borders are drawn from, for each region.
DRAWN = 256


def unit(lat, lon) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], 1)


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest chord from each vector to its box."""
    least = np.maximum(np.maximum(lo - q, q - hi), 0)
    most = np.maximum(np.abs(q - lo), np.abs(q - hi))
    return np.sqrt((least * least).sum(-1)), np.sqrt((most * most).sum(-1))


class Tree:
    """Halves of halves of the vectors along the widest side, with the box of each."""

    def __init__(self, p: np.ndarray, leaf: int = LEAF):
        n = len(p)
        self.p, self.at, self.boxes, self.cuts = p, np.arange(n), [], []
        depth = max(0, math.ceil(math.log2(n / leaf)))
        for k in range(depth + 1):
            edges = (np.arange((1 << k) + 1) * n) >> k
            x = p[self.at]
            lo, hi = np.minimum.reduceat(x, edges[:-1]), np.maximum.reduceat(x, edges[:-1])
            self.boxes.append((lo, hi))
            if k < depth:
                part = np.repeat(np.arange(1 << k), np.diff(edges))
                side = (hi - lo).argmax(1)
                self.at = self.at[np.lexsort((x[np.arange(n), side[part]], part))]
                middle = ((2 * np.arange(1 << k) + 1) * n) >> (k + 1)
                self.cuts.append((side, p[self.at[middle], side]))
        self.edges = edges

    def leaf_of(self, q: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all cuts each vector lies."""
        node = np.zeros(len(q), np.int64)
        for side, cut in self.cuts:
            node = 2 * node + (q[np.arange(len(q)), side[node]] >= cut[node])
        return node

    def search(self, q: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, row of p) for the nearest vectors within ``limit``, and those as near up to SLACK."""
        found, waiting = [], [np.arange(i, min(i + BLOCK, len(q))) for i in range(0, len(q), BLOCK)]
        while waiting:
            block = waiting.pop()
            pairs = self._search(q[block], limit, len(block) > 1)
            if pairs is None:  # too wide at once
                waiting += [block[: len(block) // 2], block[len(block) // 2 :]]
            else:
                found.append((block[pairs[0]], pairs[1]))
        none = np.zeros(0, np.int64)
        return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (none, none)

    def _search(self, q: np.ndarray, limit: float, bounded: bool) -> tuple[np.ndarray, np.ndarray] | None:
        leaf = self.leaf_of(q)
        some = np.minimum(self.edges[:-1][leaf] + np.arange(int(np.diff(self.edges).max()))[:, None], self.edges[1:][leaf] - 1)
        best = np.full(len(q), limit)  # then what the leaf on the same side of all cuts has
        for j in self.at[some]:
            best = np.minimum(best, np.sqrt(((q - self.p[j]) ** 2).sum(1)))

        def kept(i: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
            if len(i):
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                best[i[starts]] = np.minimum(best[i[starts]], np.minimum.reduceat(far, starts))
            return near <= best[i] + SLACK

        i, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for k, (lo, hi) in enumerate(self.boxes):
            if k:
                i, node = np.repeat(i, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            if bounded and len(i) > WIDEST:
                return None
            keep = kept(i, *_bounds(q[i], lo[node], hi[node]))
            i, node = i[keep], node[keep]
        sizes = np.diff(self.edges)[node]
        if bounded and sizes.sum() > WIDEST:
            return None
        i = np.repeat(i, sizes)
        first = np.repeat(self.edges[:-1][node] - (np.cumsum(sizes) - sizes), sizes)
        j = self.at[first + np.arange(len(i))]
        d = q[i] - self.p[j]
        d = np.sqrt((d * d).sum(1))
        keep = kept(i, d, d)
        return i[keep], j[keep]


def _regions(asked: DataFrame, places: DataFrame, n: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__region``: right positions in the one where they lie, left ones in all that may hold their nearest."""
    import pyarrow as pa

    drawn = places.orderBy(F.xxhash64("__rlat", "__rlon")).limit(DRAWN * n).toArrow()
    tree = Tree(unit(*(drawn.column(c).to_numpy() for c in ("__rlat", "__rlon"))), DRAWN)

    def dealt(batches):
        for b in batches:
            region = tree.leaf_of(unit(b.column(0).to_numpy(), b.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], names=["__rlat", "__rlon", "__region"])

    places = places.mapInArrow(dealt, "__rlat double, __rlon double, __region long")
    x, y = F.radians("__rlat"), F.radians("__rlon")
    vector = [F.cos(x) * F.cos(y), F.cos(x) * F.sin(y), F.sin(x)]
    boxes = places.groupBy("__region").agg(*map(F.min, vector), *map(F.max, vector)).collect()
    region = np.array([r[0] for r in boxes])
    lo, hi = np.array([r[1:4] for r in boxes]), np.array([r[4:7] for r in boxes])
    step = max(1, WIDEST // len(boxes))

    def reach(batches):
        for b in batches:
            for s in range(0, b.num_rows, step):
                part = b.slice(s, step)
                least, most = _bounds(unit(part.column(0).to_numpy(), part.column(1).to_numpy())[:, None], lo, hi)
                i, k = np.nonzero(least <= np.minimum(most.min(1), limit)[:, None] + 2 * SLACK)  # the boxes are of other sines
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in part.columns), pa.array(region[k])], names=["__lat", "__lon", "__region"])

    return asked.mapInArrow(reach, "__lat double, __lon double, __region long"), places


def near_positions(asked: DataFrame, places: DataFrame, max_km: float, radius: float, rows: tuple[int, int]) -> DataFrame:
    """(__lat, __lon, __rlat, __rlon): for each position of ``asked`` its nearest of ``places`` within about ``max_km``, and those as near up to SLACK.

    The right side is cut into regions of about ``REGION`` positions, the left side of each into groups of about ``GROUP``.
    rows: at least so many positions on the left and on the right.
    """
    import pyarrow as pa

    limit = 2 * math.sin(min(max_km / radius, math.pi) / 2) + SLACK
    groups, n = (-(-rows[0] // GROUP) or 1), (-(-rows[1] // REGION) or 1)
    asked, places = _regions(asked, places, n, limit) if n > 1 else (x.withColumn("__region", F.lit(0).cast("long")) for x in (asked, places))
    asked = asked.withColumn("__group", F.pmod(F.xxhash64("__lat", "__lon"), F.lit(groups)).cast("int"))
    places = places.withColumn("__group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(left, right):
        lat, lon, rlat, rlon = (t.column(c).to_numpy() for t, names in ((left, ("__lat", "__lon")), (right, ("__rlat", "__rlon"))) for c in names)
        i, j = Tree(unit(rlat, rlon)).search(unit(lat, lon), limit) if len(lat) and len(rlat) else ([], [])
        i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
        return pa.table({"__lat": lat[i], "__lon": lon[i], "__rlat": rlat[j], "__rlon": rlon[j]})

    keys = ["__region", "__group"]
    return asked.groupBy(*keys).cogroup(places.groupBy(*keys)).applyInArrow(search, "__lat double, __lon double, __rlat double, __rlon double")
