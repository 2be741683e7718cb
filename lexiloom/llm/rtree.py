"""Near-duplicate join by R-trees over count vectors.

The runs of a set are hashed into ``GROUPS`` groups; how many fall into each is a point. Two sets share at most the sum, over the groups,
of the smaller of both counts. The points of a list (see :mod:`.similar`) are packed by their coordinates into leaves of ``LEAF`` and these into
nodes of ``FAN``, level by level up to one root; a node keeps the largest count of each group and the smallest and largest
size below it. The tree is joined with itself from the root down: a pair of nodes whose summed coordinate minima cannot reach the overlap their
smallest sets need is dropped with everything below. Surviving pairs of points are verified exactly.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, similar

GROUPS = 64
LEAF, FAN = 8, 4


def packed_order(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Order of the points of one list: halved again and again along the coordinate (a group or the size) that varies most, down to leaves."""
    out, todo = [], [np.arange(len(n))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        c = counts[at].astype(np.float32)
        spread = c.var(0)
        best = int(spread.argmax())
        size = n[at].astype(np.float32)
        along = size if size.var() > spread[best] else c[:, best]
        at = at[np.argsort(along, kind="stable")]
        half = LEAF * (-(-len(at) // LEAF) // 2)
        todo += [at[half:], at[:half]]
    return np.concatenate(out)


class Level:
    """Nodes of one level, list by list: where their children begin and how many they are, and their boxes."""

    def __init__(self, lists: np.ndarray, fan: int, high: np.ndarray, low_n: np.ndarray, high_n: np.ndarray):
        within = np.arange(int(lists.sum())) - np.repeat(np.cumsum(lists) - lists, lists)
        self.first = np.flatnonzero(within % fan == 0)
        self.children = np.diff(np.r_[self.first, len(within)])
        self.lists = -(-lists // fan)
        self.high = np.maximum.reduceat(high, self.first)
        self.low_n, self.high_n = np.minimum.reduceat(low_n, self.first), np.maximum.reduceat(high_n, self.first)


class RTree(similar.Join):
    """Sets whose intersection is at least ``t`` of their union."""

    columns = "n int, pos int, counts binary"

    def __init__(self, t: float, seen: Counter | None = None):
        self.t, self.seen = t, seen

    def file(self, h, owner, pos, n, often):
        """Of n runs an alike set has at least ceil(t n), so it shares one of the n - ceil(t n) + 1 rarest."""
        keep = np.flatnonzero(pos < (n - np.ceil(self.t * n - 1e-9) + 1)[owner])
        counts = features.group_counts(h, owner, len(n), GROUPS)
        vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS), len(n), [None, pa.py_buffer(counts.tobytes())]).cast(pa.binary())
        at = owner[keep]
        return keep, {"n": pa.array(n[at].astype(np.int32)), "pos": pa.array(pos[keep].astype(np.int32)), "counts": vectors.take(pa.array(at))}

    def need(self, a, b):
        return self.t / (1 + self.t) * (a + b) - 1e-9

    def reaches(self, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of at least ``a`` and ``b`` runs below the boxes ``x`` and ``y`` may share enough; 255 stands for any count."""
        m = np.minimum(x, y)
        return (m.sum(1, dtype=np.int64) >= self.need(a, b)) | (m == 255).any(1)

    def pairs(self, cols, lists):
        n, pos, counts = cols["n"].astype(np.float64), cols["pos"].astype(np.float64), cols["counts"]
        order = np.arange(len(n))
        ends = np.cumsum(lists)
        for k in np.flatnonzero(lists > LEAF):
            s = slice(ends[k] - lists[k], ends[k])
            order[s] = s.start + packed_order(counts[s], n[s])
        high, size = counts[order], n[order]
        levels = [Level(lists, LEAF, high, size, size)]
        while (levels[-1].lists > 1).any():
            below = levels[-1]
            levels.append(Level(below.lists, FAN, below.high, below.low_n, below.high_n))
        roots = np.arange(len(lists))
        todo = [(len(levels) - 1, roots[k : k + similar.CHUNK // 64], roots[k : k + similar.CHUNK // 64]) for k in range(0, len(roots), similar.CHUNK // 64)]
        while todo:
            depth, x, y = todo.pop()
            level = levels[depth]
            most = similar.CHUNK // (LEAF * LEAF)
            if len(x) > most:
                todo += [(depth, x[k : k + most], y[k : k + most]) for k in range(0, len(x), most)]
                continue
            per = level.children[x] * level.children[y]
            w = np.repeat(np.arange(len(x)), per)
            r = np.arange(len(w)) - np.repeat(np.cumsum(per) - per, per)
            u, v = level.first[x[w]] + r // level.children[y[w]], level.first[y[w]] + r % level.children[y[w]]
            if depth:
                ok = u <= v
                u, v, below = u[ok], v[ok], levels[depth - 1]
                ok = (below.high_n[u] >= self.t * below.low_n[v] - 1e-9) & (below.high_n[v] >= self.t * below.low_n[u] - 1e-9)
                ok[ok] = (u[ok] == v[ok]) | self.reaches(below.high[u[ok]], below.high[v[ok]], below.low_n[u[ok]], below.low_n[v[ok]])
                if self.seen is not None:
                    self.seen[f"nodes {depth}"] += len(u)
                    self.seen[f"pruned {depth}"] += int((~ok).sum())
                todo.append((depth - 1, u[ok], v[ok]))
                continue
            ok = u < v
            s, t = order[u[ok]], order[v[ok]]
            ok = similar.apart(cols, s, t) & (np.minimum(n[s], n[t]) >= self.t * np.maximum(n[s], n[t]) - 1e-9)
            ok &= 1 + np.minimum(n[s] - pos[s] - 1, n[t] - pos[t] - 1) >= self.need(n[s], n[t])
            s, t = s[ok], t[ok]
            ok = self.reaches(counts[s], counts[t], n[s], n[t])
            if self.seen is not None:
                self.seen["points"] += len(u)
                self.seen["candidates"] += int(ok.sum())
            if ok.any():
                yield s[ok], t[ok]

    def verified(self, found: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("runs").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("runs").alias("y"))
        c = F.size(F.array_intersect("x", "y"))
        return found.join(x, "a").join(y, "b").where(c / (F.size("x") + F.size("y") - c) >= F.lit(self.t)).select("a", "b")
