"""Boxes that meet boxes: a distributed spatial join.

A bounded sample of both sides shapes one quadtree over x and y. Every box goes to each leaf it touches (boundary
replication). Rows are shuffled by group and leaf; each partition bulk-loads one R-tree (sort-tile-recursive packing,
the group and leaf being a further, exact dimension) and probes it level by level in vector operations. A pair is kept
only in the leaf that holds the lower corner of the two boxes' intersection (reference point), so it comes out once,
without a distinct. Groups that are hot even within a leaf are cut into blocks of both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudmason.functions.frames import plain
from cloudmason.session import partitions

#: Rows, at most about, that shape the quadtree. It affects only the balance of the partitions, never the result.
SAMPLE_ROWS = 20_000
#: Sampled rows in a leaf before it is split.
LEAF_SAMPLE = 100
MAX_DEPTH = 24
FANOUT = 16
#: Rows of one side of one leaf before it is cut into blocks.
BLOCK_ROWS = 100_000
#: Candidate pairs that one probing step may hold in memory.
PROBE_PAIRS = 2_000_000

LO, HI = ["lo_x", "lo_y", "lo_z"], ["hi_x", "hi_y", "hi_z"]


@dataclass
class QuadTree:
    """Nodes as arrays: bounds (x0, y0, x1, y1), first child or -1, and the leaf number of childless nodes."""

    bounds: np.ndarray
    child: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def grow(xy: np.ndarray, least_side: float, capacity: int = LEAF_SAMPLE, depth: int = MAX_DEPTH) -> QuadTree:
        big = np.finfo(float).max / 4
        if not len(xy):
            xy = np.zeros((1, 2))
        low, high = xy.min(0), xy.max(0)
        bounds, child = [[low[0], low[1], high[0], high[1]]], [-1]
        todo = [(0, xy, 0)]
        while todo:
            at, points, level = todo.pop()
            x0, y0, x1, y1 = bounds[at]
            if len(points) <= capacity or level >= depth or max(x1 - x0, y1 - y0) / 2 < least_side:
                continue
            cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
            child[at] = len(bounds)
            right, top = points[:, 0] >= cx, points[:, 1] >= cy
            for k, box in enumerate(([x0, y0, cx, cy], [cx, y0, x1, cy], [x0, cy, cx, y1], [cx, cy, x1, y1])):
                bounds.append(box)
                child.append(-1)
                todo.append((len(bounds) - 1, points[(right == bool(k & 1)) & (top == bool(k & 2))], level + 1))
        box, kids = np.array(bounds), np.array(child)
        box[:, :2] = np.where(box[:, :2] == low, -big, box[:, :2])  # what lies outside the sample belongs to the border leaves
        box[:, 2:] = np.where(box[:, 2:] == high, big, box[:, 2:])
        numbers = np.full(len(kids), -1)
        numbers[kids < 0] = np.arange((kids < 0).sum())
        return QuadTree(box, kids, numbers)

    def place(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf whose half-open area a box touches."""
        rows, nodes, found = np.arange(len(lo)), np.zeros(len(lo), int), []
        while len(rows):
            ends = self.child[nodes] < 0
            found.append((rows[ends], self.leaf[nodes[ends]]))
            rows, nodes = rows[~ends], nodes[~ends]
            rows, nodes = np.repeat(rows, 4), (self.child[nodes][:, None] + np.arange(4)).ravel()
            b = self.bounds[nodes]
            keep = (lo[rows, 0] < b[:, 2]) & (hi[rows, 0] >= b[:, 0]) & (lo[rows, 1] < b[:, 3]) & (hi[rows, 1] >= b[:, 1])
            rows, nodes = rows[keep], nodes[keep]
        return np.concatenate([r for r, _ in found]) if found else rows, np.concatenate([x for _, x in found]) if found else nodes


class RTree:
    """A packed R-tree over boxes with an exact group dimension."""

    def __init__(self, group: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.order = self._tile(group, (lo + hi) / 2)
        lo, hi = np.column_stack([group, lo])[self.order].astype(float), np.column_stack([group, hi])[self.order].astype(float)
        while True:
            self.levels.append((lo, hi))
            if len(lo) <= FANOUT:
                break
            starts = np.arange(0, len(lo), FANOUT)
            lo, hi = np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)

    @staticmethod
    def _tile(group: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive order: slabs by x within a group, then runs by y, then z."""
        n = len(group)
        by_x = np.lexsort((centre[:, 0], group))
        starts = np.r_[0, np.flatnonzero(np.diff(group[by_x])) + 1] if n else np.zeros(1, int)
        sizes = np.diff(np.r_[starts, n])
        within = np.arange(n) - np.repeat(starts, sizes)
        slab = np.empty(n, int)
        slab[by_x] = within // np.repeat(np.maximum(FANOUT, np.ceil(np.cbrt(sizes / FANOUT)).astype(int) ** 2 * FANOUT), sizes)
        by_y = np.lexsort((centre[:, 1], slab, group))
        key = np.r_[True, (np.diff(group[by_y]) != 0) | (np.diff(slab[by_y]) != 0)] if n else np.zeros(0, bool)
        starts = np.flatnonzero(key)
        sizes = np.diff(np.r_[starts, n])
        run = np.empty(n, int)
        run[by_y] = (np.arange(n) - np.repeat(starts, sizes)) // np.repeat(np.maximum(FANOUT, np.ceil(np.sqrt(sizes / FANOUT)).astype(int) * FANOUT), sizes)
        return np.lexsort((centre[:, 2], run, slab, group))

    def probe(self, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) of all pairs of meeting boxes, in parts of bounded size."""
        lo, hi = np.column_stack([group, lo]).astype(float), np.column_stack([group, hi]).astype(float)
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        if not width:
            return
        step = max(1, PROBE_PAIRS // (4 * FANOUT))
        todo = [(top, np.repeat(np.arange(s, min(s + step, len(lo))), width), np.tile(np.arange(width), min(s + step, len(lo)) - s)) for s in range(0, len(lo), step)]
        while todo:
            level, q, node = todo.pop()
            nlo, nhi = self.levels[level]
            keep = np.all((lo[q] <= nhi[node]) & (hi[q] >= nlo[node]), axis=1)
            q, node = q[keep], node[keep]
            if not level:
                if len(q):
                    yield q, self.order[node]
                continue
            below = len(self.levels[level - 1][0])
            for s in range(0, len(q), PROBE_PAIRS // FANOUT):
                part = node[s : s + PROBE_PAIRS // FANOUT]
                kids = (part[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                owner = np.repeat(q[s : s + PROBE_PAIRS // FANOUT], FANOUT)
                todo.append((level - 1, owner[kids < below], kids[kids < below]))


def _place(tree: QuadTree, reach: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, leaves = tree.place(batch[LO[:2]].to_numpy(float) - reach, batch[HI[:2]].to_numpy(float) + reach)
            out = batch.iloc[rows].copy()
            out.insert(1, "leaf", leaves.astype("int32"))
            yield plain(out)

    return run


def _probe(tree: QuadTree, refine: Callable, reach: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        del parts
        rows["key"] = rows.groupby(["grp", "leaf", "block_l", "block_r"], sort=False).ngroup()
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        right = right[right["key"].isin(left["key"].unique())]
        llo, lhi, rlo, rhi = left[LO].to_numpy(), left[HI].to_numpy(), right[LO].to_numpy(), right[HI].to_numpy()
        lid, rid, leaf, grp = left["id"].to_numpy(), right["id"].to_numpy(), left["leaf"].to_numpy(), left["grp"].to_numpy()
        index = RTree(right["key"].to_numpy(), rlo - reach, rhi + reach)
        corner = np.full(int(tree.leaf.max()) + 1, -1)
        corner[tree.leaf[tree.leaf >= 0]] = np.flatnonzero(tree.leaf >= 0)
        for q, r in index.probe(left["key"].to_numpy(), llo, lhi):
            at = np.maximum(llo[q, :2], rlo[r, :2] - reach)  # the reference point
            box = tree.bounds[corner[leaf[q]]]
            here = (at[:, 0] >= box[:, 0]) & (at[:, 0] < box[:, 2]) & (at[:, 1] >= box[:, 1]) & (at[:, 1] < box[:, 3])
            q, r = q[here], r[here]
            keep, measure = refine(lid[q], llo[q], lhi[q], rid[r], rlo[r], rhi[r])
            if keep.any():
                yield pd.DataFrame({"grp": grp[q][keep], "left_id": lid[q][keep], "right_id": rid[r][keep], "measure": measure[keep]})

    return run


def sample_tree(sides: list[DataFrame], least_side: float) -> tuple[QuadTree, int]:
    """A quadtree from at most about SAMPLE_ROWS rows of each side, and the rows of both; only the sample reaches the driver."""
    found, rows = [], 0
    for side in sides:
        n = side.count()
        rows += n
        some = side.select("lo_x", "hi_x", "lo_y", "hi_y")
        if n > SAMPLE_ROWS:
            some = some.sample(fraction=SAMPLE_ROWS / n, seed=7).limit(2 * SAMPLE_ROWS)
        p = some.toPandas().to_numpy(float)
        found.append(np.column_stack([(p[:, 0] + p[:, 1]) / 2, (p[:, 2] + p[:, 3]) / 2]) if len(p) else np.zeros((0, 2)))
    return QuadTree.grow(np.concatenate(found), least_side), rows


def box_join(left: DataFrame, right: DataFrame, refine: Callable, least_side: float, reach: float = 0.0) -> DataFrame:
    """Pairs of a left box and a right box grown by reach, of one group, that meet and pass refine.

    left, right: grp string, id long, lo_x..hi_z double; rows with a null or a NaN in any of them meet nothing and are
    left out. refine(left ids, lo, hi, right ids, lo, hi) -> (mask, measure), exact, on arrays of candidate
    pairs, with the boxes as given.
    Result: grp, left_id, right_id, measure, each pair once per pair of rows. least_side: no leaf gets smaller; choose it
    well above the usual box size so that replication stays low.
    """
    spark = left.sparkSession
    def usable(d: DataFrame) -> DataFrame:
        d = d.select("grp", F.col("id").cast("long").alias("id"), *(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in LO + HI))
        return d.dropna()

    left, right = usable(left), usable(right)
    tree, rows = sample_tree([left, right], least_side)
    placed = "grp string, leaf int, id long, " + ", ".join(f"{c} double" for c in LO + HI)
    sides = [d.select("grp", "id", *LO, *HI).mapInPandas(_place(tree, by), placed) for d, by in ((left, 0.0), (right, reach))]
    counts = [s.groupBy("grp", "leaf").count().filter(F.col("count") > BLOCK_ROWS).select("grp", "leaf", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias(f"n{k}")) for k, s in enumerate(sides)]
    hot = counts[0].join(counts[1], ["grp", "leaf"], "full")
    one, block = F.lit(1), lambda n: F.pmod(F.xxhash64("id"), n).cast("int")

    def blocks(d: DataFrame, side: int) -> DataFrame:
        n0, n1 = F.coalesce("n0", one), F.coalesce("n1", one)
        d = d.join(hot, ["grp", "leaf"], "left")
        own: Column = block(n0 if side == 0 else n1)
        others = F.explode(F.sequence(F.lit(0), (n1 if side == 0 else n0) - 1))
        names = ("block_l", "block_r") if side == 0 else ("block_r", "block_l")
        return d.select("grp", "leaf", F.lit(side).alias("side"), "id", *LO, *HI, own.alias(names[0]), others.alias(names[1])).select("grp", "leaf", "side", "id", *LO, *HI, "block_l", "block_r")

    both = blocks(sides[0], 0).unionByName(blocks(sides[1], 1))
    return both.repartition(partitions(spark, rows), "grp", "leaf", "block_l", "block_r").mapInPandas(_probe(tree, refine, reach), "grp string, left_id long, right_id long, measure double")


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs of points of one group at most radius apart: grp, left_id < right_id, measure (the distance).

    points: grp, id, x, y, z. Points with a missing group, id or coordinate have no pairs; points at one place are pairs
    at distance 0; rows that repeat an id are never paired with each other.
    """
    point = points.select("grp", "id", *(F.col(c).cast("double").alias(f"lo_{c}") for c in "xyz"), *(F.col(c).cast("double").alias(f"hi_{c}") for c in "xyz"))

    def refine(a: np.ndarray, alo: np.ndarray, ahi: np.ndarray, b: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(((alo - blo) ** 2).sum(1))
        return (a < b) & (d <= radius), d

    return box_join(point, point, refine, 8 * radius, reach=radius * (1 + 1e-9))


def containing_boxes(points: DataFrame, boxes: DataFrame, least_side: float = 16.0) -> DataFrame:
    """(point, box) of one group where the box holds the point, borders included: grp, left_id (point), right_id (box).

    points: grp, id, x, y, z; boxes: grp, id, lo_x..hi_z. A box whose lower corner exceeds its upper one holds nothing;
    rows with a missing value are left out; repeated rows each give their pairs.
    """
    point = points.select("grp", "id", *(F.col(c).cast("double").alias(f"lo_{c}") for c in "xyz"), *(F.col(c).cast("double").alias(f"hi_{c}") for c in "xyz"))

    def refine(a: np.ndarray, alo: np.ndarray, ahi: np.ndarray, b: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.all((alo >= blo) & (alo <= bhi), axis=1), np.zeros(len(a))

    return box_join(point, boxes, refine, least_side)
