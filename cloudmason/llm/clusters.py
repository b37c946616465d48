"""Records grouped into clusters of mutually similar records: here points that form separate bodies.

Within spatial tiles (with a border of neighbours) each task builds an approximate nearest-neighbour graph by neighbour
descent and finds communities by modularity, both run until they settle. Communities are no bodies yet: modularity cuts
long bodies and the graph is approximate. So an exact check follows: pairs of points within the radius whose communities differ, found on a grid,
join their communities. Across tiles, communities that share a border point are joined by distributed label propagation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.operators.components import join_labels
from cloudmason.operators.point_grid import FORWARD, PAIRS, Cells, components, distance2, point_pairs
from cloudmason.operators.points import tiles
from cloudmason.session import cut, partitions

RADIUS = 0.5
LEAST_POINTS = 15
TILE = 16.0
#: Points of one group in one tile before that tile is cut.
HOT_TILE = 400_000
NEIGHBOURS = 6
#: Points whose candidates are measured at a time.
CHUNK = 4_000
#: Halvings of the share of wanted moves that is tried before a group counts as settled.
MOST_HALVINGS = 30
#: Nodes of whole groups whose communities are found at a time; more if one group has more.
BLOCK = 10_000


def _curve(group: np.ndarray, xyz: np.ndarray, side: float, shift: float) -> np.ndarray:
    """Points in the order of group and, inside it, of a Z-order curve over cells of the side, moved by shift cells."""
    cell = (np.floor(xyz / side + shift).astype(np.int64) & 0x1FFFFF).astype(np.uint64)
    code = np.zeros(len(xyz), np.uint64)
    for axis in range(3):
        c = cell[:, axis]
        for step, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            c = (c | (c << np.uint64(step))) & np.uint64(mask)
        code |= c << np.uint64(axis)
    return np.lexsort((code, group))


def neighbour_graph(_: Cells, group: np.ndarray, xyz: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(neighbour, squared distance), each (points, NEIGHBOURS): near neighbours by descent, inf where there is none.

    It starts from the points next to each other on two Z-order curves, shifted so that their seams differ. Each descent
    asks the neighbours' neighbours and a reverse neighbour of every point beside a change and keeps the nearest; it ends
    when no list changes.
    """
    n, k = len(xyz), NEIGHBOURS
    order = _curve(group, xyz, radius / 16, 0.0)
    first = np.r_[True, group[order][1:] != group[order][:-1]]
    part = (np.cumsum(first) - 1).astype(np.int32)
    local = xyz[order] - xyz[order][np.flatnonzero(first)][part]
    axes = [np.ascontiguousarray(local[:, a], np.float32) for a in range(3)]
    other = _curve(part, xyz[order], radius / 16, 6515.52)
    place = np.empty(n, np.int64)
    place[other] = np.arange(n)

    def closest(rows: np.ndarray, asked: np.ndarray, mixed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        asked.sort(axis=1)  # repeats come together and are struck out
        d = np.zeros(asked.shape, np.float32)
        for axis in axes:
            d += (axis[asked] - axis[rows, None]) ** 2
        if mixed:
            d[part[asked] != part[rows, None]] = np.inf
        d[asked == rows[:, None]] = np.inf
        d[:, 1:][asked[:, 1:] == asked[:, :-1]] = np.inf
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        asked, d = np.take_along_axis(asked, best, 1), np.take_along_axis(d, best, 1)
        rank = np.argsort(d, axis=1)
        asked, d = np.take_along_axis(asked, rank, 1), np.take_along_axis(d, rank, 1)
        return np.where(np.isinf(d), rows[:, None].astype(asked.dtype), asked), d  # no neighbour: the point itself, so that groups never mix

    near, dist = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    steps = np.array([s for s in range(-k, k + 1) if s])
    for at in range(0, n, CHUNK):  # bounded memory, whatever the size of the task
        rows = np.arange(at, min(n, at + CHUNK))
        asked = np.concatenate([np.clip(rows[:, None] + steps, 0, n - 1), other[np.clip(place[rows, None] + steps, 0, n - 1)]], axis=1)
        near[rows], dist[rows] = closest(rows, asked.astype(np.int32), mixed=True)
    active = np.arange(n)
    while len(active):
        own = np.arange(n, dtype=np.int32)
        reverse = np.repeat(own[:, None], k, axis=1)
        reverse[near.ravel(), np.tile(np.arange(k), n)] = np.repeat(own, k)
        changed = np.zeros(n, bool)
        for at in range(0, len(active), CHUNK):
            rows = active[at : at + CHUNK]
            asked = np.concatenate([near[rows], reverse[rows], near[near[rows]].reshape(len(rows), -1)], axis=1)
            found, far = closest(rows, asked)
            better = (far < dist[rows]).any(axis=1)
            rows = rows[better]
            near[rows], dist[rows], changed[rows] = found[better], far[better], True
        beside = changed | changed[near].any(axis=1) | changed[reverse].any(axis=1)
        beside[near[changed].ravel()] = True
        active = np.flatnonzero(beside) if changed.any() else active[:0]
    dist[dist > radius * radius] = np.inf
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return order[near[back]], dist[back]


def _merged(n: int, group: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, degree: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Communities, named by their first node, to start the moves from: communities that are each other's best partner
    merge, in rounds, until no merger of two raises the modularity."""
    label, inverse = np.arange(n), 1 / np.maximum(weight, 1e-12)
    degree = degree.copy()
    while len(u):
        gain = w - degree[u] * degree[v] * inverse[group[u]]
        good = gain > 1e-9
        u, v, w, gain = u[good], v[good], w[good], gain[good]  # a loss only grows with the degrees
        node, partner = np.r_[u, v], np.r_[v, u]
        best = np.full(n, -np.inf)
        np.maximum.at(best, node, np.r_[gain, gain])
        choice = np.full(n, -1)
        first = np.r_[gain, gain] == best[node]
        np.maximum.at(choice, node[first], partner[first])
        asked = np.flatnonzero(choice >= 0)
        low = asked[(choice[choice[asked]] == asked) & (asked < choice[asked])]
        if not len(low):
            # ties in a ring of choices: the best pair of each group merges alone
            order = np.lexsort((v, u, -gain, group[u]))
            of = group[u][order]
            lead = order[np.r_[True, of[1:] != of[:-1]]] if len(order) else order
            low, high = np.minimum(u[lead], v[lead]), np.maximum(u[lead], v[lead])
        else:
            high = choice[low]
        if not len(low):
            break
        to = np.arange(n)
        to[high] = low
        label = to[label]
        degree[low] += degree[high]
        u, v = to[u], to[v]
        keep = u != v
        a, b, w = np.minimum(u, v)[keep], np.maximum(u, v)[keep], w[keep]
        pair, which = np.unique(a * np.int64(n) + b, return_inverse=True)
        u, v, w = pair // n, pair % n, np.bincount(which, w, len(pair))
    return label


def _settled(n: int, group: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, degree: np.ndarray, weight: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Community of each node once no node wants to move alone, beginning with the communities of label.

    Nodes move whole rounds at a time, towards a lower label in even rounds and a higher one in odd ones, so that pairs do
    not swap. A group whose modularity a round does not raise takes it back and tries half as many of its moves, its best
    one always among them; so modularity only rises and the rounds end.
    """
    label = np.arange(n) if label is None else label
    idle, halvings = np.zeros(n, np.int8), np.zeros(len(weight), np.int64)
    inverse = 1 / np.maximum(weight, 1e-12)

    def quality(label: np.ndarray) -> np.ndarray:
        same = label[u] == label[v]
        total = np.bincount(label, degree, n)  # a label is the index of a node of its own group
        return np.bincount(group[u[same]], 2 * w[same], len(weight)) - np.bincount(group, total * total, len(weight)) * inverse

    s, t, w2 = np.r_[u, v], np.r_[v, u], np.r_[w, w]
    has = quality(label)
    step, dirty = 0, False
    while True:
        asked = idle[s] < 2
        if not asked.any():
            if not dirty:
                return label
            idle[(halvings <= MOST_HALVINGS)[group]], dirty = 0, False  # a last look at every node
            continue
        a, to, links = s[asked], label[t[asked]], w2[asked]
        key = a * np.int64(n) + to
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        node, target = key[first] // n, key[first] % n
        links = np.add.reduceat(links[order], first)
        total = np.bincount(label, degree, n)
        own = target == label[node]
        gain = links - degree[node] * (total[target] - np.where(own, degree[node], 0)) * inverse[group[node]]
        stay = -degree * (total[label] - degree) * inverse[group]
        stay[node[own]] = gain[own]
        gain -= stay[node]
        better = (gain > 1e-9) & ~own & ((target < label[node]) if step % 2 == 0 else (target > label[node]))
        idle[idle < 2] += 1
        node, target, gain = node[better], target[better], gain[better]
        if len(node):
            best = np.lexsort((target, -gain, node))
            best = best[np.r_[True, node[best][1:] != node[best][:-1]]]
            node, target, gain = node[best], target[best], gain[best]
            idle[node] = 0
            of = group[node]
            draw = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)
            tried = draw % (np.uint64(1) << halvings[of].astype(np.uint64)) == 0
            rank = np.lexsort((node, -gain, of))
            tried[rank[np.r_[True, of[rank][1:] != of[rank][:-1]]]] = True
            trial = label.copy()
            trial[node[tried]] = target[tried]
            now = quality(trial)
            rises = now > has
            busy = np.zeros(len(weight), bool)
            busy[of] = True
            halvings = np.where(busy, np.where(rises, np.maximum(halvings - 1, 0), halvings + 1), halvings)
            label, has = np.where(rises[group], trial, label), np.where(rises, now, has)
            moved = np.zeros(n, bool)
            moved[node[tried & rises[of]]] = True
            idle[t[moved[s]]] = 0
            dirty |= moved.any()
            idle[(halvings > MOST_HALVINGS)[group]] = 2
        step += 1


def communities(n: int, group: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Modularity-based communities: nodes move to the neighbouring community of highest gain until they settle, then the
    communities move as nodes of a smaller graph, until none of them moves. Whole groups are taken in blocks of nodes."""
    label, order, links = np.empty(n, np.int64), np.argsort(group, kind="stable"), np.argsort(group[u], kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    u, v, w = place[u[links]], place[v[links]], w[links]  # in the order of groups
    sorted_group = group[order]
    of = sorted_group[u]
    ends = np.r_[np.flatnonzero(sorted_group[1:] != sorted_group[:-1]) + 1, n]
    at = 0
    while at < n:
        to = ends[min(np.searchsorted(ends, at + BLOCK), len(ends) - 1)]
        e = slice(*np.searchsorted(of, [sorted_group[at], sorted_group[to - 1] + 1]))
        inner = np.cumsum(np.r_[True, sorted_group[at + 1 : to] != sorted_group[at : to - 1]]) - 1
        label[order[at:to]] = at + _block(inner, u[e] - at, v[e] - at, w[e])
        at = to
    return label


def _block(group: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """communities of one block of groups."""
    label = np.arange(len(group))
    degree = np.bincount(np.r_[u, v], np.r_[w, w], len(group))
    weight = np.bincount(group, degree)  # 2m of each group
    start = _merged(len(degree), group, u, v, w, degree, weight)
    while len(u):
        moved = _settled(len(degree), group, u, v, w, degree, weight, start)
        start = None
        names, small = np.unique(moved, return_inverse=True)
        label = small[label]
        if len(names) == len(degree):
            break
        degree, group = np.bincount(small, degree), group[names]
        a, b = np.minimum(small[u], small[v]), np.maximum(small[u], small[v])
        pair, which = np.unique((a * np.int64(len(names)) + b)[a != b], return_inverse=True)
        u, v, w = pair // len(names), pair % len(names), np.bincount(which, w[a != b], len(pair))
    return label


def bodies(group: np.ndarray, xyz: np.ndarray, radius: float = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(body, weighted degree) of each point; body is the index of one of its points, exact for the radius.

    The degree is the summed weight of a point's links to its nearest neighbours. All of them are in its body and within
    the radius, so it does not depend on what else the task holds."""
    n = len(xyz)
    if not n:
        return np.zeros(0, int), np.zeros(0)
    cells = Cells(group, xyz, radius * (1 + 1e-9))
    near, dist = neighbour_graph(cells, group, xyz, radius)
    keep = np.isfinite(dist)
    degree = np.where(keep, 1 - np.sqrt(np.where(keep, dist, 0)) / radius + 1e-3, 0).sum(axis=1)
    u = np.repeat(np.arange(n), NEIGHBOURS)[keep.ravel()]
    v, w = near[keep], 1 - np.sqrt(dist[keep]) / radius + 1e-3
    exact = distance2(xyz, u, v) <= radius * radius
    u, v, w = u[exact], v[exact], w[exact]
    both = np.minimum(u, v) * np.int64(n) + np.maximum(u, v)
    _, once = np.unique(both, return_index=True)
    u, v, w = u[once], v[once], w[once]
    found = communities(n, group, u, v, w)
    same = found[u] == found[v]
    label = components(n, u[same], v[same])  # the connected parts of each community
    label = components(n, u[~same], v[~same], label)  # communities that a true link of the graph joins
    return _closed(cells, group, xyz, radius, label), degree


def _closed(cells: Cells, group: np.ndarray, xyz: np.ndarray, radius: float, label: np.ndarray) -> np.ndarray:
    """Join the labels of all pairs within the radius; pairs of one label need no look."""
    n, order = len(xyz), cells.order
    lowest = lambda: (np.minimum.reduceat(label[order], cells.start), np.maximum.reduceat(label[order], cells.start))
    for offset in [(0, 0, 0), *FORWARD]:
        lo, hi = lowest()
        if offset == (0, 0, 0):
            a = b = np.flatnonzero(lo != hi)
        else:
            a, b = cells.matches(offset)
            mixed = ~((lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b]))
            a, b = a[mixed], b[mixed]
        sizes = cells.count[a] * cells.count[b]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            for p, q in point_pairs(cells, a[at:to], b[at:to], sizes[at:to]):
                p, q = order[p], order[q]
                differ = label[p] != label[q]
                p, q = p[differ], q[differ]
                close = (group[p] == group[q]) & (distance2(xyz, p, q) <= radius * radius)
                label = components(n, p[close], q[close], label)
            at = to
    return label


PIECES = "key long, id long, own boolean, body long, degree float"


def _solve(radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        del parts
        col = {c: table.column(c).to_numpy() for c in ("key", "check", "id", "x", "y", "z", "own")}
        del table
        xyz = np.column_stack([col.pop(c) for c in "xyz"]).astype(np.float64)
        both = col["key"].astype(np.uint64) * np.uint64(31) + col["check"].astype(np.int64).astype(np.uint64)
        group = np.unique(both, return_inverse=True)[1]
        label, degree = bodies(group, xyz, radius)
        ids = col["id"]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        for at in range(0, len(ids), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(col["key"][part]), pa.array(ids[part]), pa.array(col["own"][part]), pa.array(least[label[part]]), pa.array(degree[part].astype(np.float32))], ["key", "id", "own", "body", "degree"])

    return run


def describe_bodies(members: DataFrame, typical: int = 3) -> DataFrame:
    """head, n_points, typical_points: each body's size and its points of highest weighted degree (ties: lowest id)."""
    order = Window.partitionBy("head").orderBy(F.round("degree", 3).desc(), "id")
    # the rank's limit is pushed below the shuffle: no more than `typical` points of a body leave a task
    best = members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= typical)
    top = F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"))))
    return best.groupBy("head").agg(F.max("n_points").alias("n_points"), top.alias("top")).select("head", "n_points", F.array_join(F.col("top.id"), ",").alias("typical_points"))


def find_bodies(points: DataFrame, radius: float = RADIUS, least_points: int = LEAST_POINTS) -> DataFrame:
    """head, id, degree, n_points: every point of a body of at least least_points points, with the body's size; the head is
    the body's smallest id.

    points: grp, code, id (unique), x, y, z. Two points are of one body if points of the same grp and code link them in
    steps of at most radius. degree: the summed weight of
    the point's links to its NEIGHBOURS nearest points of the body, whatever the tiles.
    Defined cases: rows with a null code or group, or a missing coordinate, are in no body; points at one place are
    linked; an empty table gives no row; further columns are ignored.
    """
    xyz = [F.nanvl(F.col(c), F.lit(None)).alias(c) for c in "xyz"]
    usable = points.select("grp", "code", F.col("id").cast("long").alias("id"), *xyz).dropna()
    placed, total = tiles(usable, ["grp", "code"], radius * (1 + 1e-6), 0.0, TILE, HOT_TILE)
    placed = placed.drop("inner").repartition(partitions(points.sparkSession, total), "key")
    pieces = cut(placed.mapInArrow(_solve(radius), PIECES))
    # A point in several tiles ties their pieces together; pieces are named by their smallest point.
    own = pieces.filter("own").select("id", "body", "degree")
    guests = pieces.filter(~F.col("own")).select("id", F.col("body").alias("other"))
    links = guests.join(own.select("id", "body"), "id").select(F.col("body").alias("a"), F.col("other").alias("b")).distinct()
    heads = join_labels(links)
    sizes = own.groupBy("body").agg(F.count("*").alias("n"))
    named = sizes.join(heads, sizes["body"] == heads["node"], "left").select("body", "n", F.coalesce("head", "body").alias("head"))
    kept = named.groupBy("head").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_points)
    body = named.drop("n").join(kept.withColumnRenamed("n", "n_points"), "head")
    return own.join(body, "body").select("head", "id", "degree", "n_points")
