"""Labelled points: decoding, deterministic samples, density clusters, hulls and totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.functions import vocabulary as V
from cloudmason.functions.frames import plain
from cloudmason.operators.components import join_labels
from cloudmason.operators.dims import class_rules
from cloudmason.operators.point_grid import FORWARD, PAIRS, Cells, components, distance2, point_pairs
from cloudmason.session import cut, partitions

TILE_M = 16.0
#: Points of one class in one tile before that tile is cut; lists of cut tiles up to MAX_BROADCAST_TILES are broadcast.
HOT_TILE, MAX_BROADCAST_TILES = 400_000, 100_000
#: What a point is to a tile.
CORE, TIE, BORDER = 0, 1, 2


def code(points: DataFrame) -> Column:
    """semantic_label, else classification; whichever of the columns exist."""
    present = [c for c in ("semantic_label", "classification") if c in points.columns]
    if not present:
        raise ValueError("points need semantic_label or classification")
    return F.coalesce(*(F.col(c) for c in present))


def projected(points: DataFrame, normals: bool = False) -> DataFrame:
    """point_id, scene_id, row_idx, x, y, z (double), code; colours only if all three exist, normals on request, by alias."""
    cols = points.columns
    out = ["point_id", "scene_id", "row_idx", *(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in "xyz"), code(points).alias("code")]
    if {"red", "green", "blue"} <= set(cols):
        out += ["red", "green", "blue"]
    if normals:
        out += [F.col(f"n{c}" if f"n{c}" in cols else f"normal_{c}").cast("double").alias(f"n{c}") for c in "xyz" if f"n{c}" in cols or f"normal_{c}" in cols]
    return points.select(*out)


def decoded(points: DataFrame) -> DataFrame:
    """Points whose code names a class, with its name as label."""
    names = class_rules(points.sparkSession).select(F.col("class_id").alias("code"), F.col("semantic_label").alias("label"))
    return points.join(F.broadcast(names), "code")


def undecoded(points: DataFrame) -> DataFrame:
    """Per scene, code and reason the points that decoding drops."""
    names = class_rules(points.sparkSession).select(F.col("class_id").alias("code"))
    return points.join(F.broadcast(names), "code", "left_anti").groupBy("scene_id", "code").agg(F.count("*").alias("n"))


def shuffled(c: Column, seed: int = 1) -> Column:
    """A fixed pseudo-random order of row numbers, in plain 64-bit arithmetic."""
    return F.pmod(F.pmod(c, F.lit(1_000_000_000)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(4294967296))


def ranked(rows: DataFrame, by: list[str], order: str, parts: int = 256, top: int = 1 << 32) -> DataFrame:
    """rows with rank (1..) inside each group by a number 0 <= order < top and then point_id, without one task per group:
    the range of the order is cut into parts, counted, and each part's ranks start where the parts before it end."""
    d = rows.withColumn("part_", F.floor(F.col(order) * parts / top).cast("int"))
    counts = d.groupBy(*by, "part_").agg(F.count("*").alias("c_"))
    offsets = counts.withColumn("before_", F.sum("c_").over(Window.partitionBy(*by).orderBy("part_")) - F.col("c_")).drop("c_")
    w = Window.partitionBy(*by, "part_").orderBy(order, "point_id")
    return d.withColumn("k_", F.row_number().over(w)).join(offsets, [*by, "part_"]).withColumn("rank", F.col("k_") + F.col("before_")).drop("part_", "k_", "before_")


def chunk_sample(points: DataFrame, ratio: float, chunk: int = 500_000, seed: int = 1) -> DataFrame:
    """From each chunk of consecutive rows max(1, round(n x ratio)) rows, without replacement."""
    d = points.withColumn("chunk", F.floor(F.col("row_idx") / chunk)).withColumn("h", shuffled(F.col("row_idx"), seed))
    sizes = d.groupBy("scene_id", "chunk").agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(ratio)).cast("long")).alias("take"))
    return ranked(d, ["scene_id", "chunk"], "h").join(sizes, ["scene_id", "chunk"]).filter(F.col("rank") <= F.col("take")).drop("h", "rank", "take")


def voxel_sample(points: DataFrame, n: int, voxel: float = V.VOXEL_M, seed: int = 1) -> DataFrame:
    """Per scene at most n decoded points: class quotas max(1, round(n x share)), one point per voxel, classes trimmed to
    their quota, the whole to n; short classes are not refilled."""
    d = points.dropna(subset=["x", "y", "z"]).withColumn("h", shuffled(F.col("row_idx"), seed))
    sizes = d.groupBy("scene_id", "label").agg(F.count("*").alias("cnt"))
    totals = sizes.groupBy("scene_id").agg(F.sum("cnt").alias("total"))
    quota = sizes.join(totals, "scene_id").select("scene_id", "label", F.least("cnt", F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("cnt") / F.col("total")).cast("long"))).alias("quota"))
    cell = [F.floor(F.col(c) / voxel).alias(f"v{c}") for c in "xyz"]
    one = d.groupBy("scene_id", "label", *cell).agg(F.min(F.struct("h", "point_id")).alias("m")).select("scene_id", "label", "m.h", "m.point_id")
    kept = ranked(one, ["scene_id", "label"], "h").join(quota, ["scene_id", "label"]).filter(F.col("rank") <= F.col("quota")).select("scene_id", "label", "h", "point_id")
    return ranked(kept, ["scene_id"], "h").filter(F.col("rank") <= n).select("scene_id", "label", "point_id")


def _dbscan_tile(eps: float, least: int):
    """Own points as (kind, id, body): core points in their local body, core guests as ties, border points per body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        del parts
        d = {c: table.column(c).to_numpy() for c in table.column_names}
        xyz = np.column_stack([d[c] for c in "xyz"]).astype(float)
        group = np.unique(d["key"].astype(np.uint64) * np.uint64(31) + d["check"].astype(np.int64).astype(np.uint64), return_inverse=True)[1]
        n = len(xyz)
        cells = Cells(group, xyz, eps * (1 + 1e-9))

        def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for offset in [(0, 0, 0), *FORWARD]:
                a, b = (np.arange(len(cells.unique)),) * 2 if offset == (0, 0, 0) else cells.matches(offset)
                sizes = cells.count[a] * cells.count[b]
                ends, at = np.cumsum(sizes), 0
                while at < len(a):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                    for p, q in point_pairs(cells, a[at:to], b[at:to], sizes[at:to]):
                        p, q = cells.order[p], cells.order[q]
                        keep = (group[p] == group[q]) & ((p < q) | (offset != (0, 0, 0))) & (distance2(xyz, p, q) <= eps * eps)
                        yield p[keep], q[keep]
                    at = to

        degree = np.ones(n, np.int64)
        for p, q in close():
            degree += np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
        core = degree >= least
        label = np.arange(n)
        for p, q in close():
            both = core[p] & core[q]
            label = components(n, p[both], q[both], label)
        name = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(name, label[core], d["id"][core])
        own, inner = d["own"], d["inner"]
        ids, kinds, bodies = [d["id"][core & own], d["id"][core & ~own & inner]], [np.full((core & own).sum(), CORE, np.int8), np.full((core & ~own & inner).sum(), TIE, np.int8)], [name[label[core & own]], name[label[core & ~own & inner]]]
        for p, q in close():
            for a, b in ((p, q), (q, p)):
                k = own[a] & ~core[a] & core[b]
                if k.any():
                    ids.append(d["id"][a[k]])
                    bodies.append(name[label[b[k]]])
                    kinds.append(np.full(k.sum(), BORDER, np.int8))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(bodies))], ["kind", "id", "body"])

    return run


def tiles(d: DataFrame, keys: list[str], wide: float, near: float, side: float = TILE_M, hot_tile: int = HOT_TILE) -> tuple[DataFrame, int]:
    """(points in their tile and, as guests, in the tiles within `wide`: key, check, id, x, y, z, own, inner; points).

    d: the keys, id, x, y, z; points of different keys share no tile. own: the point's own tile; inner: within `near` of
    the tile. A tile with more than hot_tile points is cut along each axis, the finer the more it holds, down to parts of
    twice `wide`; a guest goes to the parts that it comes near."""
    home = d
    for c in "xyz":
        home = home.withColumn(f"h{c}", F.floor(F.col(c) / side))
    tile = [*keys, "nx", "ny", "nz"]
    counts = home.groupBy(*keys, *(F.col(f"h{c}").alias(f"n{c}") for c in "xyz")).agg(F.count("*").alias("n_points"))
    total, n_hot = counts.agg(F.coalesce(F.sum("n_points"), F.lit(0)), F.count_if(F.col("n_points") > hot_tile)).first()
    t = home
    for c in "xyz":
        t = t.withColumn(f"n{c}", F.explode(F.array_distinct(F.array(F.floor(F.col(c) / side), F.floor((F.col(c) - wide) / side), F.floor((F.col(c) + wide) / side)))))
    own, inner, parts = F.lit(True), F.lit(True), []
    for c in "xyz":
        own &= F.col(f"n{c}") == F.col(f"h{c}")
    if n_hot:
        finest = max(1, int(side / (2 * wide)))
        split = F.least(F.lit(finest), F.ceil(F.sqrt(F.col("n_points") / hot_tile)) * 2).cast("int")  # scans are surfaces
        hot = counts.filter(F.col("n_points") > hot_tile).select(*tile, split.alias("split"))
        t = t.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST_TILES else hot, tile, "left").withColumn("split", F.coalesce("split", F.lit(1)))
    for c in "xyz":
        low, length = F.col(f"n{c}") * side, F.lit(side)
        if n_hot:
            length = F.lit(side) / F.col("split")
            part = lambda v, low=low, length=length: F.greatest(F.lit(0), F.least(F.col("split") - 1, F.floor((v - low) / length))).cast("int")
            t = t.withColumn(f"p{c}", F.explode(F.sequence(part(F.col(c) - wide), part(F.col(c) + wide))))
            own &= F.col(f"p{c}") == part(F.col(c))
            low, parts = low + F.col(f"p{c}") * length, [*parts, f"p{c}"]
        inner &= (F.col(c) >= low - near) & (F.col(c) < low + length + near)
    names = ["nx", "ny", "nz", *parts]
    return t.select(F.xxhash64(*keys, *names).alias("key"), F.hash(*keys[::-1], *names[::-1]).alias("check"), "id", "x", "y", "z", own.alias("own"), inner.alias("inner")), total


def dbscan(points: DataFrame, eps: float = V.EPS_M, least: int = V.MIN_SAMPLES) -> DataFrame:
    """point_id, scene_id, label, cluster_id, obj_name of the points of all clusters of at least `least` points.

    points: point_id (unique), scene_id, label, row_idx, x, y, z. A core point has `least` points within eps, itself
    counted; clusters are the components of core points and are numbered by their smallest core row; a border point takes
    the lowest-numbered cluster among its core neighbours. Clusters left too small are dropped, numbers stay. Tiles carry
    a border of 2 eps, so that the core test is exact for every point a link of the tile can use.
    """
    d = points.dropna(subset=["scene_id", "label", "x", "y", "z"]).select("scene_id", "label", F.col("point_id").alias("id"), "row_idx", "x", "y", "z")
    placed, total = tiles(d.drop("row_idx"), ["scene_id", "label"], 2 * eps * (1 + 1e-6), eps * (1 + 1e-6), TILE_M, HOT_TILE)
    pieces = cut(placed.repartition(partitions(points.sparkSession, total), "key").mapInArrow(_dbscan_tile(eps, least), "kind byte, id long, body long"))
    cores = pieces.filter(F.col("kind") == CORE).select("id", "body")
    ties = pieces.filter(F.col("kind") == TIE).select("id", F.col("body").alias("other"))
    heads = join_labels(ties.join(cores, "id").select(F.col("body").alias("a"), F.col("other").alias("b")).distinct())
    named = lambda p: p.join(heads, p["body"] == heads["node"], "left").select("id", F.coalesce("head", "body").alias("head"))
    core_rows = named(cores).join(d.select("id", "scene_id", "label", "row_idx"), "id")
    first = core_rows.groupBy("scene_id", "label", "head").agg(F.min(F.struct("row_idx", "id")).alias("first"))
    numbers = first.withColumn("cluster_id", F.row_number().over(Window.partitionBy("scene_id", "label").orderBy("first")) - 1).select("head", "scene_id", "label", "cluster_id")
    border = named(pieces.filter(F.col("kind") == BORDER).select("id", "body").distinct()).join(numbers, "head").groupBy("id", "scene_id", "label").agg(F.min("cluster_id").alias("cluster_id"))
    members = named(cores).join(numbers, "head").select("id", "scene_id", "label", "cluster_id").unionByName(border.select("id", "scene_id", "label", "cluster_id"))
    sizes = members.groupBy("scene_id", "label", "cluster_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return members.join(sizes.drop("n"), ["scene_id", "label", "cluster_id"]).select(F.col("id").alias("point_id"), "scene_id", "label", "cluster_id", F.concat_ws("_", "label", F.col("cluster_id").cast("string")).alias("obj_name"))


def objects_of(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """One object per cluster: centroid, box and number of points."""
    d = clusters.join(points.select("point_id", "x", "y", "z"), "point_id")
    agg = [F.avg(c).alias(f"c{c}") for c in "xyz"] + [F.min(c).alias(f"min_{c}") for c in "xyz"] + [F.max(c).alias(f"max_{c}") for c in "xyz"]
    return d.groupBy("scene_id", "label", "cluster_id", "obj_name").agg(F.count("*").alias("point_count"), *agg).withColumnRenamed("label", "semantic_label")


def hull_faces(p: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Triangles (indices into p) of the convex hull; none for fewer than four points or flat sets. Quickhull."""
    none = np.zeros((0, 3), int)
    if len(p) < 4:
        return none
    scale = np.ptp(p, axis=0).max()
    if not scale:
        return none
    tol *= scale
    a, b = int(p[:, 0].argmin()), 0
    b = int(((p - p[a]) ** 2).sum(1).argmax())
    line = (p[b] - p[a]) / np.linalg.norm(p[b] - p[a])
    off = (p - p[a]) - ((p - p[a]) @ line)[:, None] * line
    c = int((off**2).sum(1).argmax())
    if np.linalg.norm(off[c]) <= tol:
        return none
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    normal /= np.linalg.norm(normal)
    height = (p - p[a]) @ normal
    e = int(np.abs(height).argmax())
    if abs(height[e]) <= tol:
        return none
    centre = p[[a, b, c, e]].mean(0)

    def plane(f: tuple) -> tuple[tuple, np.ndarray, float]:
        n = np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]])
        n = n / (np.linalg.norm(n) or 1.0)
        return (f, n, float(n @ p[f[0]])) if n @ centre <= n @ p[f[0]] else ((f[0], f[2], f[1]), -n, float(-n @ p[f[0]]))

    faces = [plane(f) for f in ((a, b, c), (a, b, e), (a, c, e), (b, c, e))]
    rest = np.arange(len(p))
    while True:
        normals, offsets = np.array([f[1] for f in faces]), np.array([f[2] for f in faces])
        over = p[rest] @ normals.T - offsets
        keep = over.max(1) > tol if len(rest) else np.zeros(0, bool)
        rest, over = rest[keep], over[keep]
        if not len(rest):
            return np.array([f[0] for f in faces])
        far = int(np.unravel_index(over.argmax(), over.shape)[0])
        seen = over[far] > tol
        edges = [(f[i], f[(i + 1) % 3]) for f, s in zip((x[0] for x in faces), seen, strict=True) if s for i in range(3)]
        rim = [x for x in edges if (x[1], x[0]) not in set(edges)]
        faces = [f for f, s in zip(faces, seen, strict=True) if not s] + [plane((i, j, int(rest[far]))) for i, j in rim]


def hull_area(p: np.ndarray) -> float:
    f = hull_faces(p)
    return float(np.linalg.norm(np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]]), axis=1).sum() / 2) if len(f) else 0.0


def surface_areas(points: DataFrame, clusters: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """scene_id, obj_name, surface_area: area of each object's convex hull. Hulls of parts come first, since the hull of
    their corners is the hull of all points; so no task holds a whole large object."""
    d = clusters.join(points.select("point_id", "x", "y", "z"), "point_id").select("scene_id", "obj_name", "x", "y", "z", "point_id")
    sizes = d.groupBy("scene_id", "obj_name").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
    d = d.join(sizes, ["scene_id", "obj_name"]).withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int"))

    def corners(own: pd.DataFrame) -> pd.DataFrame:
        p = own[["x", "y", "z"]].to_numpy()
        f = hull_faces(p)
        return plain(own.iloc[np.unique(f)] if len(f) else own)[["scene_id", "obj_name", "x", "y", "z"]]

    def area(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scene_id": [own["scene_id"].iloc[0]], "obj_name": [own["obj_name"].iloc[0]], "surface_area": [hull_area(own[["x", "y", "z"]].to_numpy())]})

    parts = d.groupBy("scene_id", "obj_name", "part").applyInPandas(corners, "scene_id string, obj_name string, x double, y double, z double")
    return parts.groupBy("scene_id", "obj_name").applyInPandas(area, "scene_id string, obj_name string, surface_area double")


def cloud_info(points: DataFrame) -> DataFrame:
    """Per scene: points, box, footprint and volume of the decoded points that have coordinates."""
    box = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    d = points.dropna(subset=["x", "y", "z"]).groupBy("scene_id").agg(F.count("*").alias("n_points"), *box)
    side = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")
    return d.withColumn("xy_area", side("x") * side("y")).withColumn("volume", side("x") * side("y") * side("z"))
