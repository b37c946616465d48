"""Geometric relations between the objects of a scene: near, above, below, adjacent_to, overlap, distances, neighbours.

Pairs are found on a grid: each box covers cells, boxes that share a cell are compared, and a pair counts only in the
cell of the lower corner of the boxes' intersection, so that no distinct is needed. Everything stays in generated code.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.functions import geometry as G
from cloudmason.functions import vocabulary as V
from cloudmason.operators.dims import class_rules
from cloudmason.session import cut

CELL_M = 8.0
KEEP = ["obj_ord", "obj_name", "semantic_label", "point_count", "cx", "cy", "cz", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]


def prefixed(objects: DataFrame, p: str, more: tuple[str, ...] = ()) -> DataFrame:
    return objects.select("scene_id", *(F.col(c).alias(f"{p}_{c}") for c in (*KEEP, *more)))


def meeting_pairs(objects: DataFrame, reach: float | str, centres: bool = False, cell: float = CELL_M) -> DataFrame:
    """Pairs a, b (obj_ord of a lower) of a scene whose boxes, or centroids, are within reach along x and y.

    reach: metres, or a column of objects that holds them, the same for all objects of a scene; cells grow with it."""
    own = isinstance(reach, str)

    def covered(p: str) -> DataFrame:
        d = prefixed(objects, p, (reach,) if own else ())
        half = (F.col(f"{p}_{reach}") if own else F.lit(float(reach))) / 2 * (1 + 1e-9) + 1e-9
        side = F.greatest(F.col(f"{p}_{reach}"), F.lit(cell)) if own else F.lit(cell)
        for x in "xy":
            lo, hi = (F.col(f"{p}_c{x}"),) * 2 if centres else (F.col(f"{p}_min_{x}"), F.col(f"{p}_max_{x}"))
            d = d.withColumn(f"{p}_lo_{x}", lo - half).withColumn(f"g{x}", F.explode(F.sequence(F.floor((lo - half) / side), F.floor((hi + half) / side))))
        return d

    pairs = covered("a").join(covered("b"), ["scene_id", "gx", "gy"]).filter(F.col("a_obj_ord") < F.col("b_obj_ord"))
    side = F.greatest(F.col(f"a_{reach}"), F.lit(cell)) if own else F.lit(cell)
    for x in "xy":
        pairs = pairs.filter(F.floor(F.greatest(f"a_lo_{x}", f"b_lo_{x}") / side) == F.col(f"g{x}"))
    return pairs.drop("gx", "gy", "a_lo_x", "a_lo_y", "b_lo_x", "b_lo_y")


def is_above(upper: str, lower: str) -> Column:
    gap = G.penetration_gap(upper, lower)
    column_on_arch = (F.col(f"{upper}_semantic_label") == "column") & (F.col(f"{lower}_semantic_label") == "arch")
    return (F.col(f"{upper}_cz") > F.col(f"{lower}_cz")) & gap.between(V.ABOVE_LOW, V.ABOVE_HIGH) & (G.xy_overlap_ratio(upper, lower) >= V.ABOVE_OVERLAP) & ~column_on_arch


def _emit(pairs: DataFrame, rows: list[tuple[Column, str, str, str, int]]) -> DataFrame:
    """One row per kept relation: (condition, source prefix, target prefix, type, place in the pair's list)."""
    made = [F.when(keep, F.struct(F.col(f"{s}_obj_name").alias("source"), F.col(f"{t}_obj_name").alias("target"), F.lit(kind).alias("rel_type"), F.col(f"{s}_semantic_label").alias("source_label"), F.col(f"{t}_semantic_label").alias("target_label"), F.lit(k).alias("k"))) for keep, s, t, kind, k in rows]
    return pairs.select("scene_id", F.col("a_obj_ord").alias("ord_a"), F.col("b_obj_ord").alias("ord_b"), F.explode(F.array_compact(F.array(*made))).alias("r")).select("scene_id", "r.source", "r.target", "r.rel_type", F.lit("geometric").alias("rel_level"), "r.source_label", "r.target_label", "ord_a", "ord_b", "r.k")


def relationships(objects: DataFrame, threshold: float | DataFrame = V.NEAR_M) -> DataFrame:
    """Layer L1: scene_id, source, target, rel_type, rel_level, labels and the order (ord_a, ord_b, k) of listing.

    threshold: one distance for all scenes, or scene_id, threshold; scenes without one take the default."""
    yes, limit = F.lit(True), threshold
    if isinstance(threshold, DataFrame):
        own = threshold.select("scene_id", F.col("threshold").alias("reach_m"))
        objects = objects.drop("reach_m").join(own, "scene_id", "left").fillna(V.NEAR_M, ["reach_m"])
        near = meeting_pairs(objects, "reach_m", centres=True).filter(G.centroid_distance("a", "b") <= F.col("a_reach_m"))
        boxes = meeting_pairs(objects, V.ABOVE_HIGH).join(own.withColumnRenamed("reach_m", "limit_m"), "scene_id", "left")
        limit = F.coalesce(F.col("limit_m"), F.lit(V.NEAR_M))
        close = G.bounds_gap("a", "b") <= F.least(limit * V.ADJACENT_SHARE, F.lit(V.ADJACENT_MOST))
    else:
        near = meeting_pairs(objects, threshold, centres=True).filter(G.centroid_distance("a", "b") <= threshold)
        boxes = meeting_pairs(objects, V.ABOVE_HIGH)
        close = G.bounds_gap("a", "b") <= min(threshold * V.ADJACENT_SHARE, V.ADJACENT_MOST)
    up, down = is_above("a", "b"), is_above("b", "a") & ~is_above("a", "b")
    return _emit(near, [(yes, "a", "b", "near", 0), (yes, "b", "a", "near", 1)]).unionByName(
        _emit(boxes, [(up, "a", "b", "above", 2), (up, "b", "a", "below", 3), (down, "b", "a", "above", 2), (down, "a", "b", "below", 3), (close, "a", "b", "adjacent_to", 4), (close, "b", "a", "adjacent_to", 5)])
    )


def auto_threshold(objects: DataFrame, block: int = 1000) -> DataFrame:
    """scene_id, threshold: the median of all centroid distances over 2.5, at least 0.5; 3.0 below two objects.

    Blocks of objects meet in separate tasks, which send histograms, then only the distances in the median's two bins;
    pairs are never emitted. Two bins per rank keep even and odd counts exact.
    """
    bins, width = 4096, 0.25
    base = objects.select("scene_id", "obj_ord", "cx", "cy", "cz")
    sizes = base.groupBy("scene_id").agg(F.count("*").alias("n"))
    cut = base.join(sizes, "scene_id").withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("blk", F.pmod(F.xxhash64("obj_ord"), F.col("nb")).cast("int"))
    a = cut.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))

    def distances(d: pd.DataFrame) -> np.ndarray:
        i, j = d["i"].iloc[0], d["j"].iloc[0]
        left, right = d[d["blk"] == i][["cx", "cy", "cz"]].to_numpy(), d[d["blk"] == j][["cx", "cy", "cz"]].to_numpy()
        e = left[:, None, :] - right[None, :, :]
        full = np.sqrt(e[..., 0] * e[..., 0] + e[..., 1] * e[..., 1] + e[..., 2] * e[..., 2])
        return full[np.triu_indices(len(left), 1)] if i == j else full.ravel()

    def histogram(d: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(np.minimum(distances(d) / width, bins - 1).astype(int), minlength=bins)
        k = np.flatnonzero(n)
        return pd.DataFrame({"scene_id": d["scene_id"].iloc[0], "bin": k.astype("int32"), "n": n[k]})

    own = a.drop("other", "nb", "n")
    counts = own.groupBy("scene_id", "i", "j").applyInPandas(histogram, "scene_id string, bin int, n long").groupBy("scene_id", "bin").agg(F.sum("n").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("scene_id").orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy("scene_id")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    wanted = run.filter(((F.col("upto") > low) & (F.col("upto") - F.col("n") <= low)) | ((F.col("upto") > high) & (F.col("upto") - F.col("n") <= high)))
    asked = wanted.groupBy("scene_id").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.min(F.col("upto") - F.col("n")).alias("before"), F.first("total").alias("total"))

    def inside(d: pd.DataFrame) -> pd.DataFrame:
        v = distances(d)
        k = np.minimum(v / width, bins - 1).astype(int)
        v = v[(k == d["b0"].iloc[0]) | (k == d["b1"].iloc[0])]
        return pd.DataFrame({"scene_id": d["scene_id"].iloc[0], "v": v})

    values = own.join(asked, "scene_id").groupBy("scene_id", "i", "j").applyInPandas(inside, "scene_id string, v double").join(asked, "scene_id")
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("scene_id").orderBy("v")) - 1 + F.col("before"))
    median = ranked.filter((F.col("rank") == low) | (F.col("rank") == high)).groupBy("scene_id").agg(F.avg("v").alias("median"))
    return sizes.join(median, "scene_id", "left").select("scene_id", F.when(F.col("median").isNull(), V.NEAR_M).otherwise(F.greatest(F.col("median") / V.AUTO_SCALE, F.lit(V.AUTO_FLOOR))).alias("threshold"))


def distance_metrics(pairs: DataFrame) -> DataFrame:
    """All measures of pairs with prefixes a and b."""
    g = G.gaps("a", "b")
    return pairs.select("scene_id", F.col("a_obj_name").alias("object_a"), F.col("b_obj_name").alias("object_b"), G.centroid_distance("a", "b").alias("centroid_distance"), G.bounds_gap("a", "b").alias("bbox_gap"), g[0].alias("gap_x"), g[1].alias("gap_y"), g[2].alias("gap_z"), G.vertical_gap("a", "b").alias("vertical_gap"), G.xy_overlap_ratio("a", "b").alias("xy_overlap_ratio"), (G.bounds_gap("a", "b") == 0).alias("touching_or_overlapping"))


#: Objects of a scene up to which all of them are measured at once; beyond, the search goes outward in rings.
SMALL_SCENE = 2_000
#: Radii of the rings in metres; what is not settled in the last meets the whole scene.
RADII = [8.0, 64.0, 512.0, 4096.0]


def _reached(own: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Pairs a, b of a scene whose boxes come within the radius along x and y: each once, found on a grid of that side."""

    def covered(d: DataFrame, p: str, more: float) -> DataFrame:
        for x in "xy":
            lo, hi = F.col(f"{p}_min_{x}") - more, F.col(f"{p}_max_{x}") + more
            d = d.withColumn(f"{p}_lo_{x}", lo).withColumn(f"g{x}", F.explode(F.sequence(F.floor(lo / radius), F.floor(hi / radius))))
        return d

    pairs = covered(own, "a", radius * (1 + 1e-9)).join(covered(others, "b", 0.0), ["scene_id", "gx", "gy"]).filter(F.col("a_obj_ord") != F.col("b_obj_ord"))
    for x in "xy":
        pairs = pairs.filter(F.floor(F.greatest(f"a_lo_{x}", f"b_lo_{x}") / radius) == F.col(f"g{x}"))
    return pairs.drop("gx", "gy", "a_lo_x", "a_lo_y", "b_lo_x", "b_lo_y")


def _large(objects: DataFrame, small: int) -> DataFrame:
    return objects.groupBy("scene_id").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("scene_id")


def nearest_objects(objects: DataFrame, asked: DataFrame, k: int = 10, label: str | None = None, small: int = SMALL_SCENE) -> DataFrame:
    """The k nearest objects (by box gap, then centroid distance, then order) of each asked scene_id, obj_name.

    Limits are clamped to 1..100. Scenes of up to `small` objects are measured at once. In larger ones the search goes
    outward: an object is settled in the first ring that holds k others within its radius; the result is the same.
    """
    k = max(1, min(100, k))
    others = prefixed(objects if label is None else objects.filter(F.col("semantic_label") == label), "b")
    own = prefixed(objects.join(asked.select("scene_id", "obj_name").distinct(), ["scene_id", "obj_name"], "left_semi"), "a")
    large = _large(objects, small)
    in_large = lambda d, how: d.join(large, "scene_id", how)

    def best(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("gap", G.bounds_gap("a", "b")).withColumn("distance", G.centroid_distance("a", "b"))
        order = Window.partitionBy("scene_id", "a_obj_ord").orderBy("gap", "distance", "b_obj_ord")
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("scene_id", F.col("a_obj_name").alias("obj_name"), "rank", F.col("b_obj_name").alias("neighbour"), F.col("b_semantic_label").alias("neighbour_label"), "gap", "distance")

    found = best(in_large(own, "left_anti").join(others, "scene_id").filter(F.col("a_obj_ord") != F.col("b_obj_ord")))
    left = in_large(own, "left_semi")
    if left.take(1):
        left, there = cut(left), cut(in_large(others, "left_semi"))
        for radius in RADII:
            ring = cut(best(_reached(left, there, radius)))
            settled = ring.filter((F.col("rank") == k) & (F.col("gap") <= radius)).select("scene_id", F.col("obj_name").alias("a_obj_name"))
            found = found.unionByName(ring.join(settled.withColumnRenamed("a_obj_name", "obj_name"), ["scene_id", "obj_name"], "left_semi"))
            left = cut(left.join(settled, ["scene_id", "a_obj_name"], "left_anti"))
        found = found.unionByName(best(left.join(there, "scene_id").filter(F.col("a_obj_ord") != F.col("b_obj_ord"))))
    return found


def class_distance(objects: DataFrame, label_a: str, label_b: str, vertical: bool = False, small: int = SMALL_SCENE) -> DataFrame:
    """Per scene the closest pair of two classes by box gap, or by vertical gap; ties by order.

    Scenes of up to `small` objects are measured at once; in larger ones the search by box gap goes outward in rings. The
    vertical gap knows no neighbourhood in plan: of each class only the first object of each pair of heights is measured."""
    a, b = prefixed(objects.filter(F.col("semantic_label") == label_a), "a"), prefixed(objects.filter(F.col("semantic_label") == label_b), "b")
    apart = lambda d: d.filter(F.col("a_obj_ord") != F.col("b_obj_ord"))
    measure = G.vertical_gap("a", "b") if vertical else G.bounds_gap("a", "b")
    least = F.min(F.struct(measure.alias("m"), "a_obj_ord", "b_obj_ord", "a_obj_name", "b_obj_name")).alias("best")
    if vertical:
        heights = lambda d, p: d.groupBy("scene_id", f"{p}_min_z", f"{p}_max_z").agg(*(F.min_by(c, f"{p}_obj_ord").alias(c) for c in d.columns if c not in ("scene_id", f"{p}_min_z", f"{p}_max_z")))
        a, b = (heights(a, "a"), heights(b, "b")) if label_a != label_b else (a, b)
        return apart(a.join(b, "scene_id")).groupBy("scene_id").agg(least).select("scene_id", F.col("best.a_obj_name").alias("object_a"), F.col("best.b_obj_name").alias("object_b"), F.col("best.m").alias("gap"))
    large = _large(objects, small)
    best = apart(a.join(large, "scene_id", "left_anti").join(b, "scene_id")).groupBy("scene_id").agg(least)
    left = a.join(large, "scene_id", "left_semi")
    if left.take(1):
        left, there = cut(left), cut(b.join(large, "scene_id", "left_semi"))
        for radius in RADII:
            ring = cut(_reached(left, there, radius).groupBy("scene_id").agg(least).filter(F.col("best.m") <= radius))
            best = best.unionByName(ring)
            left = cut(left.join(ring.select("scene_id"), "scene_id", "left_anti"))
        best = best.unionByName(apart(left.join(there, "scene_id")).groupBy("scene_id").agg(least))
    return best.select("scene_id", F.col("best.a_obj_name").alias("object_a"), F.col("best.b_obj_name").alias("object_b"), F.col("best.m").alias("gap"))


def overlapping(objects: DataFrame) -> DataFrame:
    """Pairs of boxes that overlap or touch, the first name smaller."""
    pairs = meeting_pairs(objects, 0.0).filter(G.boxes_meet("a", "b"))
    return pairs.select("scene_id", F.least("a_obj_name", "b_obj_name").alias("object_a"), F.greatest("a_obj_name", "b_obj_name").alias("object_b"))


def first_rows(rows: DataFrame, order: list, limit: int, by: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """The first limit rows of each group, with shown_rank. The rank filter is pushed below the shuffle, so that no more
    than limit rows of a group leave a task."""
    return rows.withColumn("shown_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("shown_rank") <= limit)


def shown_counts(rows: DataFrame, order: list, limit: int, parts: list[str]) -> DataFrame:
    """scene_id, parts, shown, hidden: how many of the first limit rows of a scene fall to each part, and how many rows of
    the scene are not shown."""
    shown = first_rows(rows, order, limit).groupBy("scene_id", *parts).agg(F.count("*").alias("shown"))
    return shown.join(rows.groupBy("scene_id").agg(F.count("*").alias("n_all")), "scene_id").select("scene_id", *parts, "shown", (F.col("n_all") - F.least("n_all", F.lit(limit))).alias("hidden"))


def undirected(relations: DataFrame) -> DataFrame:
    """First listing of each unordered pair and type."""
    key = [F.least("source", "target"), F.greatest("source", "target")]
    w = Window.partitionBy("scene_id", *key, "rel_type").orderBy("ord_a", "ord_b", "k")
    return relations.withColumn("seen", F.row_number().over(w)).filter("seen = 1").drop("seen")


def anomalies(relations: DataFrame, suspicious: bool = False) -> DataFrame:
    """scene_id, source, target, rel_type, issue: reciprocal above, below, supports, rests_on; contains and inside; openings
    outside walls; floors with doors; with suspicious also is_placed_on between other classes than stairs and floor."""
    both = ["above", "below", "supports", "rests_on"]
    r = relations.select("scene_id", "source", "target", "rel_type", "source_label", "target_label").distinct()
    back = r.select("scene_id", F.col("target").alias("source"), F.col("source").alias("target"), "rel_type")
    mutual = r.filter(F.col("rel_type").isin(both)).join(back, ["scene_id", "source", "target", "rel_type"], "left_semi").filter(F.col("source") < F.col("target")).withColumn("issue", F.lit("reciprocal"))
    opening = ~((F.col("source_label") == "door_window") & (F.col("target_label") == "wall"))
    issue = F.when(F.col("rel_type").isin(V.INVALID_RELATIONS), "unsupported").when((F.col("rel_type") == "is_opening_in") & opening, "invalid_opening").when((F.col("rel_type") == "has_part") & (F.col("source_label") == "floor") & (F.col("target_label") == "door_window"), "floor_part")
    if suspicious:
        issue = issue.when((F.col("rel_type") == "is_placed_on") & ~((F.col("source_label") == "stairs") & (F.col("target_label") == "floor")), "suspicious_placement")
    single = r.withColumn("issue", issue).filter(F.col("issue").isNotNull())
    return mutual.unionByName(single).select("scene_id", "source", "target", "rel_type", "issue")


def with_roles(rows: DataFrame, label: str = "semantic_label") -> DataFrame:
    """rows with the role of their class; unknown classes get the role unknown."""
    rules = class_rules(rows.sparkSession).select(F.col("semantic_label").alias("rule_label"), "role")
    return rows.join(F.broadcast(rules), F.col(label) == F.col("rule_label"), "left").withColumn("role", F.coalesce("role", F.lit("unknown"))).drop("rule_label")


def class_relation_summary(relations: DataFrame, examples: int = 3) -> DataFrame:
    """Per scene and class: relations by type, direction and the other class, with the first examples; same class skipped."""
    out = relations.select("scene_id", F.col("source_label").alias("semantic_label"), "rel_level", "rel_type", F.lit("out").alias("direction"), F.col("target_label").alias("other_label"), "source", "target", "ord_a", "ord_b", "k")
    into = relations.select("scene_id", F.col("target_label").alias("semantic_label"), "rel_level", "rel_type", F.lit("in").alias("direction"), F.col("source_label").alias("other_label"), "source", "target", "ord_a", "ord_b", "k")
    rows = out.unionByName(into).filter(F.col("semantic_label") != F.col("other_label"))
    return _counted(rows, ["scene_id", "semantic_label", "rel_level", "rel_type", "direction", "other_label"], examples)


def pair_relation_summary(relations: DataFrame, examples: int = 3) -> DataFrame:
    return _counted(relations, ["scene_id", "rel_level", "rel_type", "source_label", "target_label"], examples)


def _counted(rows: DataFrame, by: list[str], examples: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("ord_a", "ord_b", "k")
    some = F.array_sort(F.collect_list(F.when(F.col("rn") <= examples, F.struct("rn", F.concat_ws(" -> ", "source", "target").alias("t")))))
    return rows.withColumn("rn", F.row_number().over(w)).groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.transform(some, lambda s: s["t"]), "; ").alias("examples"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
