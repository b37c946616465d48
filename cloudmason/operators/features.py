"""Measures of objects and scenes, and the graph over objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.functions import geometry as G
from cloudmason.functions import vocabulary as V
from cloudmason.functions.frames import plain
from cloudmason.operators.components import join_labels
from cloudmason.operators.relations import with_roles


def object_features(objects: DataFrame) -> DataFrame:
    """volume, height, point_density (0 for flat boxes) and element_type (role) of each object."""
    v = G.volume()
    return with_roles(objects).select("scene_id", "obj_ord", "obj_name", "semantic_label", "point_count", v.alias("volume"), G.box_size("z").alias("height"), F.when(v == 0, 0.0).otherwise(F.col("point_count") / v).alias("point_density"), F.col("role").alias("element_type"))


def compactness(area: Column, volume: Column) -> Column:
    return F.when(volume == 0, 0.0).otherwise(area * area * area / (F.lit(36 * np.pi) * volume * volume))


def room_volume(objects: DataFrame) -> DataFrame:
    """Footprint of the largest floor times the height from its top to the highest wall, column, roof or vault; scenes
    without floor or envelope have no row; ties go to the earliest floor."""
    floor = F.max_by(F.struct("obj_name", G.xy_area().alias("area"), "max_z"), F.struct(G.xy_area().alias("a"), -F.col("obj_ord"))).alias("f")
    floors = objects.filter(F.col("semantic_label") == "floor").groupBy("scene_id").agg(floor)
    tops = objects.filter(F.col("semantic_label").isin("wall", "column", "roof", "vault")).groupBy("scene_id").agg(F.max("max_z").alias("upper_z"))
    height = F.greatest(F.lit(0.0), F.col("upper_z") - F.col("f.max_z"))
    return floors.join(tops, "scene_id").select("scene_id", F.col("f.obj_name").alias("floor_object"), F.col("f.area").alias("floor_area"), F.col("f.max_z").alias("lower_z"), "upper_z", height.alias("height"), (F.col("f.area") * height).alias("volume"))


def scene_box(objects: DataFrame) -> DataFrame:
    box = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    d = objects.groupBy("scene_id").agg(F.count("*").alias("n_objects"), *box)
    return d.select("*", *(G.box_centre(c).alias(f"centre_{c}") for c in "xyz"), G.xy_area().alias("xy_area"), G.volume().alias("volume"))


def class_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("scene_id", "semantic_label").agg(F.count("*").alias("n"))


def pivoted(objects: DataFrame) -> DataFrame:
    """One row per scene with the number of objects of each class as column n_class."""
    return objects.groupBy("scene_id").agg(*(F.sum(F.when(F.col("semantic_label") == c, 1).otherwise(0)).alias(f"n_{c}") for c in V.CLASSES), F.count("*").alias("n_objects"))


def typology(counts: DataFrame) -> DataFrame:
    has = lambda *cs: sum((F.col(f"n_{c}") for c in cs), F.lit(0)) > 0
    cover = has("roof", "vault")
    rule = (
        F.when((F.col("n_column") >= 4) & cover & has("floor"), "covered_colonnaded_space").when(has("wall") & has("floor") & cover, "covered_interior")
        .when(has("arch", "vault"), "vaulted_or_arched_space").when(has("stairs"), "vertical_circulation_space").otherwise("partial_scene")
    )
    return counts.select("scene_id", rule.alias("typology"))


def inside_outside(counts: DataFrame) -> DataFrame:
    floor, cover, wall = F.col("n_floor") > 0, (F.col("n_roof") + F.col("n_vault")) > 0, F.col("n_wall")
    rule = F.when(floor & cover & (wall >= 2), "interior_or_covered").when(floor & cover, "semi_interior").when((wall > 0) & floor, "interior_or_facade").otherwise("ambiguous")
    return counts.select("scene_id", rule.alias("reading"))


def brief(counts: DataFrame) -> DataFrame:
    has = lambda c: F.col(f"n_{c}") > 0
    rule = F.when((has("wall") | has("door_window")) & has("moldings"), "walls_openings_ornament").when(has("column") & (has("roof") | has("vault")), "covered_colonnade").otherwise("semantic_summary")
    return counts.select("scene_id", rule.alias("reading"))


def area_type(labels: Column) -> Column:
    """Kind of a functional area by its set of classes, first rule that fits."""
    any_of = lambda *cs: F.arrays_overlap(labels, F.array(*map(F.lit, cs)))
    return (
        F.when(any_of("vault", "arch", "column"), "vaulted_space").when(any_of("stairs"), "vertical_circulation").when(any_of("door_window", "wall"), "facade_zone")
        .when(any_of("floor", "wall"), "floor_zone").when(F.size(F.array_except(labels, F.array(*map(F.lit, V.STRUCTURAL)))) == 0, "structural_zone").otherwise("general_area")
    )


def edges(relations: DataFrame) -> DataFrame:
    """One row per directed pair: its distinct relation types in listing order and joined."""
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord_a", "ord_b", "k", "rel_type", "rel_level"))), lambda s: F.struct(s["rel_type"].alias("type"), s["rel_level"].alias("level"))))
    d = relations.groupBy("scene_id", "source", "target").agg(listed.alias("relations"))
    return d.withColumn("relationship", F.array_join(F.transform("relations", lambda r: r["type"]), ", "))


def undirected_edges(directed: DataFrame) -> DataFrame:
    """Both directions of a pair merged: the union of their relation types, sorted."""
    one = directed.select("scene_id", F.least("source", "target").alias("node_a"), F.greatest("source", "target").alias("node_b"), F.explode("relations.type").alias("type"))
    return one.groupBy("scene_id", "node_a", "node_b").agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"))


def centrality(objects: DataFrame, directed: DataFrame) -> DataFrame:
    """(in + out) / (n - 1) over distinct directed edges; 1 in scenes of one object."""
    ends = directed.select("scene_id", F.explode(F.array("source", "target")).alias("obj_name")).groupBy("scene_id", "obj_name").agg(F.count("*").alias("degree"))
    n = objects.groupBy("scene_id").agg(F.count("*").alias("n"))
    d = objects.select("scene_id", "obj_ord", "obj_name").join(n, "scene_id").join(ends, ["scene_id", "obj_name"], "left").fillna(0, ["degree"])
    return d.select("scene_id", "obj_ord", "obj_name", F.when(F.col("n") <= 1, 1.0).otherwise(F.col("degree") / (F.col("n") - 1)).alias("centrality"))


def relational_degree(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Relation rows at either end of each object; 0 without any."""
    ends = relations.select("scene_id", F.explode(F.array("source", "target")).alias("obj_name")).groupBy("scene_id", "obj_name").agg(F.count("*").alias("degree"))
    return objects.select("scene_id", "obj_ord", "obj_name", "semantic_label").join(ends, ["scene_id", "obj_name"], "left").fillna(0, ["degree"])


def components_of(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """object_id, head: weakly connected components over relations; objects without any are their own."""
    ids = objects.select("scene_id", "obj_name", "object_id")
    a = ids.select("scene_id", F.col("obj_name").alias("source"), F.col("object_id").alias("a"))
    b = ids.select("scene_id", F.col("obj_name").alias("target"), F.col("object_id").alias("b"))
    heads = join_labels(relations.select("scene_id", "source", "target").distinct().join(a, ["scene_id", "source"]).join(b, ["scene_id", "target"]).select("a", "b"))
    return objects.join(heads, objects["object_id"] == heads["node"], "left").select("scene_id", "object_id", "semantic_label", F.coalesce("head", "object_id").alias("head"))


def functional_areas(parts: DataFrame) -> DataFrame:
    labels = F.array_sort(F.collect_set("semantic_label"))
    return parts.groupBy("scene_id", "head").agg(F.count("*").alias("n_objects"), labels.alias("labels")).select("scene_id", F.col("head").alias("first_object_id"), "n_objects", F.array_join("labels", ",").alias("labels"), area_type(F.col("labels")).alias("area_type"))


def outer_columns(objects: DataFrame) -> DataFrame:
    """Columns whose centroid is a corner of the scene's convex hull of column centroids; three or fewer are all outer.
    Hulls of parts come first, so that no task holds a whole large scene."""

    def corners(own: pd.DataFrame) -> pd.DataFrame:
        pts = own.sort_values(["cx", "cy", "obj_ord"]).drop_duplicates(["cx", "cy"])
        if len(pts) <= 3:
            return own[own["obj_ord"].isin(pts["obj_ord"])] if len(own) > 3 else own
        rows = pts[["cx", "cy"]].to_numpy()

        def chain(order: range) -> list[int]:
            out: list[int] = []
            for i in order:
                while len(out) >= 2 and (rows[out[-1]][0] - rows[out[-2]][0]) * (rows[i][1] - rows[out[-2]][1]) - (rows[out[-1]][1] - rows[out[-2]][1]) * (rows[i][0] - rows[out[-2]][0]) <= 0:
                    out.pop()
                out.append(i)
            return out[:-1]

        return pts.iloc[sorted({*chain(range(len(rows))), *chain(range(len(rows) - 1, -1, -1))})]

    columns = objects.filter(F.col("semantic_label") == "column").select("scene_id", "obj_ord", "obj_name", "cx", "cy")
    schema = "scene_id string, obj_ord int, obj_name string, cx double, cy double"
    parts = columns.withColumn("part", F.floor(F.col("obj_ord") / 20_000)).groupBy("scene_id", "part")
    some = parts.applyInPandas(lambda own: plain(corners(own.drop(columns="part"))), schema)
    return some.groupBy("scene_id").applyInPandas(lambda own: plain(corners(own)), schema).select("scene_id", "obj_name")


def dominant(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Votes 3, 2, 1 for the first three by points, volume and relational degree; winners have the most votes, at least 4."""
    d = relational_degree(objects, relations).join(objects.select("scene_id", "obj_ord", "point_count", G.volume().alias("volume")), ["scene_id", "obj_ord"])
    votes = None
    for metric in ("point_count", "volume", "degree"):
        w = Window.partitionBy("scene_id").orderBy(F.coalesce(F.col(metric), F.lit(0)).desc(), "obj_ord")
        own = d.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("scene_id", "obj_name", (4 - F.col("r")).alias("v"))
        votes = own if votes is None else votes.unionByName(own)
    total = votes.groupBy("scene_id", "obj_name").agg(F.sum("v").alias("votes"))
    return total.withColumn("most", F.max("votes").over(Window.partitionBy("scene_id"))).filter((F.col("votes") == F.col("most")) & (F.col("most") >= 4)).select("scene_id", "obj_name", "votes")
