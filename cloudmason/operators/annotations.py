"""Annotations and the objects they describe: nearest match, evidence of support, material search, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.functions import geometry as G
from cloudmason.functions import text as X
from cloudmason.functions import vocabulary as V

#: Cell sizes of the search rings in metres; a row not settled in one goes to the next, those left at last to the search by cells.
RINGS = [2.0, 16.0, 128.0]
#: Cells along each axis of a scene's box in the search by cells.
ACROSS = 32
NODE_FIELDS = ["material", "typology", "function", "description"]


def prepared(annotations: DataFrame) -> DataFrame:
    """annotation_id, scene_id, label (normalised class, null if none), x, y, z and the descriptive fields."""
    number = lambda c: F.nanvl(F.col(f"global_box_center_{c}").cast("double"), F.lit(None)).alias(c)
    fields = [c for c in ("source_csv", "source_row", "description", "historical_description", "material_description", "material", "typology", "function", "notes", "position", "supports", "supported_by") if c in annotations.columns]
    return annotations.select("annotation_id", "scene_id", X.l2_label(F.col("semantic_label")).alias("label"), *(number(c) for c in "xyz"), *(X.blank_to_null(F.col(c)).alias(c) if c not in ("source_row",) else F.col(c) for c in fields))


def match_objects(annotations: DataFrame, objects: DataFrame, most: float = V.ANNOTATION_M) -> DataFrame:
    """Each prepared annotation with method, reason, nearest_object, distance_m and obj_name (null where unmatched).

    The nearest object of the class (of any class where the label is missing) by box centre, in the plane where z is
    missing; ties go to the earliest object. Rings of growing cells find it without comparing whole scenes.
    """
    rows = annotations.select("annotation_id", "scene_id", "label", "x", "y", "z")
    there = objects.select("scene_id", F.col("semantic_label").alias("o_label"), "obj_ord", "obj_name", *(G.box_centre(c).alias(f"b{c}") for c in "xyz"))
    any_of = there.select("scene_id", "o_label").distinct()
    known = _known(rows, any_of)
    left = known.filter(F.col("known") & F.col("x").isNotNull() & F.col("y").isNotNull()).drop("known")
    found = None
    for ring in RINGS:
        settled = _nearest_in_ring(left, there, ring).filter(F.col("distance_m") <= ring)
        found = settled if found is None else found.unionByName(settled)
        left = left.join(settled.select("annotation_id"), "annotation_id", "left_anti")
    found = found.unionByName(_nearest_by_cells(left, there))
    out = annotations.join(known.select("annotation_id", "known"), "annotation_id").join(found.select("annotation_id", "nearest_object", "nearest_label", "distance_m"), "annotation_id", "left")
    hit = F.col("distance_m") <= most
    reason = F.when(~F.col("known"), "no candidates for semantic label").when(F.col("distance_m").isNull(), "missing global_box_center_x/y/z").when(~hit, "nearest object box_center is beyond max_distance")
    return out.withColumn("method", F.when(F.col("known"), "global_box_center").otherwise("none")).withColumn("reason", reason).withColumn("obj_name", F.when(hit, F.col("nearest_object"))).withColumn("obj_label", F.when(hit, F.col("nearest_label"))).drop("known", "nearest_label")


def _known(rows: DataFrame, any_of: DataFrame) -> DataFrame:
    """rows with known: whether the scene has an object of the label, or any object where the label is missing."""
    classes = any_of.groupBy("scene_id").agg(F.collect_set("o_label").alias("classes"))  # at most the ten classes per scene
    d = rows.join(classes, "scene_id", "left")
    known = F.when(F.col("label").isNull(), F.col("classes").isNotNull()).otherwise(F.coalesce(F.array_contains("classes", F.col("label")), F.lit(False)))
    return d.withColumn("known", known).drop("classes")


def _best_of(pairs: DataFrame) -> DataFrame:
    dz = F.coalesce(F.col("z") - F.col("bz"), F.lit(0.0))
    distance = G.norm(F.col("x") - F.col("bx"), F.col("y") - F.col("by"), dz)
    best = F.min(F.struct(distance.alias("distance_m"), "obj_ord", F.col("obj_name").alias("nearest_object"), F.col("o_label").alias("nearest_label"))).alias("best")
    return pairs.groupBy("annotation_id").agg(best).select("annotation_id", "best.*").drop("obj_ord")


def _nearest_in_ring(rows: DataFrame, there: DataFrame, cell: float) -> DataFrame:
    ring = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = rows.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    b = there.withColumn("ox", F.explode(ring)).withColumn("oy", F.explode(ring)).withColumn("gx", F.floor(F.col("bx") / cell) + F.col("ox")).withColumn("gy", F.floor(F.col("by") / cell) + F.col("oy")).drop("ox", "oy")
    return _best_of(a.join(b, ["scene_id", "gx", "gy"]).filter(F.col("label").isNull() | (F.col("label") == F.col("o_label"))))


def _nearest_by_cells(rows: DataFrame, there: DataFrame) -> DataFrame:
    """The nearest object at any distance: objects of a scene and class are gathered in at most ACROSS squared cells, a row
    meets the cells' boxes, and only the objects of cells that can hold the nearest one are measured."""
    scene = there.groupBy("scene_id").agg(*(f(f"b{c}").alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    at = lambda c: F.least(F.lit(ACROSS - 1), F.floor((F.col(f"b{c}") - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-9)) * ACROSS)).cast("int")
    placed = there.join(scene, "scene_id").withColumn("gx", at("x")).withColumn("gy", at("y")).drop("lo_x", "lo_y", "hi_x", "hi_y")
    cells = placed.groupBy("scene_id", "o_label", "gx", "gy").agg(*(f(f"b{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    # every cell is met under its class, and under no class by the rows without one
    keyed = cells.withColumn("key", F.explode(F.array("o_label", F.lit(""))))
    pairs = rows.withColumn("key", F.coalesce("label", F.lit(""))).join(keyed, ["scene_id", "key"]).drop("key")
    outside = lambda c: F.coalesce(F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)), F.lit(0.0))
    across = lambda c: F.coalesce(F.greatest(F.abs(F.col(f"lo_{c}") - F.col(c)), F.abs(F.col(f"hi_{c}") - F.col(c))), F.lit(0.0))
    pairs = pairs.withColumn("least", G.norm(*map(outside, "xyz"))).withColumn("most", G.norm(*map(across, "xyz")))
    bound = pairs.groupBy("annotation_id").agg(F.min("most").alias("bound"))
    kept = pairs.join(bound, "annotation_id").filter(F.col("least") <= F.col("bound") * (1 + 1e-9)).select(*rows.columns, "o_label", "gx", "gy")
    return _best_of(kept.join(placed, ["scene_id", "o_label", "gx", "gy"]))


def support_evidence(matched: DataFrame, objects: DataFrame) -> DataFrame:
    """Layer structural_evidence: supports and rests_on between an annotated object and all objects of the classes that its
    annotation names: explicit columns first, else free text that holds a stem of support."""
    rows = matched.filter(F.col("obj_name").isNotNull())
    columns = rows.columns
    explicit = F.col("supports") if "supports" in columns else F.lit(None).cast("string")
    by = F.col("supported_by") if "supported_by" in columns else F.lit(None).cast("string")
    free = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("function", "description", "historical_description", "notes") if c in columns))
    # the annotated object's own class never counts
    without = lambda a: F.filter(a, lambda x: x != F.col("obj_label"))
    named = without(X.mentioned_classes(explicit))
    stems = F.when(X.has_any(X.fold(free), V.SUPPORT_STEMS), without(X.mentioned_classes(free)))
    targets = F.when(F.size(named) > 0, named).otherwise(F.coalesce(stems, F.array().cast("array<string>")))
    down = rows.select("scene_id", "obj_name", "obj_label", F.explode(targets).alias("other")).distinct()
    up = rows.select("scene_id", "obj_name", "obj_label", F.explode(without(X.mentioned_classes(by))).alias("other")).distinct()
    named_objects = objects.select("scene_id", F.col("semantic_label").alias("other"), F.col("obj_name").alias("other_name"))
    lower_upper = down.join(named_objects, ["scene_id", "other"]).select("scene_id", F.col("obj_name").alias("lower"), F.col("other_name").alias("upper"), F.col("obj_label").alias("lower_label"), F.col("other").alias("upper_label"))
    lower_upper = lower_upper.unionByName(up.join(named_objects, ["scene_id", "other"]).select("scene_id", F.col("other_name").alias("lower"), F.col("obj_name").alias("upper"), F.col("other").alias("lower_label"), F.col("obj_label").alias("upper_label"))).distinct()
    level = F.lit("csv_structural_evidence").alias("rel_level")
    s = lower_upper.select("scene_id", F.col("lower").alias("source"), F.col("upper").alias("target"), F.lit("supports").alias("rel_type"), level, F.col("lower_label").alias("source_label"), F.col("upper_label").alias("target_label"))
    r = lower_upper.select("scene_id", F.col("upper").alias("source"), F.col("lower").alias("target"), F.lit("rests_on").alias("rel_type"), level, F.col("upper_label").alias("source_label"), F.col("lower_label").alias("target_label"))
    return s.unionByName(r)


def material_hits(matched: DataFrame, material: str, label: str | None = None) -> DataFrame:
    """Matched annotations whose material fields name the material, by the first alias group that the query belongs to."""
    d = matched.filter(F.col("obj_name").isNotNull())
    d = d if label is None else d.filter(F.col("obj_label") == label)
    value = X.first_value(*(F.col(c) for c in ("material_description", "material") if c in d.columns))
    return d.withColumn("material_text", value).filter(X.has_any(X.fold(F.col("material_text")), [w for w in X.material_words(material)]))


def by_position(objects: DataFrame, which: str) -> DataFrame:
    """Per scene and class the object at a position: central, left, right, south, north, bottom, top; ties by order."""
    w = Window.partitionBy("scene_id", "semantic_label")
    keys: dict[str, Column] = {"left": F.col("cx"), "right": -F.col("cx"), "south": F.col("cy"), "north": -F.col("cy"), "bottom": F.col("cz"), "top": -F.col("cz")}
    if which == "central":
        mean = objects.groupBy("scene_id", "semantic_label").agg(*(F.avg(f"c{c}").alias(f"m{c}") for c in "xyz"))
        objects = objects.join(mean, ["scene_id", "semantic_label"])
        keys["central"] = G.norm(*(F.col(f"c{c}") - F.col(f"m{c}") for c in "xyz"))
    return objects.withColumn("rn", F.row_number().over(w.orderBy(keys[which], "obj_ord"))).filter("rn = 1").select("scene_id", "semantic_label", "obj_name")


def resolve_target(objects: DataFrame, matched: DataFrame, which: str | None = None) -> DataFrame:
    """Per scene and class the one object that is meant: by position, else the only one, else the only annotated one."""
    annotated = matched.filter(F.col("obj_name").isNotNull()).select("scene_id", "obj_name").distinct().withColumn("annotated", F.lit(1))
    d = objects.join(annotated, ["scene_id", "obj_name"], "left").groupBy("scene_id", "semantic_label").agg(F.count("*").alias("n"), F.min("obj_name").alias("one"), F.count("annotated").alias("n_annotated"), F.min(F.when(F.col("annotated") == 1, F.col("obj_name"))).alias("one_annotated"))
    d = d.withColumn("obj_name", F.when(F.col("n") == 1, F.col("one")).when(F.col("n_annotated") == 1, F.col("one_annotated")))
    if which:
        d = d.drop("obj_name").join(by_position(objects, which), ["scene_id", "semantic_label"], "left")
    return d.select("scene_id", "semantic_label", "n", "obj_name")


def node_attributes(matched: DataFrame) -> DataFrame:
    """Per object the distinct values of the node fields in first-seen order, joined by '; '."""
    d = matched.filter(F.col("obj_name").isNotNull())
    fields = [c for c in NODE_FIELDS if c in d.columns]
    seen = [F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("annotation_id", F.col(c).alias("v"))))), lambda s: s["v"])), "; ").alias(c) for c in fields]
    return d.groupBy("scene_id", "obj_name").agg(*seen).select("scene_id", "obj_name", *(F.nullif(c, F.lit("")).alias(c) for c in fields))
