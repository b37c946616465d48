"""A handle on scenes: lazy tables and the tool functions over them. Every tool works on all scenes or on one."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cloudmason.functions import geometry as G
from cloudmason.functions import text as X
from cloudmason.functions import vocabulary as V
from cloudmason.operators import annotations as A
from cloudmason.operators import answers as N
from cloudmason.operators import features as S
from cloudmason.operators import points as P
from cloudmason.operators import relations as R
from cloudmason.operators import router
from cloudmason.session import cut

#: What is said where a question takes a layer for something that it is not.
STATEMENTS = {
    "part_of": "Part-of relations are no computed layer: they hold only where the CSV or the ontology graph states them.",
    "layer_l2_is_no_graph": "L2 is no graph: it is the descriptive detail of the CSV (descriptions, material, typology, function, notes, stated support).",
    "layer_l3_is_no_part_of": "L3 is no layer of part-of relations: it is the ontology graph built from the CSV or from descriptions.",
    "layer_l1_is_not_structural": "L1 holds geometric relations only (near, adjacent_to, above, below); supports and rests_on are structural evidence, kept apart.",
}


@dataclass(frozen=True)
class Parameters:
    """Of the pipeline from points to relations. sample_n None keeps all points; threshold None or 0 derives one per scene."""

    sample_n: int | None = 150_000
    voxel: float = V.VOXEL_M
    eps: float = V.EPS_M
    min_samples: int = V.MIN_SAMPLES
    threshold: float | None = V.NEAR_M
    annotation_distance: float = V.ANNOTATION_M


def _unset(v: str | None) -> str | None:
    return None if v is None or v.strip().lower() in ("", "none", "null") else v


@dataclass(frozen=True)
class SceneContext:
    """objects, and optionally points and annotations, of any number of scenes."""

    objects: DataFrame
    points: DataFrame | None = None
    annotations: DataFrame | None = None
    parameters: Parameters = Parameters()

    @staticmethod
    def from_points(points: DataFrame, annotations: DataFrame | None = None, parameters: Parameters = Parameters()) -> SceneContext:
        """Decode, sample and cluster points into objects. object_id is the smallest point of an object, obj_ord its rank by it."""
        p = P.decoded(P.projected(points))
        if parameters.sample_n:
            p = p.join(P.voxel_sample(p, parameters.sample_n, parameters.voxel).select("point_id"), "point_id", "left_semi")
        c = P.dbscan(p, parameters.eps, parameters.min_samples)
        first = c.groupBy("scene_id", "obj_name").agg(F.min("point_id").alias("object_id"))
        o = P.objects_of(p, c).join(first, ["scene_id", "obj_name"]).withColumn("obj_ord", F.col("object_id"))
        return SceneContext(o, p, annotations, parameters)

    def scene(self, scene_id: str) -> SceneContext:
        only = lambda d: None if d is None else d.filter(F.col("scene_id") == scene_id)
        return replace(self, objects=only(self.objects), points=only(self.points), annotations=only(self.annotations))

    @cached_property
    def threshold(self) -> float | DataFrame:
        """The distance threshold; with none given, scene_id and threshold, one derived for each scene."""
        return self.parameters.threshold or R.auto_threshold(self.objects)

    @cached_property
    def relationships(self) -> DataFrame:
        return R.relationships(self.objects, self.threshold)

    @cached_property
    def matched(self) -> DataFrame:
        if self.annotations is None:
            raise ValueError("no annotations are loaded")
        return A.match_objects(A.prepared(self.annotations), self.objects, self.parameters.annotation_distance)

    @cached_property
    def evidence(self) -> DataFrame:
        return A.support_evidence(self.matched, self.objects)

    def _target(self, semantic_label: str | None, object_name: str | None, exactly_one: bool = True) -> DataFrame:
        label, name = _unset(semantic_label), _unset(object_name)
        if exactly_one and (label is None) == (name is None):
            raise ValueError("give exactly one of semantic_label and object_name")
        if label is not None and label not in V.CLASSES:
            raise ValueError(f"{label} is none of {', '.join(V.CLASSES)}")
        d = self.objects if name is None else self.objects.filter(F.col("obj_name") == name)
        return d if label is None or name is not None else d.filter(F.col("semantic_label") == label)

    def list_semantic_labels(self) -> DataFrame:
        return S.class_counts(self.objects)

    def count_objects(self, semantic_label: str | None = None) -> DataFrame:
        return self._target(semantic_label, None, False).groupBy("scene_id").agg(F.count("*").alias("n"))

    def list_objects(self) -> DataFrame:
        return self.objects.select("scene_id", "semantic_label", "obj_name", "point_count").orderBy("scene_id", "semantic_label", "obj_ord")

    def list_object_geometry(self, semantic_label: str | None = None, object_name: str | None = None) -> DataFrame:
        d = self._target(semantic_label, object_name, False)
        return d.select("scene_id", "obj_name", "cx", "cy", "cz", *(G.box_centre(c).alias(f"centre_{c}") for c in "xyz"), *(G.box_size(c).alias(f"size_{c}") for c in "xyz"))

    def get_object_info(self, semantic_label: str | None = None, object_name: str | None = None) -> DataFrame:
        return S.object_features(self._target(semantic_label, object_name))

    def find_relationships(self, semantic_label: str | None = None, object_name: str | None = None) -> DataFrame:
        o = self._target(semantic_label, object_name).select("scene_id", "obj_name")
        r = self.relationships
        ends = [r.join(o.withColumnRenamed("obj_name", e), ["scene_id", e], "left_semi").select(r.columns) for e in ("source", "target")]
        return ends[0].unionByName(ends[1]).distinct()

    def get_object_annotation(self, semantic_label: str | None = None, object_name: str | None = None, position: str | None = None) -> DataFrame:
        if _unset(object_name):
            return self.matched.filter(F.col("obj_name") == object_name)
        label = _unset(semantic_label)
        place = next((n for n, ws in V.POSITION_WORDS if position and any(w in position.lower() for w in ws)), None)
        meant = A.resolve_target(self.objects if label is None else self.objects.filter(F.col("semantic_label") == label), self.matched, place)
        return self.matched.join(meant.filter(F.col("obj_name").isNotNull()).select("scene_id", "obj_name"), ["scene_id", "obj_name"], "left_semi")

    def find_objects_by_material(self, material: str, semantic_label: str | None = None, limit: int = 30) -> DataFrame:
        hits = A.material_hits(self.matched, material, _unset(semantic_label))
        return R.first_rows(hits, ["annotation_id"], max(1, min(200, limit)))

    def get_object_semantic_details(self, semantic_label: str, object_name: str) -> DataFrame:
        return self.matched.filter((F.col("obj_name") == object_name) & (F.col("obj_label") == semantic_label))

    def list_relationships(self, level: str = "all", relationship_type: str | None = None, object_name: str | None = None, semantic_label: str | None = None, limit: int = 30) -> DataFrame:
        layer = V.LEVEL_WORDS.get((level or "all").strip().lower())
        if layer is None:
            raise ValueError(f"unknown level {level}")
        columns = ["scene_id", "source", "target", "rel_type", "rel_level", "source_label", "target_label", "layer_ord"]
        r = self.relationships.withColumn("layer_ord", F.lit(1)).select(columns)
        if layer == "structural_evidence" or layer == "all" and self.annotations is not None:
            e = self.evidence.withColumn("layer_ord", F.lit(2)).select(columns)
            r = e if layer == "structural_evidence" else r.unionByName(e)
        elif layer.startswith(("L2", "L3")):
            r = r.limit(0)
        if kind := _unset(relationship_type):
            r = r.filter(F.col("rel_type") == kind)
        for value, ends in ((_unset(object_name), ("source", "target")), (_unset(semantic_label), ("source_label", "target_label"))):
            if value:
                r = r.filter((F.col(ends[0]) == value) | (F.col(ends[1]) == value))
        return R.first_rows(r, ["layer_ord", "source", "target", "rel_type"], max(1, min(1000, limit)))

    def find_relationship_anomalies(self, limit: int = 200) -> DataFrame:
        c = ["scene_id", "source", "target", "rel_type", "source_label", "target_label"]
        r = self.relationships.select(c)
        r = r if self.annotations is None else r.unionByName(self.evidence.select(c))
        return R.first_rows(R.anomalies(r), ["source", "target", "rel_type"], max(1, min(1000, limit)))

    def get_scene_statistics(self) -> DataFrame:
        e = S.edges(self.relationships).groupBy("scene_id").agg(F.count("*").alias("n_edges"))
        n = self.objects.groupBy("scene_id").agg(F.count("*").alias("n_objects"), F.count_distinct("semantic_label").alias("n_classes"))
        return n.join(e, "scene_id", "left").fillna(0, ["n_edges"]).join(S.room_volume(self.objects).select("scene_id", F.col("volume").alias("room_volume")), "scene_id", "left")

    def get_point_cloud_info(self) -> DataFrame:
        if self.points is None:
            raise ValueError("no points are loaded")
        return P.cloud_info(self.points)

    def measure_occupied_area(self, semantic_label: str | None = None, object_name: str | None = None) -> DataFrame:
        d = self._target(semantic_label, object_name, False)
        if _unset(semantic_label) is None and _unset(object_name) is None:
            return S.scene_box(d).select("scene_id", F.col("xy_area").alias("area"))
        return d.groupBy("scene_id").agg(F.sum(G.xy_area()).alias("area"), F.max_by("obj_name", G.xy_area()).alias("largest"))

    def estimate_room_volume(self) -> DataFrame:
        return S.room_volume(self.objects)

    def measure_distance(self, object_a: str, object_b: str) -> DataFrame:
        a, b = (R.prefixed(self.objects.filter(F.col("obj_name") == n), p) for n, p in ((object_a, "a"), (object_b, "b")))
        return R.distance_metrics(a.join(b, "scene_id"))

    def find_nearest_objects(self, object_name: str, limit: int = 10, semantic_label: str | None = None) -> DataFrame:
        return R.nearest_objects(self.objects, self.objects.filter(F.col("obj_name") == object_name), limit, _unset(semantic_label))

    def find_focal_points(self, limit: int = 5) -> DataFrame:
        return R.first_rows(S.centrality(self.objects, S.edges(self.relationships)), [F.desc("centrality"), "obj_ord"], limit)

    def find_pattern(self, semantic_label: str | None = None, relationship_type: str | None = None) -> DataFrame:
        o = self.objects.filter(F.col("semantic_label") == semantic_label) if _unset(semantic_label) else self.objects.limit(0)
        found = R.first_rows(o, ["obj_name"], 50).select("scene_id", F.lit("object").alias("part"), F.col("obj_name").alias("a"), F.lit(None).cast("string").alias("b"))
        r = self.relationships.filter(F.col("rel_type") == relationship_type) if _unset(relationship_type) else self.relationships.limit(0)
        return found.unionByName(R.first_rows(r, ["ord_a", "ord_b", "k"], 50).select("scene_id", F.lit("relation").alias("part"), F.col("source").alias("a"), F.col("target").alias("b")))

    def discover_functional_areas(self) -> DataFrame:
        return S.functional_areas(S.components_of(self.objects, self.relationships))

    def reload_scene(self, **changes) -> SceneContext:
        """A new handle with changed parameters; points are clustered again only where that matters."""
        p = replace(self.parameters, **changes)
        if self.points is None or not set(changes) - {"threshold", "annotation_distance"}:
            return replace(self, parameters=p)
        raw = self.points.withColumnRenamed("code", "semantic_label").drop("label")
        return SceneContext.from_points(raw, self.annotations, p)

    def ontology_rows(self) -> DataFrame:
        """The matched annotations as rows for the ontology graph; a missing class is that of the object."""
        m = self.matched.filter(F.col("obj_name").isNotNull())
        own = lambda c: F.col(c) if c in m.columns else F.lit(None).cast("string")
        return m.select(F.col("annotation_id").alias("row_id"), "scene_id", F.col("obj_name").alias("object_name"), F.lit(None).cast("string").alias("class_semantic_label"), F.coalesce("label", "obj_label").alias("semantic_label"), "x", "y", "z", F.coalesce(own("material"), own("material_description")).alias("material"), own("typology").alias("typology"), own("function").alias("function"), own("description").alias("description"), own("position").alias("position"))

    def ontology_graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the matched annotations and the relations between their objects. No annotations: ValueError."""
        from cloudmason.operators import ontology as H

        rows = cut(self.ontology_rows())
        named = cut(H.elements(rows)).join(rows.select("row_id", "object_name"), "row_id").select("scene_id", "object_name", "node_id")
        r = H.bridge_l1(self.relationships).select("scene_id", "source", "target", "rel_type")
        for end in ("source", "target"):
            r = r.join(named.select("scene_id", F.col("object_name").alias(end), F.col("node_id").alias(f"{end}_id")), ["scene_id", end])
        return H.build(rows, r.select("scene_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "rel_type").distinct())

    def answer(self, question: DataFrame, column: str = "question", default_label: str | None = None) -> DataFrame:
        """Handler, classes and language of each question (see operators.router)."""
        return router.route(question, column, default_label)

    def ask(self, text: str, default_label: str | None = None) -> list[tuple[str, str, DataFrame | str | None]]:
        """(question, handler, answer) for each question of an input. The answer is the rows of the handler's operator, a
        fixed statement where the handler gives one, or None where no handler fits; one such question leaves all unanswered."""
        asked = self.objects.sparkSession.createDataFrame([(text,)], "question string")
        routed = router.route(router.parts(asked, "question"), "text", default_label).orderBy("part").collect()  # one row per question typed
        found = [(r["text"], r["handler"], self._answered(r)) for r in routed]
        return [(q, h, None) for q, h, _ in found] if any(h == "unanswered" for _, h, _ in found) else found

    def _answered(self, asked: Row) -> DataFrame | str | None:
        text = asked["text"] or ""
        folded = " ".join(text.lower().split())
        labels, names = list(asked["classes"]), list(asked["objects"])
        label, name, handler = (labels or [None])[0], (names or [None])[0], asked["handler"]
        pair = list(dict.fromkeys(labels))[:2]
        between = lambda r: r.filter(F.col("source_label").isin(pair) & F.col("target_label").isin(pair) & (F.col("source_label") != F.col("target_label")))
        about = lambda r: r.filter((F.col("source_label") == label) | (F.col("target_label") == label)) if label else r
        supports = lambda: self.evidence.filter(F.col("rel_type") == "supports")
        roles = lambda *rs: R.with_roles(self.objects).filter(F.col("role").isin(*rs)).select("scene_id", "role", "obj_name")
        counts = lambda: S.pivoted(self.objects)
        facts = {
            "area_and_volume": lambda: S.scene_box(self.objects).select("scene_id", "xy_area", "volume"),
            "area": lambda: self.measure_occupied_area(label),
            "coordinates": lambda: self.list_object_geometry(None if name else label, name),
            "dominant_element": lambda: S.dominant(self.objects, self.relationships),
            "annotated_description": lambda: self.get_object_annotation(label, name, text),
            "opening_in_wall": lambda: between(self.relationships),
            "part_of_classes": lambda: STATEMENTS["part_of"],
            "load_bearing": lambda: roles("structural", "support_surface"),
            "class_role": lambda: R.with_roles(self._target(label, None, False)).groupBy("scene_id", "semantic_label", "role").agg(F.count("*").alias("n")),
            "objects_of_class": lambda: self.list_object_geometry(label),
            "class_pair_relations": lambda: R.pair_relation_summary(between(self.relationships)),
            "class_relations": lambda: R.class_relation_summary(about(self.relationships)),
            "inconsistencies": self.find_relationship_anomalies,
            "relationship_list": lambda: self.list_relationships(limit=30),
            "relationship_summary": lambda: self.relationships.groupBy("scene_id", "rel_level", "rel_type").agg(F.count("*").alias("n")),
            "above_below": lambda: R.first_rows(self.relationships.filter(F.col("rel_type") == "above"), ["ord_a", "ord_b"], 20),
            "scene_brief": lambda: S.brief(counts()),
            "count_of_class": lambda: self.count_objects(label),
            "present_classes": self.list_semantic_labels,
            "class_count": lambda: self.objects.groupBy("scene_id").agg(F.count_distinct("semantic_label").alias("n_classes")),
            "support_between": lambda: between(supports()),
            "open_support": lambda: about(supports()),
            "requested_facts": self.get_scene_statistics,
            "distance": lambda: self.measure_distance(*names[:2]) if len(names) > 1 else R.class_distance(self.objects, labels[0], labels[1], "vertical" in folded),
            "nearest_objects": lambda: self.find_nearest_objects(name, semantic_label=label),
            "material_inventory": lambda: self.matched.filter(F.col("obj_name").isNotNull()).select("scene_id", "obj_name", *(c for c in ("material_description", "material", "typology", "function") if c in self.matched.columns)),
            "prompt_1": lambda: N.scene_summary(self.objects),
            "prompt_2": lambda: S.dominant(self.objects, self.relationships),
            "prompt_3": lambda: R.first_rows(self.objects, [F.coalesce("point_count", F.lit(0)).desc(), "obj_ord"], 5),
            "prompt_4": lambda: S.inside_outside(counts()),
            "prompt_6": lambda: N.organising(self.objects),
            "prompt_7": lambda: R.undirected(self.relationships.filter(F.col("rel_type") == "adjacent_to")),
            "prompt_8": lambda: R.first_rows(self.relationships.filter(F.col("rel_type") == "above"), ["ord_a", "ord_b"], 20),
            "prompt_9": lambda: R.overlapping(self.objects),
            "prompt_10": lambda: R.first_rows(supports(), ["source", "target"], 20),
            "prompt_15": lambda: N.hierarchy(self.objects),
            "prompt_16": lambda: self.relationships.groupBy("scene_id", "rel_type").agg(F.count("*").alias("n")),
            "prompt_17": lambda: R.first_rows(self.objects, [F.coalesce("point_count", F.lit(0)).asc(), "obj_ord"], 8),
            "prompt_18": lambda: N.observation_check(self.objects),
            "prompt_19": lambda: N.layer_sizes(self.objects, self.relationships, self.evidence),
            "prompt_20": lambda: S.typology(counts()),
        }
        if handler.startswith("layer_"):
            return STATEMENTS[handler]
        if handler.startswith("prompt_") and handler not in facts:
            return N.object_lists(self.objects).filter(F.col("answer") == f"P{handler.removeprefix('prompt_')}")
        return facts[handler]() if handler in facts else None


    def find_label(self, text: DataFrame, column: str) -> DataFrame:
        return text.withColumn("classes", X.mentioned_classes(F.col(column)))


TOOLS = ["list_semantic_labels", "count_objects", "list_objects", "list_object_geometry", "get_object_info", "find_relationships", "get_object_annotation", "find_objects_by_material", "get_object_semantic_details", "list_relationships",
         "find_relationship_anomalies", "get_scene_statistics", "get_point_cloud_info", "measure_occupied_area", "estimate_room_volume", "measure_distance", "find_nearest_objects", "find_focal_points", "find_pattern", "discover_functional_areas", "reload_scene"]
