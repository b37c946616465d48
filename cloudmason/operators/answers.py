"""Rows behind the scripted answers: what was observed and how it reads, per scene. Texts are left to a renderer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudmason.functions import vocabulary as V
from cloudmason.operators import features as S
from cloudmason.operators.relations import with_roles

_BY_ROLE = {r: [c for c in V.CLASSES if V.ROLES[c] == r] for r in dict.fromkeys(V.ROLES.values())}
#: Lists of objects by class in the answers: (answer, section, classes).
SECTIONS = [
    ("P5", "boundaries", ["floor", "wall", "roof", "vault"]),
    ("P6", "circulation", ["stairs"]),
    ("P11", "structural_system", _BY_ROLE["structural"]),
    ("P11", "support_surfaces", _BY_ROLE["support_surface"]),
    ("P11", "ornament", _BY_ROLE["ornamental"]),
    ("P11", "openings", _BY_ROLE["opening"]),
    ("P12", "potentially_bearing", _BY_ROLE["structural"]),
    ("P12", "not_bearing_or_open", _BY_ROLE["ornamental"] + _BY_ROLE["opening"] + _BY_ROLE["circulation"] + _BY_ROLE["unknown"]),
    ("P13", "structural_role", _BY_ROLE["structural"]),
    ("P14", "stairs", ["stairs"]),
    ("P14", "openings", ["door_window"]),
    ("P14", "floors", ["floor"]),
    ("P15", "secondary", _BY_ROLE["ornamental"] + _BY_ROLE["opening"] + _BY_ROLE["unknown"]),
    ("P17", "unknown", _BY_ROLE["unknown"]),
]


def object_lists(objects: DataFrame) -> DataFrame:
    """scene_id, answer, section, n, names (sorted, joined) for every section a scene has objects for."""
    hit = F.array_compact(F.array(*(F.when(F.col("semantic_label").isin(classes), F.struct(F.lit(a).alias("answer"), F.lit(s).alias("section"))) for a, s, classes in SECTIONS)))
    d = objects.select("scene_id", "obj_name", F.explode(hit).alias("h")).select("scene_id", "obj_name", "h.answer", "h.section")
    return d.groupBy("scene_id", "answer", "section").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("obj_name")), ", ").alias("names"))


def layer_sizes(objects: DataFrame, l1: DataFrame, evidence: DataFrame) -> DataFrame:
    """scene_id, n_l1, n_evidence, reading: quality of relations (P19) and ambiguities (P17)."""
    count = lambda d, name: d.groupBy("scene_id").agg(F.count("*").alias(name))
    d = objects.select("scene_id").distinct().join(count(l1, "n_l1"), "scene_id", "left").join(count(evidence, "n_evidence"), "scene_id", "left").fillna(0, ["n_l1", "n_evidence"])
    reading: Column = F.when((F.col("n_l1") > 0) & (F.col("n_evidence") == 0), "geometry_without_structural_evidence").when(F.col("n_evidence") > 0, "geometry_and_structural_evidence").otherwise("no_relations")
    return d.withColumn("reading", reading)


def scene_summary(objects: DataFrame) -> DataFrame:
    """P1: objects, classes, roles, the most sampled object and the typology of each scene."""
    roles = with_roles(objects).groupBy("scene_id").agg(F.count("*").alias("n_objects"), F.count_distinct("semantic_label").alias("n_classes"), F.count_distinct("role").alias("n_roles"), F.max_by("obj_name", F.struct(F.coalesce("point_count", F.lit(0)), -F.col("obj_ord"))).alias("most_sampled"))
    return roles.join(S.typology(S.pivoted(objects)), "scene_id")


def organising(objects: DataFrame) -> DataFrame:
    """P6: columns on the hull of the plan and inside it."""
    outer = S.outer_columns(objects).withColumn("outer", F.lit(1))
    d = objects.filter(F.col("semantic_label") == "column").join(outer, ["scene_id", "obj_name"], "left")
    return d.groupBy("scene_id").agg(F.count("outer").alias("n_outer"), (F.count("*") - F.count("outer")).alias("n_inner"))


# The four sections of the answer on observation and inference.
OBSERVATION_CHECK = {
    "observed": "Questa domanda valuta una risposta del modello, ma nel contesto corrente non è presente una risposta precedente da analizzare.",
    "relations": "Nessuna relazione di scena usata direttamente.",
    "inference": "La risposta corretta deve separare dati osservati, relazioni L1/evidenza strutturale/L3, interpretazioni architettoniche e confidenza. Il formato attuale dell'agente impone proprio queste quattro sezioni.",
    "confidence": "alta come criterio di valutazione; non valutabile su una risposta assente.",
}


def observation_check(objects: DataFrame) -> DataFrame:
    """P18: scene_id and the four sections, the same for every scene."""
    return objects.select("scene_id").distinct().select("scene_id", *(F.lit(t).alias(c) for c, t in OBSERVATION_CHECK.items()))


def hierarchy(objects: DataFrame) -> DataFrame:
    """P15: principal and secondary objects of each scene by role."""
    principal = F.col("role").isin("structural", "support_surface")
    return with_roles(objects).groupBy("scene_id", F.when(principal, "principal").otherwise("secondary").alias("rank")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("obj_name")), ", ").alias("names"))
