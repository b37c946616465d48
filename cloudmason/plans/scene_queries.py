"""Queries over objects, points and annotations of all scenes, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmason.functions import geometry as G
from cloudmason.functions import text as X
from cloudmason.functions import vocabulary as V
from cloudmason.operators import annotations as A
from cloudmason.operators import answers as N
from cloudmason.operators import features as S
from cloudmason.operators import points as P
from cloudmason.operators import relations as R
from cloudmason.operators.dims import class_rules
from cloudmason.plans import sql_parts as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def objects(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "objects")


def l1(s: SparkSession, d: str) -> DataFrame:
    return R.relationships(objects(s, d))


def points(s: SparkSession, d: str) -> DataFrame:
    return P.decoded(P.projected(table(s, d, "points")))


def matched(s: SparkSession, d: str) -> DataFrame:
    return A.match_objects(A.prepared(table(s, d, "annotations")), objects(s, d))


def evidence(s: SparkSession, d: str) -> DataFrame:
    """The test tables state no support, so bearing elements are read as carrying vaults and roofs, bracing ones as resting on walls."""
    m = matched(s, d).withColumn("supports", F.when(F.col("function") == "bearing", "vaults, roof")).withColumn("supported_by", F.when(F.col("function") == "bracing", "the walls"))
    return A.support_evidence(m.drop("description", "historical_description", "notes"), objects(s, d))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- A, F: reading and decoding


@query(f"WITH {Q.POINTS} SELECT point_id, scene_id, row_idx, code FROM pts")
def a2_projected_points(s, d):
    return P.projected(table(s, d, "points")).select("point_id", "scene_id", "row_idx", "code")


@query(f"WITH {Q.NAMED} SELECT scene_id, label, count(*) AS n FROM named GROUP BY scene_id, label")
def a5_decoded_counts(s, d):
    return points(s, d).groupBy("scene_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {Q.POINTS} SELECT scene_id, code, count(*) AS n FROM pts WHERE code IS NULL OR code NOT IN (SELECT class_id FROM class_list) GROUP BY scene_id, code")
def a5_dropped_points(s, d):
    return P.undecoded(P.projected(table(s, d, "points")))


@query(f"""WITH h AS (SELECT point_id, scene_id, row_idx // 1000 AS chunk, {Q.ORDER_HASH} AS o FROM points WHERE scene_id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, chunk ORDER BY o, point_id) AS k, count(*) OVER (PARTITION BY scene_id, chunk) AS n FROM h)
    SELECT scene_id, chunk, point_id FROM r WHERE k <= greatest(1, round_even(n * 0.2, 0))""")
def a3_chunk_sample(s, d):
    return P.chunk_sample(P.projected(table(s, d, "points")), 0.2, chunk=1000).select("scene_id", "chunk", "point_id")


@query(f"""WITH {Q.NAMED},
    h AS (SELECT *, {Q.ORDER_HASH} AS o FROM named WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
    c AS (SELECT scene_id, label, count(*) AS cnt FROM h GROUP BY ALL),
    q AS (SELECT scene_id, label, least(cnt, greatest(1, round_even(500 * cnt / sum(cnt) OVER (PARTITION BY scene_id), 0))) AS quota FROM c),
    v AS (SELECT *, row_number() OVER (PARTITION BY scene_id, label, floor(x / 0.05), floor(y / 0.05), floor(z / 0.05) ORDER BY o, point_id) AS k FROM h),
    w AS (SELECT v.*, row_number() OVER (PARTITION BY scene_id, label ORDER BY o, point_id) AS k2 FROM v WHERE k = 1),
    t AS (SELECT w.*, row_number() OVER (PARTITION BY w.scene_id ORDER BY o, point_id) AS k3 FROM w JOIN q USING (scene_id, label) WHERE k2 <= quota)
    SELECT scene_id, label, point_id FROM t WHERE k3 <= 500""")
def a6_voxel_sample(s, d):
    return P.voxel_sample(points(s, d), 500)


@query(f"SELECT class_id, semantic_label, {Q.ROLE} AS role, semantic_label IN ({Q.quoted(V.STRUCTURAL)}) AS structural FROM class_list")
def a22_class_rules(s, d):
    return class_rules(s).select("class_id", "semantic_label", "role", "structural")


@query(f"WITH {Q.NAMED} SELECT label, count(*) AS n, count(x) AS n_located FROM named WHERE label IN ('wall', 'vault') GROUP BY label")
def a21_b18_class_filter(s, d):
    return points(s, d).filter(F.col("label").isin("wall", "vault")).groupBy("label").agg(F.count("*").alias("n"), F.count("x").alias("n_located"))


# ---- B: selections


@query("SELECT scene_id, obj_name FROM objects WHERE semantic_label = 'column'")
def b1_objects_of_class(s, d):
    return objects(s, d).filter(F.col("semantic_label") == "column").select("scene_id", "obj_name")


@query("SELECT scene_id, obj_name, semantic_label FROM objects WHERE semantic_label IN ('floor', 'wall', 'roof', 'vault')")
def b2_objects_of_classes(s, d):
    return objects(s, d).filter(F.col("semantic_label").isin("floor", "wall", "roof", "vault")).select("scene_id", "obj_name", "semantic_label")


@query(f"SELECT scene_id, obj_name, {Q.ROLE} AS role FROM objects WHERE {Q.ROLE} IN ('structural', 'opening')")
def b3_objects_by_role(s, d):
    return R.with_roles(objects(s, d)).filter(F.col("role").isin("structural", "opening")).select("scene_id", "obj_name", "role")


@query("""WITH r AS (SELECT scene_id, semantic_label, obj_name, row_number() OVER (PARTITION BY scene_id, semantic_label ORDER BY obj_ord) AS k FROM objects)
    SELECT scene_id, semantic_label, obj_name FROM r WHERE k = 1""")
def b5_suggested_objects(s, d):
    return R.first_rows(objects(s, d), ["obj_ord"], 1, ("scene_id", "semantic_label")).select("scene_id", "semantic_label", "obj_name")


@query(f"WITH {Q.L1} SELECT scene_id, source, target FROM l1 WHERE rel_type = 'above' AND (source_label = 'vault' OR target_label = 'vault')")
def b6_relationship_filter(s, d):
    r = l1(s, d)
    return r.filter((F.col("rel_type") == "above") & ((F.col("source_label") == "vault") | (F.col("target_label") == "vault"))).select("scene_id", "source", "target")


@query(f"WITH {Q.L1} SELECT 'L1' AS layer, rel_type, count(*) AS n FROM l1 GROUP BY rel_type UNION ALL (WITH {Q.EVIDENCE} SELECT 'structural_evidence', rel_type, count(*) FROM evidence GROUP BY rel_type)")
def b8_b9_layers(s, d):
    a = l1(s, d).groupBy("rel_type").agg(F.count("*").alias("n")).withColumn("layer", F.lit("L1"))
    return a.unionByName(evidence(s, d).groupBy("rel_type").agg(F.count("*").alias("n")).withColumn("layer", F.lit("structural_evidence")))


@query(f"WITH {Q.MATCH} SELECT scene_id, obj_name, annotation_id, material_description AS material_text FROM matched WHERE obj_name IS NOT NULL AND {Q.any_of(Q.fold('material_description'), ['pietra', 'stone'])}")
def b11_material_search(s, d):
    return A.material_hits(matched(s, d), "stone").select("scene_id", "obj_name", "annotation_id", "material_text")


@query(f"WITH {Q.MATCH} SELECT scene_id, bool_or({Q.any_of(Q.fold('material_description'), ['laterizio', 'brick', 'mattoni'])}) AS has_brick_wall FROM matched WHERE obj_name IS NOT NULL AND obj_label = 'wall' AND material_description IS NOT NULL GROUP BY scene_id")
def b12_material_yes_no(s, d):
    m = matched(s, d).filter(F.col("obj_name").isNotNull() & (F.col("obj_label") == "wall") & F.col("material_description").isNotNull())
    return m.groupBy("scene_id").agg(F.bool_or(X.has_any(X.fold(F.col("material_description")), ["laterizio", "brick", "mattoni", "brick masonry"])).alias("has_brick_wall"))


_POSITION_SQL = "SELECT scene_id, semantic_label, '{0}' AS position, arg_min(obj_name, ({1}, obj_ord)) AS obj_name FROM objects GROUP BY ALL"


@query(" UNION ALL ".join(_POSITION_SQL.format(n, e) for n, e in (("left", "cx"), ("right", "-cx"), ("south", "cy"), ("north", "-cy"), ("bottom", "cz"), ("top", "-cz"))))
def b13_position_selector(s, d):
    o = objects(s, d)
    return R.union_all(*(A.by_position(o, w).withColumn("position", F.lit(w)) for w in ("left", "right", "south", "north", "bottom", "top")))


@query("WITH m AS (SELECT scene_id, semantic_label, avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz FROM objects GROUP BY ALL) SELECT scene_id, semantic_label, arg_min(obj_name, (sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my) + (cz - mz) * (cz - mz)), obj_ord)) AS obj_name FROM objects JOIN m USING (scene_id, semantic_label) GROUP BY ALL")
def b13_central(s, d):
    return A.by_position(objects(s, d), "central")


@query(f"""WITH {Q.MATCH}, a AS (SELECT DISTINCT scene_id, obj_name FROM matched WHERE obj_name IS NOT NULL),
    g AS (SELECT o.scene_id, o.semantic_label, count(*) AS n, min(o.obj_name) AS one, count(a.obj_name) AS na, min(a.obj_name) AS one_a FROM objects o LEFT JOIN a ON o.scene_id = a.scene_id AND o.obj_name = a.obj_name GROUP BY 1, 2)
    SELECT scene_id, semantic_label, n, CASE WHEN n = 1 THEN one WHEN na = 1 THEN one_a END AS obj_name FROM g""")
def b14_resolved_target(s, d):
    return A.resolve_target(objects(s, d), matched(s, d))


@query("SELECT s.scene_id, c.semantic_label FROM (SELECT DISTINCT scene_id FROM objects) s CROSS JOIN class_list c WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.scene_id = s.scene_id AND o.semantic_label = c.semantic_label)")
def b15_s2_absent_classes(s, d):
    from cloudmason.operators.grounding import absent_classes

    return absent_classes(objects(s, d))


@query(f"WITH {Q.COUNTS} SELECT scene_id, CASE WHEN n_column >= 4 AND n_roof + n_vault > 0 AND n_floor > 0 THEN 'covered_colonnaded_space' WHEN n_wall > 0 AND n_floor > 0 AND n_roof + n_vault > 0 THEN 'covered_interior' WHEN n_arch + n_vault > 0 THEN 'vaulted_or_arched_space' WHEN n_stairs > 0 THEN 'vertical_circulation_space' ELSE 'partial_scene' END AS typology FROM counts")
def b20_p20_typology(s, d):
    return S.typology(S.pivoted(objects(s, d)))


@query(f"WITH {Q.COUNTS} SELECT scene_id, CASE WHEN n_floor > 0 AND n_roof + n_vault > 0 AND n_wall >= 2 THEN 'interior_or_covered' WHEN n_floor > 0 AND n_roof + n_vault > 0 THEN 'semi_interior' WHEN n_wall > 0 AND n_floor > 0 THEN 'interior_or_facade' ELSE 'ambiguous' END AS reading FROM counts")
def b21_p4_inside_outside(s, d):
    return S.inside_outside(S.pivoted(objects(s, d)))


@query(f"WITH {Q.COUNTS} SELECT scene_id, CASE WHEN (n_wall > 0 OR n_door_window > 0) AND n_moldings > 0 THEN 'walls_openings_ornament' WHEN n_column > 0 AND (n_roof > 0 OR n_vault > 0) THEN 'covered_colonnade' ELSE 'semantic_summary' END AS reading FROM counts")
def b22_brief_inference(s, d):
    return S.brief(S.pivoted(objects(s, d)))


@query(f"WITH {Q.COUNTS} SELECT scene_id, n_door_window > 0 AND n_wall > 0 AS openings_and_walls, n_door_window AS n_openings, n_wall AS n_walls FROM counts")
def b23_opening_in_wall(s, d):
    return S.pivoted(objects(s, d)).select("scene_id", ((F.col("n_door_window") > 0) & (F.col("n_wall") > 0)).alias("openings_and_walls"), F.col("n_door_window").alias("n_openings"), F.col("n_wall").alias("n_walls"))


@query(f"SELECT semantic_label, {Q.ROLE} AS role, {Q.ROLE} = 'structural' AS load_bearing FROM class_list")
def b24_class_role(s, d):
    return class_rules(s).select("semantic_label", "role", (F.col("role") == "structural").alias("load_bearing"))


@query(f"WITH {Q.L1} SELECT scene_id, source, target, rel_type FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ord_a, ord_b, k) AS i FROM l1) WHERE i <= 30")
def b29_w10_limited_relations(s, d):
    return R.first_rows(l1(s, d), ["ord_a", "ord_b", "k"], 30).select("scene_id", "source", "target", "rel_type")


@query(f"WITH {Q.MATCH} SELECT annotation_id, obj_name, coalesce(material_description, typology, function) AS shown FROM matched WHERE obj_name IS NOT NULL")
def b30_selected_fields(s, d):
    return matched(s, d).filter(F.col("obj_name").isNotNull()).select("annotation_id", "obj_name", F.coalesce("material_description", "typology", "function").alias("shown"))


# ---- C: joins


@query(f"WITH {Q.L1} SELECT scene_id, source, target, rel_type, rel_level, source_label, target_label FROM l1")
def c1_c4_relationships(s, d):
    return l1(s, d).select("scene_id", "source", "target", "rel_type", "rel_level", "source_label", "target_label")


@query(f"WITH {Q.PAIRS}, n AS (SELECT scene_id, count(*) AS n FROM objects GROUP BY scene_id), m AS (SELECT scene_id, median(dist) AS m FROM pairs GROUP BY scene_id) SELECT n.scene_id, round(CASE WHEN m IS NULL THEN 3.0 ELSE greatest(m / 2.5, 0.5) END, 6) AS threshold FROM n LEFT JOIN m USING (scene_id)")
def c5_auto_threshold(s, d):
    return R.auto_threshold(objects(s, d)).select("scene_id", *r6("threshold"))


@query(f"WITH {Q.MATCH} SELECT annotation_id, label, method, reason, nearest_object, round(distance_m, 6) AS distance_m, obj_name FROM matched")
def c6_c7_annotation_match(s, d):
    return matched(s, d).select("annotation_id", "label", "method", "reason", "nearest_object", *r6("distance_m"), "obj_name")


@query(f"WITH {Q.EVIDENCE} SELECT scene_id, source, target, rel_type, rel_level FROM evidence")
def c8_c10_support_evidence(s, d):
    return evidence(s, d).select("scene_id", "source", "target", "rel_type", "rel_level")


@query(f"SELECT a.scene_id, a.obj_name AS object_a, b.obj_name AS object_b, round({Q.DIST}, 6) AS centroid_distance, round({Q.GAP}, 6) AS bbox_gap, round({Q.GAP_X}, 6) AS gap_x, round({Q.GAP_Y}, 6) AS gap_y, round({Q.GAP_Z}, 6) AS gap_z, round({Q.GAP_Z}, 6) AS vertical_gap, round({Q.RATIO}, 6) AS xy_overlap_ratio, {Q.GAP} = 0 AS touching_or_overlapping FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.obj_ord < b.obj_ord WHERE greatest({Q.GAP_X}, {Q.GAP_Y}) <= 1.0")
def c11_distance_metrics(s, d):
    pairs = R.meeting_pairs(objects(s, d), 1.0)
    gx, gy, _ = G.gaps("a", "b")
    m = R.distance_metrics(pairs.filter(F.greatest(gx, gy) <= 1.0))
    return m.select("scene_id", "object_a", "object_b", *r6("centroid_distance", "bbox_gap", "gap_x", "gap_y", "gap_z", "vertical_gap", "xy_overlap_ratio"), "touching_or_overlapping")


@query(f"""WITH r AS (SELECT a.scene_id, a.obj_name, b.obj_name AS neighbour, row_number() OVER (PARTITION BY a.scene_id, a.obj_ord ORDER BY {Q.GAP}, {Q.DIST}, b.obj_ord) AS rank, {Q.GAP} AS gap, {Q.DIST} AS distance
    FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.obj_ord <> b.obj_ord WHERE a.semantic_label = 'stairs')
    SELECT scene_id, obj_name, rank, neighbour, round(gap, 6) AS gap, round(distance, 6) AS distance FROM r WHERE rank <= 10""")
def c12_t17_nearest_objects(s, d):
    o = objects(s, d)
    return R.nearest_objects(o, o.filter(F.col("semantic_label") == "stairs")).select("scene_id", "obj_name", "rank", "neighbour", *r6("gap", "distance"))


@query(f"SELECT a.scene_id, round(min({Q.GAP_Z}), 6) AS gap FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.semantic_label = 'floor' AND b.semantic_label = 'vault' GROUP BY a.scene_id")
def c13_class_distance(s, d):
    return R.class_distance(objects(s, d), "floor", "vault", vertical=True).select("scene_id", *r6("gap"))


_MEET = " AND ".join(f"a.max_{x} >= b.min_{x} AND b.max_{x} >= a.min_{x}" for x in "xyz")


@query(f"WITH r AS (SELECT a.scene_id, a.obj_name AS object_a, b.obj_name AS object_b, row_number() OVER (PARTITION BY a.scene_id ORDER BY a.obj_name, b.obj_name) AS k FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.obj_name < b.obj_name WHERE {_MEET}) SELECT scene_id, object_a, object_b FROM r WHERE k <= 20")
def c14_p9_overlaps(s, d):
    return R.first_rows(R.overlapping(objects(s, d)), ["object_a", "object_b"], 20).select("scene_id", "object_a", "object_b")


@query(f"WITH {Q.L1} SELECT scene_id, source, target, rel_type FROM l1 WHERE (source_label = 'wall' AND target_label = 'vault') OR (source_label = 'vault' AND target_label = 'wall')")
def c15_s7_class_pair_relations(s, d):
    return l1(s, d).filter((F.least("source_label", "target_label") == "vault") & (F.greatest("source_label", "target_label") == "wall")).select("scene_id", "source", "target", "rel_type")


@query(f"WITH {Q.L1} SELECT scene_id, source, target, rel_type FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ord_a, ord_b, k) AS i FROM l1 WHERE source_label = 'roof' OR target_label = 'roof') WHERE i <= 120")
def c16_relations_of_class(s, d):
    r = l1(s, d).filter((F.col("source_label") == "roof") | (F.col("target_label") == "roof"))
    return R.first_rows(r, ["ord_a", "ord_b", "k"], 120).select("scene_id", "source", "target", "rel_type")


@query(f"WITH {Q.L1} SELECT DISTINCT scene_id, source, target, rel_type FROM l1 WHERE source_label = 'stairs' OR target_label = 'stairs'")
def c17_t6_find_relationships(s, d):
    o = objects(s, d).filter(F.col("semantic_label") == "stairs").select("scene_id", "obj_name")
    r = l1(s, d)
    either = r.join(o.withColumnRenamed("obj_name", "source"), ["scene_id", "source"], "left_semi").unionByName(r.join(o.withColumnRenamed("obj_name", "target"), ["scene_id", "target"], "left_semi"))
    return either.select("scene_id", "source", "target", "rel_type").distinct()


@query(f"WITH {Q.EVIDENCE} SELECT scene_id, count(*) AS n FROM evidence WHERE rel_type = 'supports' AND source_label = 'column' AND target_label = 'vault' GROUP BY scene_id")
def c18_support_between(s, d):
    return evidence(s, d).filter((F.col("rel_type") == "supports") & (F.col("source_label") == "column") & (F.col("target_label") == "vault")).groupBy("scene_id").agg(F.count("*").alias("n"))


@query(f"WITH {Q.EVIDENCE} SELECT scene_id, source_label, target_label, count(*) AS n FROM evidence WHERE rel_type = 'supports' GROUP BY ALL")
def c19_open_support(s, d):
    return evidence(s, d).filter(F.col("rel_type") == "supports").groupBy("scene_id", "source_label", "target_label").agg(F.count("*").alias("n"))


@query(f"WITH {Q.MATCH} SELECT o.scene_id, o.obj_name, o.semantic_label, round({Q.VOLUME}, 6) AS volume, {Q.ROLE} AS element_type, n.n AS n_annotations FROM objects o LEFT JOIN (SELECT scene_id, obj_name, count(*) AS n FROM matched WHERE obj_name IS NOT NULL GROUP BY ALL) n USING (scene_id, obj_name)")
def c20_graph_nodes(s, d):
    n = matched(s, d).filter(F.col("obj_name").isNotNull()).groupBy("scene_id", "obj_name").agg(F.count("*").alias("n_annotations"))
    return S.object_features(objects(s, d)).join(n, ["scene_id", "obj_name"], "left").select("scene_id", "obj_name", "semantic_label", *r6("volume"), "element_type", "n_annotations")


# ---- D: aggregates


@query(f"SELECT scene_id, obj_name, round({Q.VOLUME}, 6) AS volume, round(max_z - min_z, 6) AS height, round(CASE WHEN {Q.VOLUME} = 0 THEN 0 ELSE point_count / ({Q.VOLUME}) END, 6) AS point_density, {Q.ROLE} AS element_type FROM objects")
def d2_d6_object_features(s, d):
    return S.object_features(objects(s, d)).select("scene_id", "obj_name", *r6("volume", "height", "point_density"), "element_type")


@query(f"""WITH f AS (SELECT scene_id, arg_max(obj_name, ({Q.AREA}, -obj_ord)) AS floor_object, arg_max(max_z, ({Q.AREA}, -obj_ord)) AS lower_z, max({Q.AREA}) AS floor_area FROM objects WHERE semantic_label = 'floor' GROUP BY scene_id),
    e AS (SELECT scene_id, max(max_z) AS upper_z FROM objects WHERE semantic_label IN ('wall', 'column', 'roof', 'vault') GROUP BY scene_id)
    SELECT scene_id, floor_object, round(floor_area, 6) AS floor_area, round(greatest(0.0, upper_z - lower_z), 6) AS height, round(floor_area * greatest(0.0, upper_z - lower_z), 6) AS volume FROM f JOIN e USING (scene_id)""")
def d7_t15_room_volume(s, d):
    return S.room_volume(objects(s, d)).select("scene_id", "floor_object", *r6("floor_area", "height", "volume"))


@query(f"WITH {Q.NAMED} SELECT scene_id, count(*) AS n_points, round(min(x), 6) AS min_x, round(max(z), 6) AS max_z, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS xy_area, round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 6) AS volume FROM named WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY scene_id")
def d8_t13_point_cloud_info(s, d):
    return P.cloud_info(points(s, d)).select("scene_id", "n_points", *r6("min_x", "max_z", "xy_area", "volume"))


@query("SELECT scene_id, count(*) AS n_objects, round((min(min_x) + max(max_x)) / 2, 6) AS centre_x, round((max(max_x) - min(min_x)) * (max(max_y) - min(min_y)) * (max(max_z) - min(min_z)), 6) AS volume FROM objects GROUP BY scene_id")
def d9_scene_box(s, d):
    return S.scene_box(objects(s, d)).select("scene_id", "n_objects", *r6("centre_x", "volume"))


@query(f"SELECT scene_id, semantic_label, round(sum({Q.AREA}), 6) AS area, arg_max(obj_name, ({Q.AREA}, -obj_ord)) AS largest FROM objects GROUP BY ALL")
def d10_t14_occupied_area(s, d):
    return objects(s, d).groupBy("scene_id", "semantic_label").agg(F.round(F.sum(G.xy_area()), 6).alias("area"), F.max_by("obj_name", F.struct(G.xy_area().alias("a"), -F.col("obj_ord"))).alias("largest"))


@query("SELECT scene_id, semantic_label, count(*) AS n FROM objects GROUP BY ALL")
def d11_t1_t2_class_counts(s, d):
    return S.class_counts(objects(s, d))


@query(f"SELECT scene_id, 'role' AS part, {Q.ROLE} AS name, count(*)::DOUBLE AS value FROM objects GROUP BY ALL UNION ALL SELECT scene_id, 'class', semantic_label, count(*) FROM objects GROUP BY ALL UNION ALL SELECT scene_id, 'room_volume', floor_object, volume FROM (" + SQL["d7_t15_room_volume"] + ")")
def d13_roles_classes_volume(s, d):
    o = objects(s, d)
    part = lambda n, name, value: d_.select("scene_id", F.lit(n).alias("part"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    d_ = R.with_roles(S.class_counts(o)).groupBy("scene_id", "role").agg(F.sum("n").alias("n"))
    found = [part("role", "role", "n")]
    d_ = S.class_counts(o)
    found.append(part("class", "semantic_label", "n"))
    d_ = S.room_volume(o).withColumn("volume", F.round("volume", 6))
    return R.union_all(*found, part("room_volume", "floor_object", "volume"))


@query(f"SELECT scene_id, {Q.ROLE} AS role, count(*) AS n FROM objects GROUP BY ALL")
def d12_role_counts(s, d):
    return R.with_roles(S.class_counts(objects(s, d))).groupBy("scene_id", "role").agg(F.sum("n").alias("n"))


@query(f"""WITH {Q.EDGES}, e AS (SELECT scene_id, count(*) AS n_edges FROM edges GROUP BY scene_id)
    SELECT o.scene_id, count(*) AS n_objects, count(DISTINCT semantic_label) AS n_classes, 10 - count(DISTINCT semantic_label) AS n_absent, coalesce(any_value(e.n_edges), 0) AS n_edges, round(2.0 * coalesce(any_value(e.n_edges), 0) / count(*), 6) AS avg_degree FROM objects o LEFT JOIN e USING (scene_id) GROUP BY o.scene_id""")
def d13_t12_scene_statistics(s, d):
    o = objects(s, d)
    e = S.edges(l1(s, d)).groupBy("scene_id").agg(F.count("*").alias("n_edges"))
    n = o.groupBy("scene_id").agg(F.count("*").alias("n_objects"), F.count_distinct("semantic_label").alias("n_classes")).join(e, "scene_id", "left").fillna(0, ["n_edges"])
    return n.select("scene_id", "n_objects", "n_classes", (10 - F.col("n_classes")).alias("n_absent"), "n_edges", F.round(2.0 * F.col("n_edges") / F.col("n_objects"), 6).alias("avg_degree"))


@query(f"""WITH RECURSIVE {Q.L1}, link AS (SELECT DISTINCT l.scene_id, a.object_id AS u, b.object_id AS v FROM l1 l JOIN objects a ON a.scene_id = l.scene_id AND a.obj_name = l.source JOIN objects b ON b.scene_id = l.scene_id AND b.obj_name = l.target),
    reach AS (SELECT object_id AS u, object_id AS v FROM objects UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
    head AS (SELECT u, min(v) AS head FROM reach GROUP BY u)
    SELECT o.scene_id, count(DISTINCT head) AS n_components FROM objects o JOIN head ON head.u = o.object_id GROUP BY o.scene_id""")
def d14_g2_components(s, d):
    o = objects(s, d)
    return S.components_of(o, l1(s, d)).groupBy("scene_id").agg(F.count_distinct("head").alias("n_components"))


@query(f"WITH {Q.L1} SELECT scene_id, rel_type, count(*) AS n FROM l1 GROUP BY ALL")
def q_evident_relations(s, d):
    return l1(s, d).groupBy("scene_id", "rel_type").agg(F.count("*").alias("n"))


@query(f"WITH {Q.L1} SELECT rel_level, rel_type, count(*) AS n FROM l1 GROUP BY ALL")
def d15_p16_relation_types(s, d):
    return l1(s, d).groupBy("rel_level", "rel_type").agg(F.count("*").alias("n"))


_DIRECTED = "SELECT scene_id, source_label AS semantic_label, rel_type, 'out' AS direction, target_label AS other_label, source, target, ord_a, ord_b, k FROM l1 UNION ALL SELECT scene_id, target_label, rel_type, 'in', source_label, source, target, ord_a, ord_b, k FROM l1"


@query(f"WITH {Q.L1}, u AS ({_DIRECTED}), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, semantic_label, rel_type, direction, other_label ORDER BY ord_a, ord_b, k) AS i FROM u WHERE semantic_label <> other_label) SELECT scene_id, semantic_label, rel_type, direction, other_label, count(*) AS n, string_agg(source || ' -> ' || target, '; ' ORDER BY i) FILTER (i <= 3) AS examples FROM r GROUP BY ALL")
def d16_w4_class_relation_summary(s, d):
    return R.class_relation_summary(l1(s, d)).drop("rel_level")


@query(f"WITH {Q.L1}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, rel_type, source_label, target_label ORDER BY ord_a, ord_b, k) AS i FROM l1) SELECT scene_id, rel_type, source_label, target_label, count(*) AS n, string_agg(source || ' -> ' || target, '; ' ORDER BY i) FILTER (i <= 3) AS examples FROM r GROUP BY ALL")
def d17_class_pair_summary(s, d):
    return R.pair_relation_summary(l1(s, d)).drop("rel_level")


def _collapsed(c: str) -> str:
    return f"(SELECT scene_id, obj_name, string_agg(v, '; ' ORDER BY o) AS {c} FROM (SELECT scene_id, obj_name, {c} AS v, min(annotation_id) AS o FROM matched WHERE obj_name IS NOT NULL AND {c} IS NOT NULL GROUP BY scene_id, obj_name, {c}) GROUP BY scene_id, obj_name)"


@query(f"WITH {Q.MATCH} SELECT b.scene_id, b.obj_name, t.typology, f.function, x.description FROM (SELECT DISTINCT scene_id, obj_name FROM matched WHERE obj_name IS NOT NULL) b LEFT JOIN {_collapsed('typology')} t USING (scene_id, obj_name) LEFT JOIN {_collapsed('function')} f USING (scene_id, obj_name) LEFT JOIN {_collapsed('description')} x USING (scene_id, obj_name)")
def d18_collapsed_attributes(s, d):
    return A.node_attributes(matched(s, d))


@query(f"WITH {Q.EDGES} SELECT scene_id, source, target, relationship FROM edges")
def d19_collapsed_edges(s, d):
    return S.edges(l1(s, d)).select("scene_id", "source", "target", "relationship")


@query("SELECT scene_id, arg_max(obj_name, (point_count, -obj_ord)) AS obj_name, max(point_count) AS point_count, round(100.0 * max(point_count) / sum(point_count), 6) AS pct FROM objects WHERE point_count IS NOT NULL GROUP BY scene_id")
def d20_dominant_by_points(s, d):
    return objects(s, d).filter(F.col("point_count").isNotNull()).groupBy("scene_id").agg(F.max_by("obj_name", F.struct("point_count", -F.col("obj_ord"))).alias("obj_name"), F.round(100.0 * F.max("point_count") / F.sum("point_count"), 6).alias("pct"), F.max("point_count").alias("point_count"))


def _vote(metric: str) -> str:
    return f"SELECT scene_id, obj_name, 5 - (1 + row_number() OVER (PARTITION BY scene_id ORDER BY coalesce({metric}, 0) DESC, obj_ord)) AS v FROM m"


@query(f"""WITH {Q.L1}, e AS (SELECT scene_id, source AS obj_name FROM l1 UNION ALL SELECT scene_id, target FROM l1), g AS (SELECT scene_id, obj_name, count(*) AS degree FROM e GROUP BY ALL),
    m AS (SELECT o.*, {Q.VOLUME} AS volume, g.degree FROM objects o LEFT JOIN g USING (scene_id, obj_name)), v AS ({_vote('point_count')} UNION ALL {_vote('volume')} UNION ALL {_vote('degree')}),
    t AS (SELECT scene_id, obj_name, sum(v)::BIGINT AS votes FROM v WHERE v >= 1 GROUP BY ALL) SELECT scene_id, obj_name, votes FROM t WHERE votes >= 4 QUALIFY votes = max(votes) OVER (PARTITION BY scene_id)""")
def d21_p2_dominant_by_votes(s, d):
    o = objects(s, d)
    return S.dominant(o, R.relationships(o))


@query(f"WITH {Q.L1}, e AS (SELECT scene_id, source AS obj_name FROM l1 UNION ALL SELECT scene_id, target FROM l1) SELECT o.scene_id, o.obj_name, count(e.obj_name) AS degree FROM objects o LEFT JOIN e ON o.scene_id = e.scene_id AND o.obj_name = e.obj_name GROUP BY 1, 2")
def d22_relational_degree(s, d):
    o = objects(s, d)
    return S.relational_degree(o, R.relationships(o)).select("scene_id", "obj_name", "degree")


@query(f"WITH {Q.MATCH} SELECT scene_id, count(obj_name) AS matched_rows, count(DISTINCT obj_name) AS annotated_objects, count(*) - count(obj_name) AS unmatched_rows FROM matched GROUP BY scene_id")
def d23_annotation_summary(s, d):
    return matched(s, d).groupBy("scene_id").agg(F.count("obj_name").alias("matched_rows"), F.count_distinct("obj_name").alias("annotated_objects"), (F.count("*") - F.count("obj_name")).alias("unmatched_rows"))


@query("SELECT scene_id, semantic_label, count(*) AS n, string_agg(obj_name, ', ' ORDER BY obj_ord) AS names, sum(point_count)::BIGINT AS n_points FROM objects GROUP BY ALL")
def d24_t3_object_inventory(s, d):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obj_ord", "obj_name"))), lambda x: x["obj_name"]), ", ")
    return objects(s, d).groupBy("scene_id", "semantic_label").agg(F.count("*").alias("n"), names.alias("names"), F.sum("point_count").alias("n_points"))


@query(f"WITH {Q.MATCH}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, obj_label ORDER BY annotation_id) AS k FROM matched WHERE obj_name IS NOT NULL) SELECT scene_id, obj_label, annotation_id, obj_name FROM r WHERE k <= 12")
def d25_annotation_inventory(s, d):
    m = matched(s, d).filter(F.col("obj_name").isNotNull())
    return R.first_rows(m, ["annotation_id"], 12, ("scene_id", "obj_label")).select("scene_id", "obj_label", "annotation_id", "obj_name")


@query(f"WITH {Q.L1}, r AS (SELECT scene_id, count(*) AS n FROM l1 GROUP BY scene_id) SELECT o.scene_id, count(*) AS n_objects, count(DISTINCT semantic_label) AS n_classes, coalesce(any_value(r.n), 0) AS n_l1 FROM objects o LEFT JOIN r USING (scene_id) GROUP BY o.scene_id")
def d27_d28_scene_brief(s, d):
    o = objects(s, d)
    r = R.relationships(o).groupBy("scene_id").agg(F.count("*").alias("n_l1"))
    return o.groupBy("scene_id").agg(F.count("*").alias("n_objects"), F.count_distinct("semantic_label").alias("n_classes")).join(r, "scene_id", "left").fillna(0, ["n_l1"])


@query(f"SELECT scene_id, {Q.ROLE} AS role, string_agg(obj_name, ', ' ORDER BY obj_name) AS names FROM objects GROUP BY ALL")
def d29_names_by_role(s, d):
    return R.with_roles(objects(s, d)).groupBy("scene_id", "role").agg(F.array_join(F.array_sort(F.collect_list("obj_name")), ", ").alias("names"))


# ---- G: clusters and graphs


@query()
def g1_d1_clustered_objects(s, d):
    p = points(s, d)
    return P.objects_of(p, P.dbscan(p)).select("scene_id", "obj_name", "point_count", *r6("cx", "cy", "cz", "min_x", "max_x"))


@query()
def d3_d5_surface_area(s, d):
    p = points(s, d)
    c = P.dbscan(p)
    o = P.objects_of(p, c).withColumn("volume", G.volume())
    return P.surface_areas(p, c).join(o, ["scene_id", "obj_name"]).select("scene_id", "obj_name", *r6("surface_area", "volume"), F.round(S.compactness(F.col("surface_area"), F.col("volume")), 6).alias("compactness"))


@query(f"WITH {Q.EDGES}, e AS (SELECT scene_id, source AS obj_name FROM edges UNION ALL SELECT scene_id, target FROM edges), n AS (SELECT scene_id, count(*) AS n FROM objects GROUP BY scene_id), r AS (SELECT o.scene_id, o.obj_name, o.obj_ord, CASE WHEN any_value(n.n) <= 1 THEN 1.0 ELSE count(e.obj_name) / (any_value(n.n) - 1) END AS c FROM objects o JOIN n USING (scene_id) LEFT JOIN e ON e.scene_id = o.scene_id AND e.obj_name = o.obj_name GROUP BY ALL) SELECT scene_id, obj_name, round(c, 6) AS centrality FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY c DESC, obj_ord) AS k FROM r) WHERE k <= 5")
def g3_t18_focal_points(s, d):
    o = objects(s, d)
    c = S.centrality(o, S.edges(R.relationships(o)))
    return R.first_rows(c, [F.desc("centrality"), "obj_ord"], 5).select("scene_id", "obj_name", *r6("centrality"))


@query(f"""WITH {Q.L1}, {Q.EVIDENCE.removeprefix('WITH ')}, u AS (SELECT scene_id, source, target, rel_type FROM l1 UNION SELECT scene_id, source, target, rel_type FROM evidence)
    SELECT scene_id, count(*) AS n_relations, count(DISTINCT (source, target)) AS n_edges FROM u GROUP BY scene_id""")
def g4_s1_combined_graph(s, d):
    c = ["scene_id", "source", "target", "rel_type"]
    u = l1(s, d).select(c).unionByName(evidence(s, d).select(c)).distinct()
    return u.groupBy("scene_id").agg(F.count("*").alias("n_relations"), F.count_distinct("source", "target").alias("n_edges"))


@query(f"""WITH RECURSIVE {Q.L1}, link AS (SELECT DISTINCT l.scene_id, a.object_id AS u, b.object_id AS v FROM l1 l JOIN objects a ON a.scene_id = l.scene_id AND a.obj_name = l.source JOIN objects b ON b.scene_id = l.scene_id AND b.obj_name = l.target),
    reach AS (SELECT object_id AS u, object_id AS v FROM objects UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
    head AS (SELECT u, min(v) AS head FROM reach GROUP BY u),
    g AS (SELECT o.scene_id, head AS first_object_id, count(*) AS n_objects, list_sort(list(DISTINCT semantic_label)) AS ls FROM objects o JOIN head ON head.u = o.object_id GROUP BY ALL)
    SELECT scene_id, first_object_id, n_objects, array_to_string(ls, ',') AS labels, CASE WHEN list_has_any(ls, ['vault', 'arch', 'column']) THEN 'vaulted_space' WHEN list_contains(ls, 'stairs') THEN 'vertical_circulation' WHEN list_has_any(ls, ['door_window', 'wall']) THEN 'facade_zone' WHEN list_has_any(ls, ['floor', 'wall']) THEN 'floor_zone' WHEN len(list_filter(ls, lambda x: x NOT IN ({Q.quoted(V.STRUCTURAL)}))) = 0 THEN 'structural_zone' ELSE 'general_area' END AS area_type FROM g""")
def g5_b19_t20_functional_areas(s, d):
    o = objects(s, d)
    return S.functional_areas(S.components_of(o, R.relationships(o)))


@query(f"WITH {Q.L1} SELECT scene_id, least(source, target) AS node_a, greatest(source, target) AS node_b, string_agg(DISTINCT rel_type, ', ' ORDER BY rel_type) AS types FROM l1 GROUP BY ALL")
def g6_undirected_edges(s, d):
    return S.undirected_edges(S.edges(l1(s, d)))


@query("SELECT scene_id, obj_name, cx AS x, cy AS y FROM objects")
def g7_positions(s, d):
    return objects(s, d).select("scene_id", "obj_name", F.col("cx").alias("x"), F.col("cy").alias("y"))


@query()
def g8_p6_outer_columns(s, d):
    return S.outer_columns(objects(s, d))


_ALL_REL = "SELECT scene_id, source, target, rel_type, source_label, target_label FROM l1 UNION ALL SELECT scene_id, source, target, rel_type, source_label, target_label FROM evidence"


@query(f"WITH {Q.L1}, {Q.EVIDENCE}, r AS (SELECT DISTINCT * FROM ({_ALL_REL})) SELECT a.scene_id, a.source, a.target, a.rel_type, 'reciprocal' AS issue FROM r a JOIN r b ON a.scene_id = b.scene_id AND a.source = b.target AND a.target = b.source AND a.rel_type = b.rel_type WHERE a.rel_type IN ('above', 'below', 'supports', 'rests_on') AND a.source < a.target")
def g9_g10_t11_anomalies(s, d):
    c = ["scene_id", "source", "target", "rel_type", "source_label", "target_label"]
    return R.anomalies(l1(s, d).select(c).unionByName(evidence(s, d).select(c)), suspicious=True)


@query(f"WITH {Q.L1}, w AS (SELECT scene_id, obj_name FROM objects WHERE semantic_label = 'stairs') SELECT DISTINCT l.scene_id, l.target AS obj_name FROM l1 l JOIN w ON l.scene_id = w.scene_id AND l.source = w.obj_name UNION SELECT l.scene_id, l.source FROM l1 l JOIN w ON l.scene_id = w.scene_id AND l.target = w.obj_name")
def g11_neighbours(s, d):
    r = l1(s, d).select("scene_id", "source", "target", "source_label", "target_label")
    return r.filter(F.col("source_label") == "stairs").select("scene_id", F.col("target").alias("obj_name")).unionByName(r.filter(F.col("target_label") == "stairs").select("scene_id", F.col("source").alias("obj_name"))).distinct()


@query(f"WITH {Q.EDGES}, n AS (SELECT scene_id, obj_name FROM objects WHERE semantic_label IN ('wall', 'column')) SELECT e.scene_id, e.source, e.target, e.relationship FROM edges e JOIN n a ON e.scene_id = a.scene_id AND e.source = a.obj_name JOIN n b ON e.scene_id = b.scene_id AND e.target = b.obj_name WHERE contains(e.relationship, 'adjacent_to')")
def b16_b17_filtered_graph(s, d):
    n = objects(s, d).filter(F.lower("semantic_label").isin("wall", "column")).select("scene_id", "obj_name")
    e = S.edges(l1(s, d)).filter(F.exists("relations", lambda r: r["type"] == "adjacent_to"))
    return e.join(n.withColumnRenamed("obj_name", "source"), ["scene_id", "source"], "left_semi").join(n.withColumnRenamed("obj_name", "target"), ["scene_id", "target"], "left_semi").select("scene_id", "source", "target", "relationship")


# ---- W, S: ranks and sets


@query(f"WITH {Q.L1}, {Q.EVIDENCE}, u AS (SELECT scene_id, 1 AS layer_ord, ord_a, ord_b, k, source, target, rel_type FROM l1 UNION ALL SELECT scene_id, 2, 0, 0, 0, source, target, rel_type FROM evidence), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY layer_ord, ord_a, ord_b, k, source, target, rel_type) AS i, count(*) OVER (PARTITION BY scene_id) AS n FROM u) SELECT scene_id, layer_ord, count(*) AS shown, any_value(n) - least(any_value(n), 30) AS hidden FROM r WHERE i <= 30 GROUP BY scene_id, layer_ord")
def w5_t10_row_budget(s, d):
    a = l1(s, d).select("scene_id", F.lit(1).alias("layer_ord"), "ord_a", "ord_b", "k", "source", "target", "rel_type")
    b = evidence(s, d).select("scene_id", F.lit(2).alias("layer_ord"), F.lit(0).alias("ord_a"), F.lit(0).alias("ord_b"), F.lit(0).alias("k"), "source", "target", "rel_type")
    return R.shown_counts(a.unionByName(b), ["layer_ord", "ord_a", "ord_b", "k", "source", "target", "rel_type"], 30, ["layer_ord"])


@query("SELECT scene_id, obj_name, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(point_count, 0) DESC, obj_ord) AS k FROM objects) WHERE k <= 5")
def w6_p3_top_objects(s, d):
    return R.first_rows(objects(s, d), [F.coalesce("point_count", F.lit(0)).desc(), "obj_ord"], 5).select("scene_id", "obj_name", F.col("shown_rank").alias("rank"))


@query("SELECT scene_id, obj_name, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(point_count, 0), obj_ord) AS k FROM objects) WHERE k <= 8")
def w7_p17_low_point_objects(s, d):
    return R.first_rows(objects(s, d), [F.coalesce("point_count", F.lit(0)).asc(), "obj_ord"], 8).select("scene_id", "obj_name", F.col("shown_rank").alias("rank"))


@query(f"SELECT scene_id, arg_max(obj_name, (coalesce(point_count, 0), -obj_ord)) AS most_points, arg_max(obj_name, ({Q.VOLUME}, -obj_ord)) AS most_volume FROM objects GROUP BY scene_id")
def w8_top_objects(s, d):
    return objects(s, d).groupBy("scene_id").agg(F.max_by("obj_name", F.struct(F.coalesce("point_count", F.lit(0)), -F.col("obj_ord"))).alias("most_points"), F.max_by("obj_name", F.struct(G.volume(), -F.col("obj_ord"))).alias("most_volume"))


@query()
def w8_least_compact(s, d):
    """Of the objects clustered from points, the one of lowest compactness (by hull area) in each scene; ties by order."""
    p = points(s, d)
    c = P.dbscan(p)
    o = P.objects_of(p, c).withColumn("volume", G.volume())
    f = P.surface_areas(p, c).join(o, ["scene_id", "obj_name"]).withColumn("compactness", S.compactness(F.col("surface_area"), F.col("volume")))
    best = F.min(F.struct("compactness", "cluster_id", "obj_name")).alias("b")
    return f.groupBy("scene_id").agg(best).select("scene_id", F.col("b.obj_name").alias("obj_name"), F.round("b.compactness", 6).alias("compactness"))


@query("SELECT scene_id, semantic_label, n FROM (SELECT scene_id, semantic_label, count(*) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, semantic_label) AS k FROM objects GROUP BY scene_id, semantic_label) WHERE k <= 5")
def w9_common_classes(s, d):
    return R.first_rows(S.class_counts(objects(s, d)), [F.desc("n"), "semantic_label"], 5).select("scene_id", "semantic_label", "n")


@query(f"WITH {Q.L1} SELECT scene_id, least(source, target) AS object_a, greatest(source, target) AS object_b FROM l1 WHERE rel_type = 'adjacent_to' GROUP BY ALL")
def w12_p7_adjacencies(s, d):
    return R.undirected(l1(s, d).filter(F.col("rel_type") == "adjacent_to")).select("scene_id", F.least("source", "target").alias("object_a"), F.greatest("source", "target").alias("object_b"))


@query(f"WITH {Q.MATCH} SELECT scene_id, obj_name FROM objects o WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.scene_id = o.scene_id AND m.obj_name = o.obj_name)")
def s3_unannotated_objects(s, d):
    m = matched(s, d).filter(F.col("obj_name").isNotNull()).select("scene_id", "obj_name")
    return objects(s, d).join(m, ["scene_id", "obj_name"], "left_anti").select("scene_id", "obj_name")


@query()
def s6_inner_columns(s, d):
    o = objects(s, d)
    return o.filter(F.col("semantic_label") == "column").join(S.outer_columns(o), ["scene_id", "obj_name"], "left_anti").select("scene_id", "obj_name")


# ---- P, T: composed answers not covered by a query above


@query(f"WITH {Q.L1} SELECT scene_id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ord_a, ord_b) AS i FROM l1 WHERE rel_type = 'above') WHERE i <= 20")
def p_8_b10_above(s, d):
    return R.first_rows(l1(s, d).filter(F.col("rel_type") == "above"), ["ord_a", "ord_b"], 20).select("scene_id", "source", "target")


@query("SELECT scene_id, obj_name, round(cx, 6) AS cx, round((min_x + max_x) / 2, 6) AS centre_x, round(max_x - min_x, 6) AS size_x, round(max_z - min_z, 6) AS size_z FROM objects")
def t4_r3_f20_geometry(s, d):
    return objects(s, d).select("scene_id", "obj_name", *r6("cx"), F.round(G.box_centre("x"), 6).alias("centre_x"), F.round(G.box_size("x"), 6).alias("size_x"), F.round(G.box_size("z"), 6).alias("size_z"))


@query(f"WITH {Q.MATCH} SELECT m.scene_id, m.obj_name, m.annotation_id, m.typology, m.function, round(m.distance_m, 6) AS distance_m FROM matched m WHERE m.obj_name IS NOT NULL")
def t5_t7_t9_object_details(s, d):
    return matched(s, d).filter(F.col("obj_name").isNotNull()).select("scene_id", "obj_name", "annotation_id", "typology", "function", *r6("distance_m"))


@query(f"WITH {Q.L1} SELECT 'objects' AS part, scene_id, count(*) AS n FROM objects WHERE semantic_label = 'arch' GROUP BY scene_id UNION ALL SELECT 'relations', scene_id, count(*) FROM l1 WHERE rel_type = 'near' GROUP BY scene_id")
def t19_find_pattern(s, d):
    a = objects(s, d).filter(F.col("semantic_label") == "arch").groupBy("scene_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("objects"))
    return a.unionByName(l1(s, d).filter(F.col("rel_type") == "near").groupBy("scene_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("relations")))


@query()
def t21_reloaded_scene(s, d):
    """The pipeline with other parameters: clusters, objects, relations."""
    p = points(s, d)
    o = P.objects_of(p, P.dbscan(p, eps=0.6, least=20)).withColumn("obj_ord", F.col("cluster_id") * len(V.CLASSES) + F.array_position(F.array(*map(F.lit, V.CLASSES)), F.col("semantic_label")) - 1)
    return R.relationships(o, 2.0).groupBy("scene_id", "rel_type").agg(F.count("*").alias("n"))


_LISTS = " UNION ALL ".join(f"SELECT scene_id, '{a}' AS answer, '{sec}' AS section, count(*) AS n, string_agg(obj_name, ', ' ORDER BY obj_name) AS names FROM objects WHERE semantic_label IN ({Q.quoted(cs)}) GROUP BY scene_id" for a, sec, cs in N.SECTIONS)


@query(_LISTS)
def answers_p5_p11_p15_lists(s, d):
    return N.object_lists(objects(s, d))


@query(f"WITH {Q.L1}, {Q.EVIDENCE}, a AS (SELECT scene_id, count(*) AS n FROM l1 GROUP BY scene_id), b AS (SELECT scene_id, count(*) AS n FROM evidence GROUP BY scene_id) SELECT o.scene_id, coalesce(a.n, 0) AS n_l1, coalesce(b.n, 0) AS n_evidence, CASE WHEN coalesce(b.n, 0) > 0 THEN 'geometry_and_structural_evidence' WHEN coalesce(a.n, 0) > 0 THEN 'geometry_without_structural_evidence' ELSE 'no_relations' END AS reading FROM (SELECT DISTINCT scene_id FROM objects) o LEFT JOIN a USING (scene_id) LEFT JOIN b USING (scene_id)")
def answers_p17_p19_layers(s, d):
    return N.layer_sizes(objects(s, d), l1(s, d), evidence(s, d))


@query(f"WITH {Q.COUNTS}, t AS (SELECT scene_id, CASE WHEN n_column >= 4 AND n_roof + n_vault > 0 AND n_floor > 0 THEN 'covered_colonnaded_space' WHEN n_wall > 0 AND n_floor > 0 AND n_roof + n_vault > 0 THEN 'covered_interior' WHEN n_arch + n_vault > 0 THEN 'vaulted_or_arched_space' WHEN n_stairs > 0 THEN 'vertical_circulation_space' ELSE 'partial_scene' END AS typology FROM counts) SELECT scene_id, count(*) AS n_objects, count(DISTINCT semantic_label) AS n_classes, count(DISTINCT {Q.ROLE}) AS n_roles, arg_max(obj_name, (coalesce(point_count, 0), -obj_ord)) AS most_sampled, any_value(typology) AS typology FROM objects JOIN t USING (scene_id) GROUP BY scene_id")
def answers_p1_summary(s, d):
    return N.scene_summary(objects(s, d))


@query()
def answers_p6_columns(s, d):
    return N.organising(objects(s, d))


@query(f"WITH {Q.EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, rel_type ORDER BY source, target) AS k FROM evidence) SELECT scene_id, rel_type, source, target FROM r WHERE k <= 20")
def answers_p10_supports(s, d):
    return R.first_rows(evidence(s, d), ["source", "target"], 20, ("scene_id", "rel_type")).select("scene_id", "rel_type", "source", "target")


@query()
def p_18_observation_check(s, d):
    """The fixed answer to the question whether observation and inference are kept apart, for every scene."""
    return N.observation_check(objects(s, d))


@query()
def a13_h19_graph_of_context(s, d):
    """The ontology graph of the annotations matched to objects: edges by predicate."""
    from cloudmason.context import SceneContext

    edges = SceneContext(objects(s, d), annotations=table(s, d, "annotations")).ontology_graph()[1]
    return edges.groupBy("scene_id", "predicate").agg(F.count("*").alias("n"))


@query(f"WITH {Q.MATCH} SELECT m.annotation_id AS row_id, m.scene_id, m.obj_name AS object_name, coalesce(m.label, o.semantic_label) AS semantic_label FROM matched m JOIN objects o ON o.scene_id = m.scene_id AND o.obj_name = m.obj_name")
def a13_context_rows(s, d):
    from cloudmason.context import SceneContext

    return SceneContext(objects(s, d), annotations=table(s, d, "annotations")).ontology_rows().select("row_id", "scene_id", "object_name", "semantic_label")
