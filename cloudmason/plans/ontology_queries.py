"""Queries of the ontology graph over the catalogue, with SQL for the same results.

Spatial relations are the catalogue's own: elements whose centres lie within 3 m. Scene evidence is read as given for every
scene that has an annotation file. Contextual rows tie each scene's first opening to its first wall, measurements give
the height of each object to the element of the same class and place in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmason.functions import vocabulary as V
from cloudmason.operators import ontology as H
from cloudmason.operators.spatial_join import near_pairs
from cloudmason.plans import sql_parts as Q
from cloudmason.plans.scene_queries import table
from cloudmason.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def elements(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "catalogue").select(F.col("record_id").alias("row_id"), "scene_id", "class_semantic_label", "semantic_label", "x", "y", "z", "material", "typology", "function", "description", "position")
    return cut(H.elements(c))


def relations(s: SparkSession, d: str) -> DataFrame:
    e = elements(s, d)
    near = near_pairs(e.select(F.col("scene_id").alias("grp"), F.col("row_id").alias("id"), "x", "y", "z"), 3.0)
    name = lambda p: e.select(F.col("row_id").alias(f"{p}_id"), F.col("node_id").alias(p))
    n = near.join(name("left"), "left_id").join(name("right"), "right_id")
    return n.select(F.col("grp").alias("scene_id"), F.col("left").alias("source"), F.col("right").alias("target"), F.lit("near").alias("rel_type"))


def scene_evidence(s: SparkSession, d: str) -> DataFrame:
    sc = table(s, d, "scenes").filter(F.col("annotation_csv").isNotNull()).select("scene_id")
    fields = [F.lit("yes").alias(f) for f in dict.fromkeys([*V.PORTICO_FIELDS, *V.LOGGIA_FIELDS])]
    return sc.select("scene_id", F.explode(F.array(F.lit("porticato"), F.lit("loggiato"))).alias("rule"), *fields).withColumn("evidence_id", F.xxhash64("scene_id", "rule"))


_WORD = "replace(replace(lower(" + Q.strip("coalesce(nullif(" + Q.strip("class_semantic_label") + ", ''), nullif(" + Q.strip("semantic_label") + ", ''))") + "), '/', '_'), ' ', '_')"


def _reg(field: int) -> str:
    pascal = "array_to_string(list_transform(list_filter(string_split_regex(word, '[_\\W]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '')"
    other = f"CASE WHEN word IN ({Q.quoted(V.FEATURE_CLASSES)}) THEN '{V.E26}' ELSE '{V.E22}' END" if field == 2 else pascal
    return Q.case("word", {k: v[field] for k, v in V.REGISTRY.items()}, other)


ELEMENTS = f"""words AS (SELECT *, {Q.case(_WORD, V.ONTOLOGY_WORDS, _WORD)} AS word FROM catalogue),
numbered AS (SELECT *, row_number() OVER (PARTITION BY scene_id, word ORDER BY record_id) AS ordinal FROM words WHERE word IS NOT NULL),
el AS (SELECT *, {_reg(0)} || '_' || ordinal AS label, scene_id || '_' || {_reg(0)} || '_' || ordinal AS node_id, {_reg(2)} AS ontology_class, {_reg(3)} AS local_class FROM numbered),
nd AS (SELECT scene_id, node_id, arg_max(label, record_id) AS label, arg_max(ontology_class, record_id) AS ontology_class, arg_max(local_class, record_id) AS local_class, arg_max(word, record_id) AS word,
       arg_max_null(x, record_id) AS x, arg_max_null(y, record_id) AS y, arg_max_null(description, record_id) AS description, arg_max_null(position, record_id) AS position, min(record_id) AS record_id FROM el GROUP BY scene_id, node_id)"""

INDEX = """idx AS (SELECT DISTINCT a.scene_id, a.node_id AS a, b.node_id AS b FROM el a JOIN el b ON a.scene_id = b.scene_id AND a.record_id <> b.record_id
    WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 3.0)"""


@query(f"WITH {ELEMENTS} SELECT scene_id, node_id, label, ontology_class, local_class FROM nd")
def h2_h20_element_nodes(s, d):
    return H.element_nodes(elements(s, d)).select("scene_id", "node_id", "label", "ontology_class", "local_class")


_SLUG = "coalesce(nullif(array_to_string(list_transform(regexp_extract_all(translate({0}, 'àèéìòùÀÈÉÌÒÙ''’', 'aeeiouAEEIOU'), '[A-Za-z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), ''), ''), 'Unspecified')"
SATELLITES = f"""fn AS (SELECT scene_id, record_id, node_id, {Q.strip('f')} AS v FROM (SELECT scene_id, record_id, node_id, unnest(string_split_regex(function, '[;|]')) AS f FROM el WHERE function IS NOT NULL)),
links AS (
    SELECT scene_id, record_id, node_id AS source, 'Tipo_' || {_SLUG.format('typology')} AS target, '{V.P2}' AS predicate, typology AS v FROM el WHERE typology <> ''
    UNION ALL SELECT scene_id, record_id, node_id, 'Materiale_' || {_SLUG.format('material')}, '{V.P45}', material FROM el WHERE material <> ''
    UNION ALL SELECT scene_id, record_id, node_id, 'Funzione_' || {_SLUG.format('v')}, '{V.P103}', v FROM fn WHERE v <> '')"""


@query(f"WITH {ELEMENTS}, {SATELLITES} SELECT target AS node_id, arg_min(v, (record_id, v)) AS label FROM links GROUP BY target")
def h3_satellite_nodes(s, d):
    return H.satellites(elements(s, d))[0].select("node_id", "label")


@query(f"WITH {ELEMENTS}, {SATELLITES} SELECT scene_id, source, target, predicate FROM links")
def h3_satellite_edges(s, d):
    return H.satellites(elements(s, d))[1]


def _first(whole: str, part: str, select: str) -> str:
    return f"SELECT w.scene_id, {select} FROM (SELECT scene_id, arg_min(node_id, record_id) AS a FROM nd WHERE local_class = '{whole}' GROUP BY scene_id) w JOIN nd p ON p.scene_id = w.scene_id AND p.local_class = '{part}' JOIN idx i ON i.scene_id = w.scene_id AND i.a = w.a AND i.b = p.node_id"


COMPOSITION = " UNION ALL ".join([
    _first("Wall", "DoorWindow", f"p.node_id AS source, w.a AS target, '{V.P46I}' AS predicate"), _first("Wall", "Molding", f"w.a, p.node_id, '{V.P56}'"),
    _first("Roof", "Vault", f"p.node_id, w.a, '{V.P46I}'"), _first("Vault", "Arch", f"w.a, p.node_id, '{V.P46}'"),
])


@query(f"WITH {ELEMENTS}, {INDEX} {COMPOSITION}")
def h4_h9_composition(s, d):
    return H.composition_edges(H.element_nodes(elements(s, d)), H.spatial_index(relations(s, d)))


@query(f"WITH {ELEMENTS}, {INDEX} SELECT p.scene_id, p.node_id AS source, w.node_id AS target, '{V.P56I}' AS predicate FROM nd w JOIN nd p ON p.scene_id = w.scene_id AND p.local_class = 'Molding' AND w.local_class IN ('Wall', 'Vault') JOIN idx i ON i.scene_id = w.scene_id AND i.a = w.node_id AND i.b = p.node_id")
def h7_moldings_found_on(s, d):
    return H.moldings_found_on(H.element_nodes(elements(s, d)), H.spatial_index(relations(s, d)))


SPACING = f"""loc AS (SELECT *, CASE WHEN max(x) OVER g - min(x) OVER g >= max(y) OVER g - min(y) OVER g THEN x ELSE y END AS along FROM nd WHERE x IS NOT NULL AND y IS NOT NULL WINDOW g AS (PARTITION BY scene_id, local_class)),
gaps AS (SELECT scene_id, local_class, nullif(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS gap FROM loc WINDOW w AS (PARTITION BY scene_id, local_class ORDER BY along, record_id)),
med AS (SELECT scene_id, local_class, count(*) AS n, list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] AS m FROM gaps GROUP BY ALL),
sp AS (SELECT m.scene_id, m.local_class, any_value(n) AS n, any_value(m.m) AS median_spacing, max(abs(g.gap - m.m) / m.m) AS deviation FROM med m JOIN gaps g USING (scene_id, local_class) GROUP BY ALL)"""


@query(f"WITH {ELEMENTS}, {SPACING} SELECT scene_id, local_class, n, round(median_spacing, 6) AS median_spacing, round(deviation, 6) AS deviation, n >= 2 AND coalesce(deviation <= 0.35, false) AS equispaced FROM sp")
def h10_w2_spacing(s, d):
    return H.spacing(H.kept(elements(s, d)), ["scene_id", "local_class"]).select("scene_id", "local_class", "n", F.round("median_spacing", 6).alias("median_spacing"), F.round("deviation", 6).alias("deviation"), "equispaced")


def rows_of_columns(s: SparkSession, d: str) -> DataFrame:
    """Annotation rows made from the scenes, as the test tables state no support function: three to six columns of each
    scene in a row; in every fifth scene the last one stands two metres off, in every fourth none has a support function,
    in every seventh the last one has none."""
    i = F.regexp_extract("scene_id", "([0-9]+)$", 1).cast("int")
    k = table(s, d, "scenes").select("scene_id", i.alias("i")).withColumn("n", 3 + F.col("i") % 4).withColumn("k", F.explode(F.expr("sequence(1, n)")))
    last = F.col("k") == F.col("n")
    function = F.when((F.col("i") % 4 == 3) | ((F.col("i") % 7 == 6) & last), "decoro").otherwise("sostegno della volta")
    none = F.lit(None).cast("string")
    return k.select((F.col("i") * 10 + F.col("k")).cast("long").alias("row_id"), "scene_id", F.lit("column").alias("class_semantic_label"), none.alias("semantic_label"), (F.col("k") * 2.5 + F.when((F.col("i") % 5 == 4) & last, 2.0).otherwise(0.0)).alias("x"), (F.col("k") * 0.1).alias("y"), F.lit(0.0).alias("z"), none.alias("material"), none.alias("typology"), function.alias("function"), none.alias("description"), none.alias("position"))


@query(f"""WITH r AS (SELECT scene_id, regexp_extract(scene_id, '([0-9]+)$', 1)::INT AS i, unnest(generate_series(1, 3 + regexp_extract(scene_id, '([0-9]+)$', 1)::INT % 4)) AS k FROM scenes),
    c AS (SELECT scene_id, i, k, 3 + i % 4 AS n, k * 2.5 + CASE WHEN i % 5 = 4 AND k = 3 + i % 4 THEN 2.0 ELSE 0.0 END AS x, k * 0.1 AS y, NOT (i % 4 = 3 OR (i % 7 = 6 AND k = 3 + i % 4)) AS carries FROM r),
    g AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS gap FROM c WINDOW w AS (PARTITION BY scene_id ORDER BY x)),
    m AS (SELECT scene_id, count(*) AS n, bool_and(carries) AS carries, list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] AS m FROM g GROUP BY scene_id),
    ok AS (SELECT m.scene_id FROM m JOIN g USING (scene_id) GROUP BY m.scene_id, m.n, m.carries HAVING m.n >= 4 AND m.carries AND max(abs(gap - m.m) / m.m) <= 0.35)
    SELECT scene_id, scene_id || '_Colonnato_1' AS source, scene_id || '_{V.REGISTRY["column"][0]}_' || k AS target, '{V.P46}' AS predicate FROM ok JOIN c USING (scene_id)""")
def h11_colonnades(s, d):
    return H.colonnades(cut(H.elements(rows_of_columns(s, d))))[1]


def rows_of_arcades(s: SparkSession, d: str) -> DataFrame:
    """Annotation rows made from the scenes: two to four equispaced arches over as many columns; in every third scene the last
    column stands three metres off."""
    i = F.regexp_extract("scene_id", "([0-9]+)$", 1).cast("int")
    k = table(s, d, "scenes").select("scene_id", i.alias("i")).withColumn("n", 2 + F.col("i") % 3).withColumn("k", F.explode(F.expr("sequence(1, n)"))).withColumn("word", F.explode(F.array(F.lit("arch"), F.lit("column"))))
    none = F.lit(None).cast("string")
    off = F.when((F.col("word") == "column") & (F.col("i") % 3 == 2) & (F.col("k") == F.col("n")), 3.0).otherwise(0.0)
    return k.select((F.col("i") * 20 + F.col("k") * 2 + (F.col("word") == "column").cast("int")).cast("long").alias("row_id"), "scene_id", F.col("word").alias("class_semantic_label"), none.alias("semantic_label"), (F.col("k") * 3.0 + off).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("word") == "arch", 3.0).otherwise(0.0).alias("z"), none.alias("material"), none.alias("typology"), none.alias("function"), none.alias("description"), none.alias("position"))


def relations_of_arcades(s: SparkSession, d: str) -> DataFrame:
    """The first arch and the first column of each scene touch, but for every fifth scene."""
    first = lambda word: F.concat_ws("_", "scene_id", F.lit(V.REGISTRY[word][0]), F.lit("1"))
    return table(s, d, "scenes").filter(F.regexp_extract("scene_id", "([0-9]+)$", 1).cast("int") % 5 != 1).select("scene_id", first("arch").alias("source"), first("column").alias("target"), F.lit("adjacent").alias("rel_type"))


@query(f"WITH {ELEMENTS}, {SPACING} SELECT sp.scene_id, sp.scene_id || '_Portico_1' AS node_id FROM sp JOIN scenes s ON s.scene_id = sp.scene_id AND s.annotation_csv IS NOT NULL WHERE local_class = 'Arch' AND n >= 2 AND deviation <= 0.35")
def h12_b26_porticoes(s, d):
    return H.porticoes(elements(s, d), scene_evidence(s, d), H.spatial_index(relations(s, d)))[0].select("scene_id", "node_id")


@query(f"""WITH c AS (SELECT scene_id, regexp_extract(scene_id, '([0-9]+)$', 1)::INT AS i, annotation_csv FROM scenes),
    ok AS (SELECT scene_id, i FROM c WHERE annotation_csv IS NOT NULL AND i % 5 <> 1 AND NOT (i % 3 = 2))
    SELECT scene_id, scene_id || '_Loggia_1' AS source, scene_id || '_' || p || '_' || k AS target, '{V.P46}' AS predicate FROM (SELECT scene_id, unnest(generate_series(1, 2 + i % 3)) AS k FROM ok), (VALUES ('{V.REGISTRY["arch"][0]}'), ('{V.REGISTRY["column"][0]}')) v(p)""")
def h13_loggias(s, d):
    """Components of the loggias; the evidence of a loggia without the fields that forbid one."""
    veto = ["ground_floor", "direct_building_access_function", "simple_entrance_filter"]
    evidence = scene_evidence(s, d).drop(*veto)
    found = H.loggias(cut(H.elements(rows_of_arcades(s, d))), evidence, H.spatial_index(relations_of_arcades(s, d)))[1]
    return found.filter(F.col("predicate") == V.P46)


def contextual_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scenes").select("scene_id", F.lit(None).cast("string").alias("source_node_id"), F.lit("finestra").alias("source_local_class"), F.lit("1").alias("source_index"), F.lit(None).cast("string").alias("target_node_id"), F.lit("wall").alias("target_local_class"), F.lit("1").alias("target_index"), F.lit("P46i").alias("predicate"), F.when(F.col("annotation_csv").isNotNull(), "yes").alias("spatially_supported"))


@query(f"WITH {ELEMENTS}, {INDEX}, f AS (SELECT scene_id, arg_min(node_id, record_id) FILTER (local_class = 'DoorWindow') AS s, arg_min(node_id, record_id) FILTER (local_class = 'Wall') AS t FROM nd GROUP BY scene_id) SELECT f.scene_id, f.s AS source, f.t AS target, '{V.P46I}' AS predicate FROM f JOIN scenes c ON c.scene_id = f.scene_id WHERE f.s IS NOT NULL AND f.t IS NOT NULL AND (c.annotation_csv IS NOT NULL OR EXISTS (SELECT 1 FROM idx i WHERE i.scene_id = f.scene_id AND i.a = f.s AND i.b = f.t))")
def h14_c22_contextual_relations(s, d):
    return H.contextual(contextual_rows(s, d), H.element_nodes(elements(s, d)), H.spatial_index(relations(s, d)))


@query(f"WITH {ELEMENTS}, {INDEX} SELECT scene_id, count(*) AS n FROM idx GROUP BY scene_id")
def h15_spatial_index(s, d):
    return H.spatial_index(relations(s, d)).groupBy("scene_id").agg(F.count("*").alias("n"))


def measured_rows(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "objects")
    return o.select(F.col("object_id").alias("row_no"), "scene_id", F.lit(None).cast("string").alias("target_node_id"), F.col("semantic_label").alias("target_local_class"), F.regexp_extract("obj_name", "_([0-9]+)$", 1).alias("target_index"), F.lit("height").alias("dimension_type"), F.round(F.col("max_z") - F.col("min_z"), 3).alias("value"), F.lit("m").alias("unit"), F.lit("boxes").alias("source"))


_OWORD = Q.case("lower(semantic_label)", V.ONTOLOGY_WORDS, "lower(semantic_label)")


@query(f"""WITH {ELEMENTS}, num AS (SELECT scene_id, node_id, local_class, row_number() OVER (PARTITION BY scene_id, local_class ORDER BY record_id) AS place FROM nd),
    o AS (SELECT object_id, scene_id, regexp_extract(obj_name, '_([0-9]+)$', 1)::INT AS i, {_OWORD} AS word FROM objects), oc AS (SELECT *, {_reg(3)} AS lc FROM o),
    t AS (SELECT oc.scene_id, object_id, n.node_id FROM oc JOIN num n ON n.scene_id = oc.scene_id AND n.local_class = oc.lc AND n.place = oc.i)
    SELECT scene_id, scene_id || '_Measurement_' || node_id || '_Height_' || object_id AS source, node_id AS target, '{V.P39}' AS predicate FROM t
    UNION ALL SELECT scene_id, scene_id || '_Measurement_' || node_id || '_Height_' || object_id, scene_id || '_Dimension_' || node_id || '_Height_' || object_id, '{V.P43}' FROM t""")
def h16_measurements(s, d):
    return H.measurements(measured_rows(s, d), H.element_nodes(elements(s, d)))[1]


@query()
def h1_h19_graph(s, d):
    """The whole graph: edges by predicate."""
    c = table(s, d, "catalogue").select(F.col("record_id").alias("row_id"), "scene_id", "class_semantic_label", "semantic_label", "x", "y", "z", "material", "typology", "function", "description", "position")
    edges = H.build(c, relations(s, d), scene_evidence(s, d), contextual_rows(s, d), measured_rows(s, d))[1]
    return edges.groupBy("scene_id", "predicate").agg(F.count("*").alias("n"))


@query(f"WITH {ELEMENTS}, {SATELLITES} SELECT scene_id, source, target, max(predicate) AS predicate FROM links GROUP BY ALL")
def h18_property_graph(s, d):
    edges = H.satellites(elements(s, d))[1].withColumn("edge_ord", F.lit(0))
    return H.property_graph(edges)


@query(f"WITH {ELEMENTS}, {SATELLITES}, k AS (SELECT node_id FROM nd WHERE local_class = 'Vault'), n AS (SELECT node_id FROM k UNION SELECT target FROM links WHERE source IN (SELECT node_id FROM k)) SELECT scene_id, source, target FROM links WHERE predicate = '{V.P45}' AND source IN (SELECT node_id FROM n) AND target IN (SELECT node_id FROM n)")
def b16_ontology_filter(s, d):
    e = elements(s, d)
    shared, edges = H.satellites(e)
    return H.filter_graph(H.element_nodes(e).unionByName(shared), edges, ["VAULT"], ["P45_consists_of"], neighbours=True)[1].select("scene_id", "source", "target")


@query(f"WITH {ELEMENTS} SELECT scene_id, node_id FROM nd WHERE local_class IN ('Roof', 'Vault', 'Floor') OR {Q.any_of('lower(concat_ws(' + chr(39) + ' ' + chr(39) + ', local_class, label, ' + _reg(1) + ', description, position))', V.COVER_WORDS)}")
def b27_covers(s, d):
    return H.covers(H.element_nodes(elements(s, d))).select("scene_id", "node_id")
