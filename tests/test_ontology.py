from pyspark.sql import functions as F

from cloudmason.functions import vocabulary as V
from cloudmason.operators import ontology as H

ROWS = "row_id long, scene_id string, class_semantic_label string, semantic_label string, x double, y double, z double, material string, typology string, function string, description string, position string"
EV = "evidence_id long, scene_id string, rule string, " + ", ".join(f"{f} string" for f in dict.fromkeys([*V.PORTICO_FIELDS, *V.LOGGIA_FIELDS, "direct_building_access_function", "simple_entrance_filter"]))


def row(i, cls, x=None, y=None, **more):
    return (i, "S", cls, None, x, y, 0.0, more.get("material"), more.get("typology"), more.get("function"), more.get("description"), None)


def found(spark, *rows):
    return H.elements(spark.createDataFrame(list(rows), ROWS))


def evidence(spark, rule, no=(), yes=()):
    fields = [f.split()[0] for f in EV.split(", ")][3:]
    on = {*V.PORTICO_FIELDS, *V.LOGGIA_FIELDS, *yes} - {"ground_floor"} | ({"ground_floor"} if rule == "porticato" or "ground_floor" in yes else set())
    return spark.createDataFrame([(1, "S", rule, *("yes" if f in on and f not in no else "no" for f in fields))], EV)


def relations(spark, *pairs, kind="near"):
    return spark.createDataFrame([("S", a, b, kind) for a, b in pairs], "scene_id string, source string, target string, rel_type string")


def edges(df):
    return {(r["source"], r["target"], r["predicate"]) for r in df.collect()}


def test_elements_and_satellites(spark):
    e = found(spark, row(1, "Porta", typology="a botte", material="Pietra d'Istria", function="access; light | access"), row(2, "door"), row(3, "ornamento a rilievo"), row(4, None), row(5, "", material="x"))
    nodes = {r["node_id"]: r for r in H.element_nodes(e).collect()}
    assert set(nodes) == {"S_PortaFinestra_1", "S_PortaFinestra_2", "S_OrnamentoARilievo_1"}
    shared, links = H.satellites(e)
    assert {r["node_id"]: r["label"] for r in shared.collect()} == {"Tipo_ABotte": "a botte", "Materiale_PietraDistria": "Pietra d'Istria", "Funzione_Access": "access", "Funzione_Light": "light"}
    assert links.count() == 5  # edges are not made distinct


def test_composition_needs_the_index(spark):
    n = H.element_nodes(found(spark, row(1, "wall"), row(2, "wall"), row(3, "door"), row(4, "molding")))
    index = H.spatial_index(relations(spark, ("S_PortaFinestra_1", "S_Muro_1"), ("S_Modanatura_1", "S_Muro_2")))
    assert edges(H.composition_edges(n, index)) == {("S_PortaFinestra_1", "S_Muro_1", V.P46I)}  # only the first wall is a whole
    assert edges(H.composition_edges(n, None)) == {("S_PortaFinestra_1", "S_Muro_1", V.P46I), ("S_Muro_1", "S_Modanatura_1", V.P56)}
    assert edges(H.composition_edges(n, H.spatial_index(relations(spark, ("S_PortaFinestra_1", "S_Muro_1"), kind="above")))) == set()
    assert edges(H.moldings_found_on(n, index)) == {("S_Modanatura_1", "S_Muro_2", V.P56I)}


def columns(n, function="sostegno", step=3.0, last=0.0):
    return [row(i, "column", i * step + (last if i == n - 1 else 0.0), 0.0, function=function) for i in range(n)]


def test_colonnade(spark):
    assert H.colonnades(found(spark, *columns(4)))[1].count() == 4
    assert H.colonnades(found(spark, *columns(3)))[1].count() == 0
    assert H.colonnades(found(spark, *columns(4, last=4.0)))[1].count() == 0
    assert H.colonnades(found(spark, *columns(4, function="decorative")))[1].count() == 0
    assert H.colonnades(found(spark, *columns(4), row(9, "column")))[1].count() == 4  # unlocated columns do not count


def test_portico(spark):
    none = H.spatial_index(spark.createDataFrame([], "scene_id string, source string, target string, rel_type string"))
    e = found(spark, row(1, "arch", 0.0, 0.0), row(2, "arch", 3.0, 0.0), row(3, "roof", 1.0, 0.0))
    nodes, made = H.porticoes(e, evidence(spark, "porticato"), none)
    assert nodes.count() == 1 and made.count() == 3
    assert H.porticoes(e, evidence(spark, "porticato"), H.spatial_index(relations(spark, ("S_Roof_1", "S_Arco_1"))))[1].count() == 4
    for f in V.PORTICO_FIELDS:
        assert H.porticoes(e, evidence(spark, "porticato", no=(f,)), none)[0].count() == 0
    c = found(spark, row(1, "column", 0.0, 0.0), row(2, "column", 3.0, 0.0), row(3, "architrave"))
    assert H.porticoes(c, evidence(spark, "porticato"), none)[0].count() == 0
    assert H.porticoes(c, evidence(spark, "porticato"), H.spatial_index(relations(spark, ("S_Architrave_1", "S_Colonna_2"))))[1].count() == 4


def test_loggia(spark):
    e = found(spark, row(1, "arch", 0.0, 0.0), row(2, "arch", 3.0, 0.0), row(3, "column", 0.0, 1.0), row(4, "pillar", 3.0, 1.0))
    index = H.spatial_index(relations(spark, ("S_Arco_1", "S_Pilastro_1")))
    assert H.loggias(e, evidence(spark, "loggia"), index)[1].count() == 6
    for f in V.LOGGIA_FIELDS:
        assert H.loggias(e, evidence(spark, "loggia", no=(f,)), index)[0].count() == 0
    assert H.loggias(e, evidence(spark, "loggia", yes=("ground_floor", "direct_building_access_function")), index)[0].count() == 0
    assert H.loggias(e, evidence(spark, "loggia", yes=("simple_entrance_filter",)), index)[0].count() == 0
    assert H.loggias(e, evidence(spark, "loggia"), H.spatial_index(spark.createDataFrame([], "scene_id string, source string, target string, rel_type string")))[0].count() == 0


def test_zero_coordinate(spark):
    df = spark.createDataFrame([row(1, "column", 0.0, 1.0)], ROWS)
    assert H.elements(df).first()["x"] == 0.0 and H.elements(df, compat_zero=True).first()["x"] is None


def test_filter_and_export(spark):
    e = found(spark, row(1, "vault", material="brick"), row(2, "wall", material="brick"))
    shared, links = H.satellites(e)
    nodes = H.element_nodes(e).unionByName(shared)
    kept, kept_edges = H.filter_graph(nodes, links, ["vault"], None, neighbours=True)
    assert {r["node_id"] for r in kept.collect()} == {"S_Volta_1", "Materiale_Brick"} and kept_edges.count() == 1
    doubled = links.withColumn("edge_ord", F.lit(1)).unionByName(links.withColumn("predicate", F.lit("zz")).withColumn("edge_ord", F.lit(2)))
    assert {r["predicate"] for r in H.property_graph(doubled).collect()} == {"zz"}
