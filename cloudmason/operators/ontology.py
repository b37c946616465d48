"""Ontology graph of a scene: elements, their type, material and function nodes, composition, rule-made ensembles.

nodes: scene_id (null for shared satellite nodes), node_id, label, ontology_class, local_class, properties, node_ord.
edges: scene_id, source, target, predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.functions import text as X
from cloudmason.functions import vocabulary as V
from cloudmason.operators.points import ranked
from cloudmason.session import cut

NODE_COLUMNS = ["scene_id", "node_id", "label", "ontology_class", "local_class", "properties", "node_ord"]
SATELLITES = {"typology": ("Tipo", V.E55, V.P2), "material": ("Materiale", V.E57, V.P45), "function": ("Funzione", V.E55, V.P103)}


def registry(word: Column, field: int) -> Column:
    """Field (prefix, display label, ontology class, local class) of a class word; unknown words by rule."""
    fallback = F.when(word.isin(V.FEATURE_CLASSES), V.E26).otherwise(V.E22) if field == 2 else X.pascal(word)
    return X.lookup(word, {k: v[field] for k, v in V.REGISTRY.items()}, fallback)


def elements(rows: DataFrame, compat_zero: bool = False) -> DataFrame:
    """Element nodes from annotation rows (row_id, scene_id, class_semantic_label, semantic_label, x, y, z, material, typology,
    function, description, position): numbered per scene and class in row order. Rows without a class make none. With
    compat_zero a coordinate of exactly 0 counts as missing."""
    label = F.coalesce(F.nullif(X.row_text(F.col("class_semantic_label")), F.lit("")), F.nullif(X.row_text(F.col("semantic_label")), F.lit("")))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    axis = lambda c: F.when(number(c) != 0, number(c)) if compat_zero else number(c)
    d = rows.select("row_id", "scene_id", X.l3_class(label).alias("word"), *(axis(c).alias(c) for c in "xyz"), *(X.row_text(F.col(c)).alias(c) for c in ("material", "typology", "function", "description", "position"))).filter(F.col("word").isNotNull())
    d = ranked(d.withColumn("point_id", F.col("row_id")), ["scene_id", "word"], "row_id", parts=1 << 14, top=1 << 40).withColumnRenamed("rank", "ordinal").drop("point_id")
    node = F.concat_ws("_", registry(F.col("word"), 0), F.col("ordinal").cast("string"))
    props = F.create_map(F.lit("display_label"), registry(F.col("word"), 1), F.lit("position"), F.col("position"), F.lit("description"), F.col("description"))
    return d.withColumn("label", node).withColumn("node_id", F.concat_ws("_", "scene_id", "label")).withColumn("ontology_class", registry(F.col("word"), 2)).withColumn("local_class", registry(F.col("word"), 3)).withColumn("properties", props)


def kept(found: DataFrame) -> DataFrame:
    """One row per node: class words that share a prefix can give two rows one id; the last row then stays, in the place of
    the first. Edges of both rows remain."""
    rest = [c for c in found.columns if c not in ("scene_id", "node_id", "row_id")]
    d = found.groupBy("scene_id", "node_id").agg(F.max_by(F.struct(*rest), "row_id").alias("m"), F.min("row_id").alias("row_id"))
    return d.select("scene_id", "node_id", "row_id", *(F.col(f"m.{c}").alias(c) for c in rest))


def element_nodes(found: DataFrame) -> DataFrame:
    return kept(found).select("scene_id", "node_id", "label", "ontology_class", "local_class", "properties", F.col("row_id").alias("node_ord"))


def satellites(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shared type, material and function nodes, edges to them); of one slug the wording of the first row wins."""
    links = None
    for kind, (prefix, cls, predicate) in SATELLITES.items():
        values = F.explode(X.split_values(F.col("function"))) if kind == "function" else F.col(kind)
        own = found.select("scene_id", "row_id", F.col("node_id").alias("source"), values.alias("value")).filter(F.col("value") != "")
        own = own.select("scene_id", "row_id", "source", "value", F.concat_ws("_", F.lit(prefix), X.slug(F.col("value"))).alias("target"), F.lit(predicate).alias("predicate"), F.lit(cls).alias("ontology_class"), F.lit(kind).alias("local_class"))
        links = own if links is None else links.unionByName(own)
    nodes = links.groupBy("target").agg(F.min(F.struct("row_id", "value", "ontology_class", "local_class")).alias("m")).select(F.lit(None).cast("string").alias("scene_id"), F.col("target").alias("node_id"), F.col("m.value").alias("label"), F.col("m.ontology_class").alias("ontology_class"), F.col("m.local_class").alias("local_class"), F.create_map(F.lit("value"), F.col("m.value")).alias("properties"), F.col("m.row_id").alias("node_ord"))
    return nodes, links.select("scene_id", "source", "target", "predicate")


def spatial_index(relations: DataFrame) -> DataFrame:
    """Distinct (scene_id, a, b), both ways, of relations (scene_id, source, target, rel_type) that support composition."""
    kept = relations.filter((F.coalesce(F.col("rel_type"), F.lit("")) == "") | F.lower("rel_type").isin(V.SPATIAL_SUPPORT))
    one = kept.select("scene_id", F.col("source").alias("a"), F.col("target").alias("b"))
    both = one.unionByName(one.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b"))).filter((F.col("a") != "") & (F.col("b") != "")).distinct()
    return cut(both)  # read by every rule


def bridge_l1(relations: DataFrame) -> DataFrame:
    """L1 relation types as the ontology's words."""
    return relations.withColumn("rel_type", F.when(F.col("rel_type") == "adjacent_to", "adjacent").otherwise(F.col("rel_type")))


def composition(nodes: DataFrame, index: DataFrame | None, whole: str, parts: list[str], predicate: str, inverse: bool = False, first_only: bool = True) -> DataFrame:
    """Edges between the first whole of a scene (or every one) and all its spatially related parts, both as local classes.
    index None means that everything is related; an empty index means that nothing is."""
    wholes = nodes.filter(F.col("local_class") == whole)
    if first_only:
        wholes = wholes.groupBy("scene_id").agg(F.min(F.struct("node_ord", "node_id")).alias("w")).select("scene_id", F.col("w.node_id").alias("a"))
    else:
        wholes = wholes.select("scene_id", F.col("node_id").alias("a"))
    pairs = wholes.join(nodes.filter(F.col("local_class").isin(parts)).select("scene_id", F.col("node_id").alias("b")), "scene_id")
    if index is not None:
        pairs = pairs.join(index, ["scene_id", "a", "b"], "left_semi")
    s, t = ("b", "a") if inverse else ("a", "b")
    return pairs.select("scene_id", F.col(s).alias("source"), F.col(t).alias("target"), F.lit(predicate).alias("predicate"))


def composition_edges(nodes: DataFrame, index: DataFrame | None) -> DataFrame:
    """Doors and windows in walls, mouldings on walls, vaults in roofs, arches in vaults."""
    return (
        composition(nodes, index, "Wall", ["DoorWindow"], V.P46I, inverse=True).unionByName(composition(nodes, index, "Wall", ["Molding"], V.P56))
        .unionByName(composition(nodes, index, "Roof", ["Vault"], V.P46I, inverse=True)).unionByName(composition(nodes, index, "Vault", ["Arch"], V.P46))
    )


def moldings_found_on(nodes: DataFrame, index: DataFrame | None) -> DataFrame:
    """Mouldings on every related wall and vault."""
    return composition(nodes, index, "Wall", ["Molding"], V.P56I, inverse=True, first_only=False).unionByName(composition(nodes, index, "Vault", ["Molding"], V.P56I, inverse=True, first_only=False))


def spacing(found: DataFrame, by: list[str]) -> DataFrame:
    """Per group of located elements: n, median spacing, largest relative deviation, equispaced. They are sorted along the
    longer plan axis (x on a tie), gaps of 0 dropped; the median is the upper one."""
    d = found.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    g = Window.partitionBy(*by)
    along = F.when(F.max("x").over(g) - F.min("x").over(g) >= F.max("y").over(g) - F.min("y").over(g), F.col("x")).otherwise(F.col("y"))
    d = d.withColumn("along", along)
    w = g.orderBy("along", "row_id")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    d = d.withColumn("gap", F.sqrt(dx * dx + dy * dy)).withColumn("gap", F.when(F.col("gap") > 0, F.col("gap")))
    d = d.withColumn("m", F.count("gap").over(g)).withColumn("place", F.row_number().over(g.orderBy(F.col("gap").asc_nulls_last(), "row_id")) - 1)
    d = d.withColumn("median", F.max(F.when(F.col("place") == F.floor(F.col("m") / 2), F.col("gap"))).over(g))
    worst = F.max(F.abs(F.col("gap") - F.col("median")) / F.col("median"))
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.first("median").alias("median_spacing"), worst.alias("deviation"))
    return out.withColumn("equispaced", (F.col("n") >= 2) & F.coalesce(F.col("deviation") <= V.SPACING_TOLERANCE, F.lit(False)))


def colonnades(found: DataFrame, stems: list[str] = V.SUPPORT_FUNCTION_STEMS, least: int = V.MIN_COLONNADE) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a colonnade where at least four located columns, all with a support function, are equispaced."""
    columns = kept(found).filter((F.col("local_class") == "Column") & F.col("x").isNotNull() & F.col("y").isNotNull())
    carries = X.has_any(F.lower("function"), stems).cast("int")
    whole = spacing(columns, ["scene_id"]).join(columns.groupBy("scene_id").agg(F.min(carries).alias("all_carry")), "scene_id")
    scenes = whole.filter((F.col("n") >= least) & (F.col("all_carry") == 1) & F.col("equispaced")).select("scene_id")
    return _ensemble(scenes.withColumn("node_id", F.concat(F.col("scene_id"), F.lit("_Colonnato_1"))).withColumn("label", F.lit("Colonnato_1")), "Colonnade", "Colonnato", "at_least_4_equispaced_structural_support_columns"), scenes.join(columns, "scene_id").select("scene_id", F.concat(F.col("scene_id"), F.lit("_Colonnato_1")).alias("source"), F.col("node_id").alias("target"), F.lit(V.P46).alias("predicate"))


def _ensemble(rows: DataFrame, local_class: str, display: str, rule: str) -> DataFrame:
    props = F.create_map(F.lit("scene_id"), F.col("scene_id"), F.lit("display_label"), F.lit(display), F.lit("rule"), F.lit(rule))
    return rows.select("scene_id", "node_id", "label", F.lit(V.E22).alias("ontology_class"), F.lit(local_class).alias("local_class"), props.alias("properties"), F.lit(None).cast("long").alias("node_ord"))


def gate(evidence: DataFrame, rule: str) -> DataFrame:
    """The first evidence row per scene for portico or loggia that passes all required fields and vetoes: scene_id, node_id, label."""
    fields = V.PORTICO_FIELDS if rule == "portico" else V.LOGGIA_FIELDS
    true = lambda c: X.truthy(F.col(c)) if c in evidence.columns else F.lit(False)
    ok = F.lit(True)
    for f in fields:
        ok &= true(f)
    if rule == "loggia":
        ok &= ~((true("ground_floor") & true("direct_building_access_function")) | true("simple_entrance_filter"))
    first = evidence.filter(X.l3_class(F.col("rule")) == rule).withColumn("rn", F.row_number().over(Window.partitionBy("scene_id").orderBy("evidence_id"))).filter("rn = 1").withColumn("ok", ok)
    pick = lambda c, other: F.coalesce(X.blank_to_null(F.col(c)), other) if c in evidence.columns else other
    name = rule.capitalize()
    return first.filter("ok").select("scene_id", pick("node_id", F.concat(F.col("scene_id"), F.lit(f"_{name}_1"))).alias("node_id"), pick("label", F.lit(f"{name}_1")).alias("label"))


def covers(nodes: DataFrame) -> DataFrame:
    said = F.lower(F.concat_ws(" ", "local_class", "label", F.element_at("properties", "display_label"), F.element_at("properties", "description"), F.element_at("properties", "position")))
    return nodes.filter(F.col("local_class").isin(V.COVER_CLASSES) | X.has_any(said, V.COVER_WORDS))


def _made(scenes: DataFrame, components: DataFrame, nodes: DataFrame, index: DataFrame, extra: list[tuple[str, str]]) -> DataFrame:
    """Edges of an ensemble: to its type and function nodes, its components, and covers related to one of them."""
    parts = scenes.select("scene_id", F.col("node_id").alias("source")).join(components.select("scene_id", F.col("node_id").alias("target")), "scene_id")
    near = covers(nodes).select("scene_id", F.col("node_id").alias("a")).join(index, ["scene_id", "a"]).join(components.select("scene_id", F.col("node_id").alias("b")), ["scene_id", "b"], "left_semi").select("scene_id", F.col("a").alias("target")).distinct()
    over = scenes.select("scene_id", F.col("node_id").alias("source")).join(near, "scene_id")
    out = parts.unionByName(over).withColumn("predicate", F.lit(V.P46))
    for target, predicate in extra:
        out = out.unionByName(scenes.select("scene_id", F.col("node_id").alias("source"), F.lit(target).alias("target"), F.lit(predicate).alias("predicate")))
    return out


def _located(found: DataFrame, *classes: str) -> DataFrame:
    return kept(found).filter(F.col("local_class").isin(*classes) & F.col("x").isNotNull() & F.col("y").isNotNull())


def _spaced(located: DataFrame, least: int) -> DataFrame:
    return spacing(located, ["scene_id"]).filter((F.col("n") >= least) & F.col("equispaced")).select("scene_id")


def porticoes(found: DataFrame, evidence: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): gate and equispaced arches, else equispaced columns with an architrave related to one of them."""
    nodes = element_nodes(found)
    arches, columns = _located(found, "Arch"), _located(found, "Column")
    by_arch = _spaced(arches, 2)
    beams = nodes.filter(F.col("local_class") == "Architrave")
    tied = beams.select("scene_id", F.col("node_id").alias("a")).join(index, ["scene_id", "a"]).join(columns.select("scene_id", F.col("node_id").alias("b")), ["scene_id", "b"], "left_semi").select("scene_id").distinct()
    by_column = _spaced(columns, 2).join(tied, "scene_id", "left_semi").join(by_arch, "scene_id", "left_anti")
    parts = arches.join(by_arch, "scene_id", "left_semi").select("scene_id", "node_id").unionByName(columns.join(by_column, "scene_id", "left_semi").select("scene_id", "node_id")).unionByName(beams.join(by_column, "scene_id", "left_semi").select("scene_id", "node_id"))
    scenes = gate(evidence, "portico").join(by_arch.unionByName(by_column), "scene_id", "left_semi")
    return _ensemble(scenes, "Portico", "Portico/Porticato", "aligned_arcade_continuous_cover_ground_floor_open_external_side"), _made(scenes, parts, nodes, index, [("Tipo_PorticoPorticato", V.P2)])


def loggias(found: DataFrame, evidence: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): gate, equispaced arches and equispaced columns or pillars, one pair of them related."""
    nodes = element_nodes(found)
    arches, supports = _located(found, "Arch"), _located(found, "Column", "Pillar")
    tied = arches.select("scene_id", F.col("node_id").alias("a")).join(index, ["scene_id", "a"]).join(supports.select("scene_id", F.col("node_id").alias("b")), ["scene_id", "b"], "left_semi").select("scene_id").distinct()
    scenes = gate(evidence, "loggia").join(_spaced(arches, 2), "scene_id", "left_semi").join(_spaced(supports, 2), "scene_id", "left_semi").join(tied, "scene_id", "left_semi")
    parts = arches.select("scene_id", "node_id").unionByName(supports.select("scene_id", "node_id"))
    return _ensemble(scenes, "Loggia", "Loggia/Loggiato", "covered_room_open_side_arcades_integrated_building_intermediate_function"), _made(scenes, parts, nodes, index, [("Tipo_LoggiaLoggiato", V.P2), ("Funzione_SpazioIntermedioRappresentativo", V.P103)])


def endpoint(rows: DataFrame, nodes: DataFrame, p: str) -> DataFrame:
    """rows with p_id: the node named by p_node_id, else by p_local_class and the 1-based p_index in node order."""
    ids = nodes.select(F.col("scene_id").alias("sid"), F.col("node_id").alias("by_id"))
    numbered = nodes.withColumn("place", F.row_number().over(Window.partitionBy("scene_id", "local_class").orderBy("node_ord"))).select(F.col("scene_id").alias("sid"), F.col("local_class").alias("lc"), "place", F.col("node_id").alias("by_place"))
    d = rows.join(ids, (F.col("scene_id") == F.col("sid")) & (F.col(f"{p}_node_id") == F.col("by_id")), "left").drop("sid")
    cls = registry(X.l3_class(F.col(f"{p}_local_class")), 3)
    d = d.join(numbered, (F.col("scene_id") == F.col("sid")) & (cls == F.col("lc")) & (X.row_text(F.col(f"{p}_index")).try_cast("int") == F.col("place")), "left").drop("sid")
    return d.withColumn(f"{p}_id", F.coalesce("by_id", "by_place")).drop("by_id", "by_place", "lc", "place")


def contextual(rows: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Edges from relation rows: allowed predicate, both ends found, spatial support in the index or stated."""
    d = endpoint(endpoint(rows, nodes, "source"), nodes, "target").withColumn("predicate", X.predicate(F.col("predicate"))).filter(F.col("predicate").isin(*dict.fromkeys(V.PREDICATES.values())) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    seen = index.select("scene_id", F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit(True).alias("seen"))
    stated = F.coalesce(F.lower(X.strip_blanks(F.col("spatially_supported"))).isin("1", "true", "yes", "y"), F.lit(False))
    return d.join(seen, ["scene_id", "source_id", "target_id"], "left").filter(stated | F.col("seen")).select("scene_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "predicate")


def measurements(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of measurement rows: row_no, scene_id, target_node_id or target_local_class + target_index,
    dimension_type, value, unit, source. Rows without a target make none."""
    d = endpoint(rows, nodes, "target").filter(F.col("target_id").isNotNull())
    tail = F.concat_ws("_", "target_id", X.slug(F.col("dimension_type")), F.col("row_no").cast("string"))
    d = d.withColumn("m_id", F.concat_ws("_", "scene_id", F.lit("Measurement"), tail)).withColumn("d_id", F.concat_ws("_", "scene_id", F.lit("Dimension"), tail))
    m = d.select("scene_id", F.col("m_id").alias("node_id"), F.col("m_id").alias("label"), F.lit(V.E16).alias("ontology_class"), F.lit("Measurement").alias("local_class"), F.create_map(F.lit("scene_id"), "scene_id", F.lit("dimension_type"), "dimension_type", F.lit("source"), X.row_text(F.col("source"))).alias("properties"), F.col("row_no").alias("node_ord"))
    e = d.select("scene_id", F.col("d_id").alias("node_id"), F.col("d_id").alias("label"), F.lit(V.E54).alias("ontology_class"), F.lit("Dimension").alias("local_class"), F.create_map(F.lit("scene_id"), "scene_id", F.lit("dimension_type"), "dimension_type", F.lit(V.P90), F.col("value").cast("string"), F.lit("unit"), "unit").alias("properties"), F.col("row_no").alias("node_ord"))
    edges = d.select("scene_id", F.col("m_id").alias("source"), F.col("target_id").alias("target"), F.lit(V.P39).alias("predicate")).unionByName(d.select("scene_id", F.col("m_id").alias("source"), F.col("d_id").alias("target"), F.lit(V.P43).alias("predicate")))
    return m.unionByName(e), edges


def build(rows: DataFrame, relations: DataFrame, evidence: DataFrame | None = None, context: DataFrame | None = None, measured: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all scenes: elements and satellites, composition, ensembles, contextual relations, measurements."""
    found = cut(elements(rows))
    nodes = cut(element_nodes(found))
    shared, edges = satellites(found)
    index = spatial_index(relations)
    all_nodes, all_edges = nodes.unionByName(shared), edges.unionByName(composition_edges(nodes, index))
    made = [colonnades(found)]
    if evidence is not None:
        made += [porticoes(found, evidence, index), loggias(found, evidence, index)]
    for n, e in made:
        all_nodes, all_edges = all_nodes.unionByName(n), all_edges.unionByName(e)
    if context is not None:
        all_edges = all_edges.unionByName(contextual(context, nodes, index))
    if measured is not None:
        n, e = measurements(measured, nodes)
        all_nodes, all_edges = all_nodes.unionByName(n), all_edges.unionByName(e)
    return all_nodes, all_edges


def property_graph(edges: DataFrame) -> DataFrame:
    """One edge per directed pair: of parallel edges the last one (the largest edge_ord, then predicate) stays."""
    return edges.groupBy("scene_id", "source", "target").agg(F.max_by("predicate", F.struct("edge_ord", "predicate")).alias("predicate"))


def filter_graph(nodes: DataFrame, edges: DataFrame, classes: list[str] | None = None, predicates: list[str] | None = None, neighbours: bool = False) -> tuple[DataFrame, DataFrame]:
    """Induced subgraph of the nodes whose label, local class or ontology class is among classes (any case), with one hop of
    neighbours on request; edges by predicate, the prefix being optional. Nodes stay when only edges are filtered."""
    kept = nodes
    if classes:
        wanted = [c.lower() for c in classes]
        kept = nodes.filter(F.lower("label").isin(wanted) | F.lower("local_class").isin(wanted) | F.lower("ontology_class").isin(wanted))
        if neighbours:
            ids = kept.select(F.col("node_id").alias("x")).distinct()
            out = edges.join(ids, F.col("source") == F.col("x"), "left_semi").select(F.col("target").alias("node_id"))
            into = edges.join(ids, F.col("target") == F.col("x"), "left_semi").select(F.col("source").alias("node_id"))
            kept = nodes.join(kept.select("node_id").unionByName(out).unionByName(into).distinct(), "node_id", "left_semi")
    ids = kept.select(F.col("node_id").alias("x")).distinct()
    kept_edges = edges.join(ids, F.col("source") == F.col("x"), "left_semi").join(ids, F.col("target") == F.col("x"), "left_semi") if classes else edges
    if predicates:
        short = [p.removeprefix("crm:") for p in predicates]
        kept_edges = kept_edges.filter(F.regexp_replace("predicate", "^crm:", "").isin(short))
    return kept.select(*nodes.columns), kept_edges
