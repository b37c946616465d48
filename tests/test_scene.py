import itertools

import numpy as np
import pytest

from cloudmason.context import TOOLS, Parameters, SceneContext
from cloudmason.operators import annotations as A
from cloudmason.operators import features as S
from cloudmason.operators import grounding as K
from cloudmason.operators import relations as R

SCHEMA = "object_id long, scene_id string, obj_ord int, obj_name string, semantic_label string, point_count long, cx double, cy double, cz double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def box(i, label, centre, half, n=100, scene="s"):
    c, h = np.array(centre, float), np.array(half, float)
    return (i, scene, i, f"{label}_{i}", label, n, *map(float, c), *map(float, c - h), *map(float, c + h))


def objects(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def kinds(df):
    return {(r["source"], r["target"], r["rel_type"]) for r in df.collect()}


def test_stack_limits(spark):
    o = objects(spark, box(0, "floor", (0, 0, 0), (2, 2, 0.125)), box(1, "column", (0, 0, 1), (0.25, 0.25, 1)), box(2, "arch", (0, 0, 3.0), (1, 1, 0.25)), box(3, "vault", (0, 0, 4.25), (1, 1, 0.25)), box(4, "column", (0.5, 0, 3.75), (0.25, 0.25, 0.5)))
    got = kinds(R.relationships(o))
    assert ("column_1", "floor_0", "above") in got and ("floor_0", "column_1", "below") in got  # gap -0.125
    assert ("arch_2", "column_1", "above") in got  # gap 0.75
    assert ("vault_3", "arch_2", "above") in got
    assert ("column_4", "arch_2", "above") not in got  # a column above an arch is left out
    assert ("column_1", "floor_0", "near") in got and ("floor_0", "column_1", "near") in got


def test_far_box_is_adjacent_but_not_near(spark):
    o = objects(spark, box(0, "wall", (0, 0, 1), (10, 0.1, 1)), box(1, "floor", (9, 2.2, 0), (1, 1.5, 0.1)))
    assert kinds(R.relationships(o)) == {("wall_0", "floor_1", "adjacent_to"), ("floor_1", "wall_0", "adjacent_to")}


def test_relations_of_random_scenes_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [box(i, ["wall", "arch", "column", "vault"][i % 4], rng.uniform(-12, 12, 3), rng.uniform(0.1, 4, 3), scene="ab"[i % 2]) for i in range(120)]
    got = R.relationships(objects(spark, *rows))
    near = {(r["source"], r["target"]) for r in got.filter("rel_type = 'near'").collect()}
    want = set()
    for a, b in itertools.permutations(rows, 2):
        if a[1] == b[1] and np.linalg.norm(np.subtract(a[6:9], b[6:9])) <= 3.0:
            want.add((a[3], b[3]))
    assert near == want
    flat = kinds(got)
    assert len(flat) == got.count() and all((t, s, {"above": "below", "below": "above"}.get(k, k)) in flat for s, t, k in flat)


def test_auto_threshold(spark):
    rng = np.random.default_rng(2)
    rows = [box(i, "wall", rng.uniform(0, 30, 3), (1, 1, 1), scene="ab"[i % 2]) for i in range(61)] + [box(99, "wall", (0, 0, 0), (1, 1, 1), scene="c")]
    for block in (1000, 7):
        got = {r["scene_id"]: r["threshold"] for r in R.auto_threshold(objects(spark, *rows), block).collect()}
        for s in "ab":
            c = np.array([r[6:9] for r in rows if r[1] == s])
            d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[np.triu_indices(len(c), 1)]
            assert abs(got[s] - max(np.median(d) / 2.5, 0.5)) < 1e-12
        assert got["c"] == 3.0


ANN = "annotation_id long, scene_id string, semantic_label string, global_box_center_x double, global_box_center_y double, global_box_center_z double, description string, historical_description string, material_description string, typology string, function string, notes string, supports string"


def annotation(i, label, x, y, z, **more):
    return (i, "s", label, x, y, z, *(more.get(c) for c in ("description", "historical_description", "material_description", "typology", "function", "notes", "supports")))


def test_annotation_match(spark):
    o = objects(spark, box(0, "wall", (0, 0, 0), (1, 1, 1)), box(1, "wall", (2, 0, 0), (1, 1, 1)), box(2, "vault", (0, 0, 5), (1, 1, 1)), box(3, "roof", (400, 0, 5), (1, 1, 1)))
    a = spark.createDataFrame([annotation(1, "Muro", 1.0, 0.0, 0.0), annotation(2, "walls", 50.0, 0.0, 0.0), annotation(3, "wall", None, 0.0, 0.0), annotation(4, "altar", 0.0, 0.0, 0.0), annotation(5, None, 0.0, 0.0, None), annotation(6, "vault", 0.0, 0.0, None), annotation(7, " ", 0.0, 0.0, 4.0), annotation(8, "wall", 30_000.0, 0.0, 0.0), annotation(9, "vault", 0.0, 0.0, 3.0)], ANN)
    m = {r["annotation_id"]: r for r in A.match_objects(A.prepared(a), o).collect()}
    assert m[1]["obj_name"] == "wall_0" and m[1]["distance_m"] == 1.0  # a tie goes to the earlier object
    assert m[2]["obj_name"] is None and m[2]["nearest_object"] == "wall_1" and "beyond" in m[2]["reason"]
    assert "missing" in m[3]["reason"] and "no candidates" in m[4]["reason"] and m[4]["method"] == "none"
    assert m[5]["obj_name"] == "wall_0" and m[6]["obj_name"] == "vault_2"  # in the plane
    assert m[7]["obj_name"] == "vault_2" and m[8]["nearest_object"] == "wall_1" and m[9]["distance_m"] == 2.0
    assert A.match_objects(A.prepared(a.limit(0)), o).count() == 0


def test_support_evidence(spark):
    o = objects(spark, box(0, "column", (0, 0, 0), (1, 1, 1)), box(1, "vault", (0, 0, 3), (1, 1, 1)), box(2, "vault", (9, 0, 3), (1, 1, 1)), box(3, "arch", (9, 9, 9), (1, 1, 1)))
    a = spark.createDataFrame([annotation(1, "column", 0.0, 0.0, 0.0, description="Colonna portante della volta"), annotation(2, "vault", 0.0, 0.0, 3.0, description="Volta e arco"), annotation(3, "arch", 9.0, 9.0, 9.0, supports="the vaults", description="regge il tetto")], ANN)
    got = kinds(A.support_evidence(A.match_objects(A.prepared(a), o), o))
    assert got == {(s, t, "supports") for s in ("column_0", "arch_3") for t in ("vault_1", "vault_2")} | {(t, s, "rests_on") for s in ("column_0", "arch_3") for t in ("vault_1", "vault_2")}


def test_outer_columns_and_features(spark):
    o = objects(spark, *[box(i, "column", c, (0.1, 0.1, 1)) for i, c in enumerate([(0, 0, 0), (4, 0, 0), (4, 4, 0), (0, 4, 0), (2, 2, 0), (2, 0, 0)])], box(9, "floor", (0, 0, 0), (2, 2, 0)))
    assert {r["obj_name"] for r in S.outer_columns(o).collect()} == {"column_0", "column_1", "column_2", "column_3"}
    f = {r["obj_name"]: r for r in S.object_features(o).collect()}
    assert f["floor_9"]["point_density"] == 0 and f["column_0"]["element_type"] == "structural"
    assert S.room_volume(o).first()["volume"] == pytest.approx(16.0)


def test_grounding(spark):
    o = objects(spark, box(0, "wall", (0, 0, 0), (1, 1, 1)), box(1, "arch", (0, 0, 0), (1, 1, 1)))
    a = spark.createDataFrame([(1, "s", "quante pareti ci sono?", "There are 3 walls. The vault is high. No roof is seen."), (2, "s", "how many objects?", "2 objects: wall_0 and wall_7, contains nothing"), (3, "s", "quante classi?", "2"), (4, "s", "x", "")], "answer_id long, scene_id string, question string, answer string")
    got = {(r["answer_id"], r["kind"], r["detail"]) for r in K.all_issues(a, o).collect()}
    assert got == {(1, "absent_class_claimed_present", "vault"), (1, "object_count_mismatch", "3 / 1"), (2, "unknown_object_name", "wall_7"), (2, "invalid_relation_type", "contains")}
    res = spark.createDataFrame([("e", "x", 0, 1), (None, None, 0, 1), (None, "x", 2, 1), (None, "x", 0, 0), (None, "x", 0, 3)], "error string, final_answer string, n_issues int, n_tool_calls int")
    assert [r["reliability"] for r in K.reliability(res).collect()] == ["error", "unanswered", "ungrounded", "unverified_no_tool", "grounded"]


def test_scene_handle(spark):
    d = "/root/testdata/sf0.001"
    c = SceneContext(spark.read.parquet(f"{d}/objects.parquet"), None, spark.read.parquet(f"{d}/annotations.parquet"))
    assert all(hasattr(c, t) for t in TOOLS) and len(TOOLS) == 21
    one = c.scene("SC0000000")
    assert one.count_objects().count() == 1 and one.list_relationships(limit=5).count() <= 5
    assert one.find_relationships(semantic_label="wall").count() >= 0 and one.get_scene_statistics().first()["n_objects"] > 0
    with pytest.raises(ValueError):
        one.get_object_info("wall", "wall_0")
    with pytest.raises(ValueError):
        one.list_relationships("nonsense")
    p = spark.read.parquet(f"{d}/points.parquet")
    made = SceneContext.from_points(p, None, Parameters(sample_n=None))
    assert made.list_semantic_labels().count() > 0 and made.reload_scene(threshold=1.0).threshold == 1.0


def test_empty_objects(spark):
    o = objects(spark, box(0, "wall", (0, 0, 0), (1, 1, 1))).limit(0)
    assert R.relationships(o).count() == 0 and S.edges(R.relationships(o)).count() == 0 and R.auto_threshold(o).count() == 0
    assert S.components_of(o, R.relationships(o)).count() == 0 and R.anomalies(R.relationships(o)).count() == 0


def city(n=160, seed=4):
    """One scene of scattered boxes, some far away."""
    rng = np.random.default_rng(seed)
    spread = np.where(rng.random(n) < 0.9, 60.0, 3000.0)
    return [box(i, ["wall", "arch", "column", "vault"][i % 4], rng.uniform(-1, 1, 3) * [spread[i], spread[i], 10], rng.uniform(0.1, 6, 3), scene="ab"[i % 40 == 0]) for i in range(n)]


def test_searches_in_rings_find_the_same(spark):
    o = objects(spark, *city())
    near = [sorted(map(tuple, R.nearest_objects(o, o.filter("obj_ord % 9 = 0"), 7, label, small=small).collect())) for label in (None, "arch") for small in (10_000, 0)]
    assert near[0] == near[1] and near[2] == near[3] and len(near[0]) > 100
    for a, b in (("wall", "vault"), ("arch", "arch")):
        apart = [sorted(map(tuple, R.class_distance(o, a, b, small=small).collect())) for small in (10_000, 0)]
        assert apart[0] == apart[1] and apart[0]
    assert R.nearest_objects(o.limit(0), o, small=0).count() == 0 and R.class_distance(o.limit(0), "wall", "arch", small=0).count() == 0


def test_vertical_class_distance(spark):
    rows = city(60)
    got = {r["scene_id"]: (r["object_a"], r["object_b"], r["gap"]) for r in R.class_distance(objects(spark, *rows), "wall", "arch", vertical=True).collect()}
    gap = lambda a, b: max(b[11] - a[14], a[11] - b[14], 0.0) if not (a[11] <= b[14] and b[11] <= a[14]) else 0.0
    for scene, (a, b, d) in got.items():
        pairs = [(x, y) for x in rows for y in rows if x[1] == y[1] == scene and x[4] == "wall" and y[4] == "arch"]
        assert abs(d) <= min(abs(gap(x, y)) for x, y in pairs) + 1e-9 and any(x[3] == a and y[3] == b for x, y in pairs)


def test_matches_at_any_distance(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = city()
    notes = [(i, "ab"[i % 30 == 0], [None, "wall", "arch", "roof"][i % 4], *(float(v) for v in rng.uniform(-1, 1, 3) * (10.0 ** (i % 6))), None) for i in range(120)]
    notes[5] = (*notes[5][:5], None, None)
    a = A.prepared(spark.createDataFrame(notes, "annotation_id long, scene_id string, semantic_label string, global_box_center_x double, global_box_center_y double, global_box_center_z double, function string"))
    o = objects(spark, *rows)
    found = []
    for rings in (A.RINGS, [0.5]):
        monkeypatch.setattr(A, "RINGS", rings)
        found.append({r["annotation_id"]: (r["nearest_object"], round(r["distance_m"], 6)) for r in A.match_objects(a, o).collect() if r["nearest_object"]})
    assert found[0] == found[1] and len(found[0]) > 80
    for i, scene, label, x, y, z, _ in notes:
        at = [(np.linalg.norm([x - b[6], y - b[7], 0 if z is None else z - b[8]]), b[2], b[3]) for b in rows if b[1] == scene and label in (None, b[4])]
        assert (i in found[0]) == bool(at) and (not at or found[0][i] == (min(at)[2], round(float(min(at)[0]), 6)))


def test_threshold_for_each_scene(spark):
    rows = [box(i, "wall", (2.0 * (i % 5), 2.0 * (i // 5), 0), (0.2, 0.2, 0.2), scene="ab"[i % 2]) for i in range(40)]
    o = objects(spark, *rows)
    both = R.relationships(o, spark.createDataFrame([("a", 2.5), ("b", 9.0)], "scene_id string, threshold double"))
    for scene, limit in (("a", 2.5), ("b", 9.0)):
        assert kinds(both.filter(f"scene_id = '{scene}'")) == kinds(R.relationships(o.filter(f"scene_id = '{scene}'"), limit))
    c = SceneContext(o, parameters=Parameters(threshold=None))
    own = {r["scene_id"]: r["threshold"] for r in R.auto_threshold(o).collect()}
    for scene, limit in own.items():
        assert kinds(c.relationships.filter(f"scene_id = '{scene}'")) == kinds(R.relationships(o.filter(f"scene_id = '{scene}'"), limit))


def test_questions_are_answered_by_rows(spark):
    d = "/root/testdata/sf0.001"
    c = SceneContext(spark.read.parquet(f"{d}/objects.parquet"), None, spark.read.parquet(f"{d}/annotations.parquet")).scene("SC0000000")
    asked = c.ask("How many columns are there? What is the area and volume?")
    assert [(q, h) for q, h, _ in asked] == [("How many columns are there?", "count_of_class"), ("What is the area and volume?", "area_and_volume")]
    assert asked[0][2].first()["n"] == c.objects.filter("semantic_label = 'column'").count() and asked[1][2].count() == 1
    assert "no graph" in c.ask("Mostra il grafo L2")[0][2] and c.ask("Ciao") == [("Ciao", "unanswered", None)]
    assert [a for *_, a in c.ask("How many columns are there? Ciao?")] == [None, None]
    assert c.ask("sono ornamentali?", "column")[0][1] == "class_role" and c.ask("sono ornamentali?")[0][1] == "unanswered"
    from cloudmason.functions.text import PROMPTS

    questions = [*(p for p in PROMPTS if p.count("?") < 2), "Elencami gli archi", "Relazioni tra muri e archi", "Relazioni della classe muro", "Ci sono incongruenze?", "Elenca tutte le relazioni", "Does the wall support the arch?", "What supports the roof?", "Distance: wall to arch, nearest", "Give me the coordinates of the scene", "Quante classi semantiche?", "Which classes are present?", "The window opening: is it in the wall?", "Qual è l'impronta dei muri?"]
    for r in c.answer(spark.createDataFrame([(q,) for q in questions], "text string"), "text").collect():
        answer = c._answered(r)
        assert r["handler"] != "unanswered" and answer is not None and (isinstance(answer, str) or "scene_id" in answer.columns)
    nodes, edges = c.ontology_graph()
    assert nodes.count() > 0 and edges.count() > 0
    with pytest.raises(ValueError):
        SceneContext(c.objects).ontology_graph()
