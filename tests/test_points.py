import itertools

import numpy as np
import pandas as pd
import pytest

from cloudmason.operators import points as P
from cloudmason.operators.components import join_labels
from cloudmason.operators.point_grid import components


def naive_dbscan(xyz, order, eps, least):
    """Clusters as the sequential algorithm makes them: numbered by first core row, borders to the lowest number."""
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= least
    label, number = np.full(len(xyz), -1), 0
    for i in np.argsort(order):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = number
            while stack:
                j = stack.pop()
                for k in np.flatnonzero(d[j] & core & (label < 0)):
                    label[k] = number
                    stack.append(k)
            number += 1
    out = label.copy()
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        out[i] = near.min() if len(near) else -1
    n = np.bincount(out[out >= 0], minlength=number)
    return np.where((out >= 0) & (n[np.maximum(out, 0)] >= least), out, -1)


@pytest.mark.parametrize(("seed", "hot"), [(0, 400_000), (1, 400_000), (1, 40)])
def test_dbscan_against_the_sequential_algorithm(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(P, "HOT_TILE", hot)  # tiles that are cut give the same clusters
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-20, 40, (12, 3))
    xyz = np.concatenate([c + rng.normal(0, 0.5, (60, 3)) for c in centres] + [rng.uniform(-20, 40, (200, 3)), np.column_stack([np.linspace(-18, 34, 600), np.zeros(600), np.zeros(600)])])
    rng.shuffle(xyz)
    n = len(xyz)
    row = rng.permutation(n)
    p = pd.DataFrame({"point_id": np.arange(n) + 1000, "scene_id": "s", "label": "wall", "row_idx": row, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
    got = {r["point_id"] - 1000: r["cluster_id"] for r in P.dbscan(spark.createDataFrame(p), 0.6, 6).collect()}
    want = naive_dbscan(xyz, row, 0.6, 6)
    assert got == {i: int(c) for i, c in enumerate(want) if c >= 0} and len(set(got.values())) > 5


def test_dbscan_border_point_joins_the_lower_cluster(spark):
    left, right = [(i, -0.9 + 0.01 * i, 0.0, 0.0) for i in range(5)], [(10 + i, 0.9 - 0.01 * i, 0.0, 0.0) for i in range(5)]
    rows = [("s", "wall", i, i, x, y, z) for i, x, y, z in [*right, *left, (20, 0.0, 0.0, 0.0)]]
    df = spark.createDataFrame(rows, "scene_id string, label string, point_id long, row_idx long, x double, y double, z double")
    got = {r["point_id"]: r["cluster_id"] for r in P.dbscan(df, 0.95, 5).collect()}
    assert got[0] == 0 and got[10] in (0, 1) and got[20] == 0
    assert P.dbscan(df.limit(0), 0.95, 5).count() == 0


CUBE = np.array(list(itertools.product((0.0, 1.0), repeat=3)))


def test_hull():
    assert abs(P.hull_area(CUBE) - 6) < 1e-9
    assert abs(P.hull_area(np.concatenate([CUBE, CUBE, np.random.default_rng(0).uniform(0.1, 0.9, (300, 3))])) - 6) < 1e-9
    assert P.hull_area(CUBE[:3]) == 0 and P.hull_area(np.array([[i, j, 0.0] for i in range(5) for j in range(5)])) == 0
    assert abs(P.hull_area(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])) - (1.5 + np.sqrt(3) / 2)) < 1e-9
    ball = np.random.default_rng(1).normal(size=(800, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    assert 12.0 < P.hull_area(ball) < 4 * np.pi


def test_surface_area_of_parts(spark):
    ball = np.random.default_rng(1).normal(size=(900, 3))
    p = pd.DataFrame({"point_id": np.arange(900), "x": ball[:, 0], "y": ball[:, 1], "z": ball[:, 2]})
    c = pd.DataFrame({"point_id": np.arange(900), "scene_id": "s", "obj_name": "wall_0"})
    got = P.surface_areas(spark.createDataFrame(p), spark.createDataFrame(c), part_rows=100).first()["surface_area"]
    assert abs(got - P.hull_area(ball)) < 1e-9


def test_voxel_sample(spark):
    rng = np.random.default_rng(3)
    n = 3000
    p = pd.DataFrame({"point_id": np.arange(n), "scene_id": rng.choice(["a", "b"], n), "label": rng.choice(["wall", "roof", "arch"], n, p=[0.8, 0.19, 0.01]), "row_idx": np.arange(n), "x": rng.uniform(0, 3, n), "y": rng.uniform(0, 3, n), "z": rng.uniform(0, 3, n)})
    got = P.voxel_sample(spark.createDataFrame(p), 200).toPandas()
    assert (got.groupby("scene_id").size() <= 200).all() and got["point_id"].is_unique and set(got["label"]) == {"wall", "roof", "arch"}
    v = got.merge(p, on="point_id").assign(v=lambda d: list(zip(np.floor(d.x / 0.05), np.floor(d.y / 0.05), np.floor(d.z / 0.05), strict=True)))
    assert not v.duplicated(["scene_id_x", "label_x", "v"]).any()
    again = P.voxel_sample(spark.createDataFrame(p.sample(frac=1, random_state=1)).repartition(7), 200).toPandas()
    assert set(again["point_id"]) == set(got["point_id"])


def test_components(spark):
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    label = components(400, u, v)
    chain = [(i, i + 1) for i in range(1000, 1120)]
    links = spark.createDataFrame([*zip(map(int, u), map(int, v), strict=True), *chain, *[(5000, k) for k in range(5001, 5200)]], "a long, b long")
    got = {r["node"]: r["head"] for r in join_labels(links).collect()}
    assert all(got.get(i, i) == label[i] for i in range(400))
    assert all(got[i] == 1000 for i in range(1001, 1121)) and got[5199] == 5000
    assert join_labels(links.limit(0)).count() == 0


def test_columns_of_the_cloud(spark):
    df = spark.createDataFrame([(1, "s", 0, 1.0, 2.0, 3.0, None, 4), (2, "s", 1, float("nan"), 2.0, 3.0, 7, 4), (3, "s", 2, 1.0, 1.0, 1.0, None, None), (4, "s", 3, 1.0, 1.0, 1.0, 99, 1)], "point_id long, scene_id string, row_idx long, x float, y float, z float, semantic_label int, classification int")
    p = P.projected(df)
    assert {r["point_id"]: r["label"] for r in P.decoded(p).collect()} == {1: "door_window", 2: "vault"}
    assert {r["code"]: r["n"] for r in P.undecoded(p).collect()} == {None: 1, 99: 1}
    with pytest.raises(ValueError):
        P.projected(df.drop("semantic_label", "classification"))
