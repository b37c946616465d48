import numpy as np
import pandas as pd
import pytest

from cloudmason.llm import clusters as C


def brute(p, radius, least):
    out = set()
    for _, g in p.dropna().groupby(["grp", "code"]):
        xyz, ids = g[["x", "y", "z"]].to_numpy(), g["id"].to_numpy()
        near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= radius**2
        label = np.full(len(g), -1)
        for i in range(len(g)):
            if label[i] < 0:
                stack = [i]
                label[i] = i
                while stack:
                    for k in np.flatnonzero(near[stack.pop()] & (label < 0)):
                        label[k] = i
                        stack.append(k)
        for k in np.unique(label):
            own = ids[label == k]
            if len(own) >= least:
                out |= {(int(own.min()), int(i)) for i in own}
    return out


def cloud(seed, n=1500):
    rng = np.random.default_rng(seed)
    walk = np.cumsum(rng.normal(0, 0.3, (500, 3)), axis=0) + [15, 15, 15]
    xyz = np.round(np.concatenate([rng.uniform(-20, 50, (8, 3))[rng.integers(0, 8, n)] + rng.normal(0, 0.8, (n, 3)), walk, rng.uniform(-20, 50, (300, 3)), np.column_stack([np.arange(0, 60, 0.5), np.zeros(120), np.zeros(120)])]), 3)
    m = len(xyz)
    return pd.DataFrame({"grp": rng.choice(["a", "b"], m, p=[0.8, 0.2]), "code": rng.integers(0, 2, m).astype("int32"), "id": rng.permutation(m), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})


@pytest.mark.parametrize("hot", [400_000, 100])
def test_bodies_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT_TILE", hot)
    p = cloud(1)
    got = [(r["head"], r["id"]) for r in C.find_bodies(spark.createDataFrame(p)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(p, 0.5, 15)


def test_kernel_on_many_groups_and_crowded_places():
    rng = np.random.default_rng(2)
    xyz = np.concatenate([np.zeros((3000, 3)), rng.uniform(0, 6, (2000, 3))])
    group = np.r_[np.zeros(3000, int), rng.integers(0, 3, 2000)]
    label, degree = C.bodies(group, xyz)
    assert len(np.unique(label[:3000])) == 1 and (degree >= 0).all()
    plain = C._closed(C.Cells(group, xyz, 0.5 * (1 + 1e-9)), group, xyz, 0.5, np.arange(len(xyz)))
    assert len(np.unique(plain)) == len(np.unique(label)) == len(np.unique(plain * 10_000 + label))
    assert len(C.bodies(np.zeros(0, int), np.zeros((0, 3)))[0]) == 0


def test_graph_is_close_to_the_true_neighbours():
    rng = np.random.default_rng(3)
    xyz = rng.uniform(0, 3, (3000, 3))
    group = np.zeros(3000, int)
    near, dist = C.neighbour_graph(C.Cells(group, xyz, 0.5), group, xyz, 0.5)
    true = np.argsort(((xyz[:, None] - xyz[None]) ** 2).sum(2), axis=1)[:, 1 : C.NEIGHBOURS + 1]
    recall = np.mean([len(set(a) & set(b)) / C.NEIGHBOURS for a, b in zip(near, true, strict=True)])
    assert recall > 0.3 and np.isfinite(dist).mean() > 0.9  # the rest of the links comes from the exact check


def test_communities_find_two_cliques():
    a = [(i, j) for i in range(8) for j in range(i)]
    u, v = np.array(a + [(i + 8, j + 8) for i, j in a] + [(0, 8)]).T
    label = C.communities(16, np.zeros(16, int), u, v, np.ones(len(u)))
    assert len(set(label[:8]) & set(label[8:])) == 0


def test_missing_values_and_empty(spark):
    rows = [("a", 1, i, 0.1 * i, 0.0, 0.0) for i in range(20)] + [(None, 1, 30, 0.0, 0.0, 0.0), ("a", None, 31, 0.0, 0.0, 0.0), ("a", 1, 32, float("nan"), 0.0, 0.0), ("a", 1, 33, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "grp string, code int, id long, x double, y double, z double").selectExpr("*", "1 key", "2 own", "3 body", "4 head")
    got = C.find_bodies(df)
    assert {(r["head"], r["id"]) for r in got.collect()} == {(0, i) for i in range(20)}
    d = C.describe_bodies(got).first()
    assert d["n_points"] == 20 and len(d["typical_points"].split(",")) == 3
    assert C.find_bodies(df.limit(0)).count() == 0


def test_descent_settles_near_all_true_neighbours():
    xyz = np.concatenate([cloud(4)[["x", "y", "z"]].to_numpy(), np.random.default_rng(4).uniform(0, 3, (2000, 3))])
    group = np.arange(len(xyz)) % 2
    _, dist = C.neighbour_graph(C.Cells(group, xyz, 0.5), group, xyz, 0.5)
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    d[(group[:, None] != group[None]) | np.eye(len(xyz), dtype=bool) | (d > 0.25)] = np.inf
    true = np.sort(d, axis=1)[:, : C.NEIGHBOURS]
    found = np.isfinite(true) & (np.sort(dist, axis=1) <= true * (1 + 1e-4) + 1e-6)
    assert found.sum() > 0.9 * np.isfinite(true).sum()


def test_communities_settle():
    """No node gains modularity by moving alone; a ring of cliques comes apart at its links."""
    cliques = [(8 * c + i, 8 * c + j) for c in range(30) for i in range(8) for j in range(i)] + [(8 * c, (8 * c + 9) % 240) for c in range(30)]
    rng = np.random.default_rng(5)
    noise = np.unique(np.sort(rng.integers(240, 640, (1600, 2)), axis=1), axis=0)
    u, v = np.concatenate([cliques, noise[noise[:, 0] != noise[:, 1]]]).T
    w, group = rng.uniform(0.5, 1, len(u)), (np.arange(640) >= 240).astype(int)
    degree = np.bincount(np.r_[u, v], np.r_[w, w], 640)
    label = C._settled(640, group, u, v, w, degree, np.bincount(group, degree))
    total, weight = np.bincount(label, degree, 640), np.bincount(group, degree)
    links = np.zeros((640, 640))
    np.add.at(links, (np.r_[u, v], label[np.r_[v, u]]), np.r_[w, w])
    gain = links - degree[:, None] * (total[None] - (label[:, None] == np.arange(640)) * degree[:, None]) / weight[group][:, None]
    wins = (gain - gain[np.arange(640), label][:, None] > 1e-6) & (links > 0)
    assert not wins.any()
    found = C.communities(640, group, u, v, w)[:240].reshape(30, 8)
    assert (found == found[:, :1]).all()


def test_degree_does_not_depend_on_tiles(spark, monkeypatch):
    df = spark.createDataFrame(cloud(6))
    wide = {r["id"]: r["degree"] for r in C.find_bodies(df).collect()}
    monkeypatch.setattr(C, "TILE", 3.0)
    small = {r["id"]: r["degree"] for r in C.find_bodies(df).collect()}
    assert wide.keys() == small.keys() and np.mean([abs(wide[i] - small[i]) < 2e-3 for i in wide]) > 0.99


def test_described_bodies_against_pandas(spark):
    p = cloud(7)
    found = C.find_bodies(spark.createDataFrame(p)).cache()
    rows = found.toPandas()
    rows["d"] = rows["degree"].astype(float).round(3)
    got = {r["head"]: (r["n_points"], r["typical_points"]) for r in C.describe_bodies(found).collect()}
    assert set(got) == set(rows["head"])
    for head, own in rows.groupby("head"):
        best = own.sort_values("id").set_index("id")["d"]
        named = [int(i) for i in got[head][1].split(",")]
        assert got[head][0] == len(own) == own["n_points"].iloc[0]
        assert np.allclose(best.loc[named], best.sort_values(ascending=False).iloc[:3], atol=2e-3)
