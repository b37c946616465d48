import numpy as np
import pandas as pd
import pytest

from cloudmason.operators import spatial_join as J


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def some_points(n, seed, groups=3):
    rng = np.random.default_rng(seed)
    xyz = np.round(rng.normal(0, 6, (n, 3)), 2)
    return pd.DataFrame({"grp": [f"g{k}" for k in rng.integers(0, groups, n)], "id": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})


def brute_near(p, r):
    out = set()
    for _, g in p.groupby("grp"):
        xyz, ids = g[["x", "y", "z"]].to_numpy(), g["id"].to_numpy()
        for i in range(len(g)):
            d = np.sqrt(((xyz - xyz[i]) ** 2).sum(1))
            out |= {(int(ids[i]), int(j)) for j in ids[(d <= r) & (ids > ids[i])]}
    return out


@pytest.mark.parametrize("blocks", [100_000, 40])
def test_near_pairs_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(J, "BLOCK_ROWS", blocks)
    p = some_points(700, 3)
    got = [(r["left_id"], r["right_id"]) for r in J.near_pairs(spark.createDataFrame(p), 1.5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(p, 1.5)


def test_borders_and_missing_values(spark):
    rows = [("a", 1, 0.0, 0.0, 0.0), ("a", 2, 3.0, 0.0, 0.0), ("a", 3, 3.0000001, 0.0, 0.0), ("a", 4, None, 0.0, 0.0), ("a", 5, float("nan"), 0.0, 0.0), (None, 6, 0.0, 0.0, 0.0), ("b", 7, 0.0, 0.0, 0.0), ("a", 8, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "grp string, id long, x double, y double, z double").selectExpr("*", "1 leaf", "2 side", "3 lo_x")
    got = {(r["left_id"], r["right_id"]) for r in J.near_pairs(df, 3.0).collect()}
    assert got == {(1, 2), (1, 8), (2, 3), (2, 8)}
    assert J.near_pairs(df.limit(0), 3.0).count() == 0


def test_containing_boxes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    p = some_points(400, 6)
    lo = np.round(rng.normal(0, 6, (150, 3)), 2)
    hi = lo + np.round(rng.uniform(0, 8, (150, 3)), 2)
    b = pd.DataFrame({"grp": [f"g{k}" for k in rng.integers(0, 3, 150)], "id": np.arange(150), **{f"lo_{c}": lo[:, i] for i, c in enumerate("xyz")}, **{f"hi_{c}": hi[:, i] for i, c in enumerate("xyz")}})
    p.loc[0, ["grp", "x", "y", "z"]] = [b.loc[0, "grp"], lo[0, 0], lo[0, 1], hi[0, 2]]
    want = {(int(r.id), int(s.id)) for r in p.itertuples() for s in b[b.grp == r.grp].itertuples() if s.lo_x <= r.x <= s.hi_x and s.lo_y <= r.y <= s.hi_y and s.lo_z <= r.z <= s.hi_z}
    got = [(r["left_id"], r["right_id"]) for r in J.containing_boxes(spark.createDataFrame(p), spark.createDataFrame(b)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (0, 0) in want


def test_repeated_rows_give_their_pairs(spark):
    p = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0)] * 2, "grp string, id long, x double, y double, z double")
    b = spark.createDataFrame([("a", 9, -1.0, -1.0, -1.0, 1.0, 1.0, 1.0)] * 3, "grp string, id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    assert J.containing_boxes(p, b).count() == 6


def test_quadtree_places_every_point_once():
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(0, 1, (5000, 2)), rng.uniform(-1e6, 1e6, (50, 2))])
    tree = J.QuadTree.grow(xy, 0.01)
    q = np.concatenate([xy, rng.uniform(-1e9, 1e9, (500, 2))])
    rows, leaves = tree.place(q, q)
    assert len(tree.child) > 100 and np.array_equal(np.sort(rows), np.arange(len(q))) and leaves.min() >= 0


def test_rtree_probe_finds_all():
    rng = np.random.default_rng(2)
    lo = rng.uniform(0, 10, (3000, 3))
    group = rng.integers(0, 4, 3000)
    hi = lo + rng.uniform(0, 0.5, lo.shape)
    qlo = rng.uniform(0, 10, (200, 3))
    qhi, qg = qlo + 0.3, rng.integers(0, 4, 200)
    want = {(i, j) for i in range(200) for j in np.flatnonzero((group == qg[i]) & np.all((lo <= qhi[i]) & (hi >= qlo[i]), axis=1))}
    got = [(int(a), int(b)) for q, r in J.RTree(group, lo, hi).probe(qg, qlo, qhi) for a, b in zip(q, r, strict=True)]
    assert len(got) == len(want) and set(got) == want
