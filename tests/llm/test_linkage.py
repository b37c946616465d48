import numpy as np
import pytest

from cloudmason.llm import linkage as L
from cloudmason.llm.canonical import Canon, class_entries, map_values

CANON = Canon(class_entries([{"class_id": i, "semantic_label": n} for i, n in enumerate(["arch", "column", "moldings", "floor", "door_window", "wall", "stairs", "vault", "roof", "other"])]), range(10))
SCHEMA = "id long, grp string, label string, x double, y double, z double, material string, typology string, function string"
MATERIALS = [["dark granite", "granito scuro", "granit foncé"], ["lead sheet", "lamina di piombo", "feuille de plomb"], ["oak timber", "legno di rovere", "Eichenholz"], ["lime plaster", "intonaco di calce", "Kalkputz"], ["yellow tuff", "tufo giallo", "gelber Tuff"], ["wrought iron", "ferro battuto", "Schmiedeeisen"]]
TYPOLOGIES = [["ribbed", "costolonata"], ["paired", "binata"], ["plain", "semplice"], ["pointed", "ogivale"]]
KNOWN = MATERIALS + TYPOLOGIES


def side(spark, rows):
    return L.prepared(spark.createDataFrame(rows, SCHEMA), "label", lambda v, c: map_values(v, c, CANON))


def pairs(spark, a, b, known=KNOWN):
    return {(r["left_id"], r["right_id"]): r["confidence"] for r in L.link(side(spark, a), side(spark, b), known).collect()}


def scene(n=30, shift=(-0.9, 0.4, 0.2), seed=0):
    rng = np.random.default_rng(seed)
    labels, a, b = ["wall", "column", "vault"], [], []
    for i in range(n):
        xyz = np.array([4.0 * (i % 6), 4.0 * (i // 6), 7.0 * (i % 2)]) + rng.normal(0, 0.1, 3)
        m, t = rng.integers(0, 6), rng.integers(0, 4)
        label, fn = labels[i % 3], ["access", "light"][i % 2]
        a.append((i, "s", label.upper() + f"_{i}", *map(float, xyz), MATERIALS[m][i % 3] + ", of uncertain date", TYPOLOGIES[t][i % 2], fn))
        b.append((1000 + i, "s", label, *map(float, np.round(xyz + shift + rng.normal(0, 0.1, 3), 1)), MATERIALS[m][1], TYPOLOGIES[t][0], fn + "; other"))
    return a, b


def test_shifted_scene_units_and_repeats(spark):
    a, b = scene()
    a[3] = (*a[3][:3], a[3][3] * 1000, a[3][4] * 1000, a[3][5] * 1000, *a[3][6:])
    a.append((77, *a[5][1:]))
    b.append((1999, "s", "wall", 300.0, 300.0, 0.0, "lead sheet", "plain", None))
    got = pairs(spark, a, b)
    assert set(got) == {(i, 1000 + i) for i in range(30)} | {(77, 1005)} and all(0.5 <= c <= 1 for c in got.values())


def test_missing_centres_and_conflicts(spark):
    a, b = scene()
    a[7] = (7, "s", a[7][2], None, None, None, *a[7][6:])
    a[8] = (8, "s", a[8][2], 0.0, 0.0, 0.0, *a[8][6:])
    a[9] = (*a[9][:6], next(m[0] for m in MATERIALS if a[9][6].split(",")[0] not in m), next(t[0] for t in TYPOLOGIES if a[9][7] not in t), "circulation")
    a.append((50, None, "wall", 0.0, 0.0, 0.0, None, None, None))
    a.append((51, "s", None, None, None, None, None, None, None))
    got = pairs(spark, a, b)
    assert (7, 1007) in got and (8, 1008) in got and (9, 1009) not in got and not any(k[0] in (50, 51) for k in got)


def test_empty(spark):
    a, b = scene(4)
    assert L.link(side(spark, a).limit(0), side(spark, b)).count() == 0
    assert L.link(side(spark, a), side(spark, b).limit(0)).count() == 0


def objective(y, pro, con, hinges):
    return (pro * (1 - y) ** 2 + con * y**2).sum() + hinges.cost(y)


@pytest.mark.parametrize("seed", range(4))
def test_solver_reaches_the_optimum(seed):
    rng = np.random.default_rng(seed)
    n = 3
    pro, con = rng.uniform(0, 4, n), rng.uniform(0.1, 3, n)
    v = np.array([0, 1, 2, 1, 2, 2, 0])
    c = np.array([0.5, 0.5, 1.0, 1.0, -1.0, 1.0, 1.0])
    hinges = L.Hinges(np.array([0, 0, 0, 1, 1, 2, 2]), v, c, np.array([1.0, 0.1, 1.0]), rng.uniform(0.5, 6, 3))
    y = L.solve(pro, con, hinges)
    grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 51)] * 3), -1).reshape(-1, 3)
    best = min(objective(g, pro, con, hinges) for g in grid)
    assert objective(y, pro, con, hinges) <= best + 1e-6 and (y >= 0).all() and (y <= 1).all()
    assert np.allclose(L.solve(pro, con, L.Hinges.joined([])), pro / (pro + con))


def test_wide_groups_give_the_same_values(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a = [(i, "s", "wall", float(5 + i // 2), 5.0 + (i % 2), 0.0, MATERIALS[i % 3][0], None, None) for i in range(40)]
    b = [(1000 + i, "s", "wall", float(5 + i // 2 + rng.normal(0, 0.3)), 5.0 + (i % 2), 0.0, MATERIALS[i % 3][1], None, None) for i in range(40)]
    monkeypatch.setattr(L, "MATCH", 0.0)
    whole = pairs(spark, a, b)
    monkeypatch.setattr(L, "TASK_PAIRS", 5)
    parted = pairs(spark, a, b)
    assert len(whole) > 20 and set(whole) == set(parted)
    assert max(abs(whole[k] - parted[k]) for k in whole) < 1e-3


def test_a_far_shift_is_found(spark):
    a, b = scene(shift=(-8.0, 6.0, 1.0))
    assert set(pairs(spark, a, b)) == {(i, 1000 + i) for i in range(30)}


def test_wordings_are_learned(spark):
    """Without any list: wordings that stand together at near places mean the same, and tell records without a centre apart."""
    a, b = [], []
    for s in range(20):
        one, two = scene(30, (0.0, 0.0, 0.0), seed=s)
        a += [(1000 * s + r[0], f"s{s}", *r[2:]) for r in one]
        b += [(1000 * s + r[0], f"s{s}", *r[2:]) for r in two]
    meant = {}
    near = L.near_candidates(L.in_metres(side(spark, a), side(spark, b)), side(spark, b), L.RADIUS, ["k"])
    found = {r["node"]: r["head"] for r in L.same_wordings(near).collect()}
    from pyspark.sql import functions as F

    words = [(c, w, g[0]) for c, groups in (("mat", MATERIALS), ("typ", TYPOLOGIES)) for g in groups for w in g]
    for r in spark.createDataFrame(words, "c string, w string, g string").withColumn("w", L.wording(F.col("w"))).select("g", L.spoken_of("c", "w").alias("node")).collect():
        meant.setdefault(found.get(r["node"]), set()).add(r["g"])
    assert None not in meant and all(len(g) == 1 for g in meant.values()) and len(meant) == len(KNOWN)
    a[7] = (*a[7][:3], None, None, None, *a[7][6:])
    got, alike = pairs(spark, a, b, ()), {(r[0], r[0] + 1000) for r in a}
    assert (7, 1007) in got and len(alike - set(got)) <= 2 and len(set(got) - alike) <= 2


def crowd(n=120, seed=3):
    """Elements a metre apart, with inexact centres and attributes that are often missing; some have two records."""
    rng = np.random.default_rng(seed)
    a, b, true = [], [], set()
    for i in range(n):
        at = np.array([1.0 * (i % 12), 1.0 * (i // 12), 0.0])
        m, t, f = MATERIALS[rng.integers(6)], TYPOLOGIES[rng.integers(4)], ["access", "bearing", "lighting"][rng.integers(3)]
        some = lambda x: x if rng.random() < 0.8 else None
        put = lambda sd: tuple(float(v) for v in at + rng.normal(0, sd, 3) * [1, 1, 0.1])  # noqa: B023, E731
        a.append((i, "s", "wall", *put(0.3), some(m[0]), some(t[0]), some(f)))
        for k in range(1 + (rng.random() < 0.2)):
            b.append((1000 + 2 * i + k, "s", "wall", *put(0.2), some(m[1]), some(t[1]), some(f)))
            true.add((i, 1000 + 2 * i + k))
    return a, b, true


def test_the_rules_decide_where_elements_stand_close(spark):
    a, b, true = crowd()
    p = L.candidates(side(spark, a), side(spark, b), KNOWN).toPandas()
    pro, con = p["pro"].to_numpy(), p["con"].to_numpy()
    every = np.array(list(zip(p["id"], p["r_id"], strict=True)))
    found = {name: set(map(tuple, every[y >= L.MATCH])) for name, y in (("rules", L.solve(pro, con, L.rules(p))), ("none", pro / (pro + con)))}
    score = {name: 2 * len(got & true) / (len(got) + len(true)) for name, got in found.items()}
    print(len(true), {name: (len(got), len(got & true)) for name, got in found.items()}, score)
    assert score["rules"] > score["none"] + 0.1


def test_exclusivity_lowers_the_weaker(spark):
    a = [(1, "s", "wall", 5.0, 5.0, 0.0, "lead sheet", None, None)] + [(k + 10, "s", "wall", 10.0 * k, 50.0, 0.0, "oak timber", "plain", None) for k in range(6)]
    b = [(1001, "s", "wall", 5.1, 5.0, 0.0, "lead sheet", None, None), (1002, "s", "wall", 6.9, 5.0, 0.0, None, None, None)] + [(k + 1010, "s", "wall", 10.0 * k, 50.0, 0.0, "oak timber", "plain", None) for k in range(6)]
    got = pairs(spark, a, b)
    assert (1, 1001) in got and (1, 1002) not in got
