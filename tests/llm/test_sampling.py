import numpy as np
import pandas as pd

from cloudmason.llm import sampling as S

PLAN = "plan_id long, grp string, category int, target_pct int, sample_size long, min_rows int"


def points(n=6000, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"grp": "s", "unit": np.arange(n), "id": rng.permutation(n), "category": rng.choice([0, 1, 2, 3], n, p=[0.9, 0.08, 0.015, 0.005])})


def test_shares_floors_and_report(spark):
    p = points()
    df = spark.createDataFrame(pd.concat([p, p.iloc[:500].assign(id=lambda d: d.id + 10_000)]))
    plan = spark.createDataFrame([(1, "s", c, t, 1000, 40) for c, t in enumerate((50, 30, 18, 2))] + [(2, "none", 0, 100, 50, 5), (3, "s", 0, 90, 300, 0), (3, "s", 1, 10, 300, 0)], PLAN)
    sample, report = S.draw(df, plan)
    got, rep = sample.toPandas(), {(r["plan_id"], r["category"]): r for r in report.collect()}
    n = p.groupby("category").size()
    assert not got.duplicated(["plan_id", "unit"]).any()
    sizes = got.groupby(["plan_id", "category"]).size().to_dict()
    assert all(sizes.get(k, 0) == r["drawn"] for k, r in rep.items())
    assert sum(v for k, v in sizes.items() if k[0] == 1) == 1000 and abs(sizes[3, 0] - 270) <= 1 and sizes[3, 0] + sizes[3, 1] == 300
    assert sizes[1, 3] == min(40, n[3]) and sizes[1, 2] == min(n[2], sizes[1, 2])
    assert rep[1, 2]["unmet"] == (n[2] < 180) and rep[1, 3]["unmet"] == (n[3] < 40) and rep[2, 0]["unmet"] and rep[2, 0]["drawn"] == 0
    assert got[got.plan_id == 1].merge(p, on="unit")["id_y"].eq(got[got.plan_id == 1].merge(p, on="unit")["id_x"]).all()  # the reading of smallest id


def test_sample_is_spread_evenly(spark):
    p = points(20_000, 1)
    plan = spark.createDataFrame([(k, "s", 0, 100, 900, 0) for k in range(12)], PLAN)
    got = S.draw(spark.createDataFrame(p), plan)[0].toPandas()
    thirds = np.histogram(got["unit"], bins=3, range=(0, 20_000))[0] / len(got)
    assert np.abs(thirds - 1 / 3).max() < 0.03 and got.groupby("plan_id").size().eq(900).all()


def test_waterfill():
    a = S.waterfill(np.array([5.0, 5, 90]), np.array([20.0, 20, 0]), np.array([100.0, 10, 40]), 100)
    assert np.allclose(a, [50, 10, 40], atol=1e-6)
    assert np.allclose(S.waterfill(np.array([1.0, 1]), np.array([30.0, 30]), np.array([50.0, 50]), 40), [30, 30])


def test_missing_values_and_empty(spark):
    schema = "grp string, unit long, id long, category int"
    df = spark.createDataFrame([("s", 1, 1, None), (None, 2, 2, 0), ("s", None, 3, 0), ("s", None, 4, 0), ("s", 3, 5, 0)], schema).selectExpr("*", "1 rank", "2 plan_id", "3 salt")
    plan = spark.createDataFrame([(1, "s", 0, 100, 2, 1), (1, "s", 0, 100, 2, 1), (2, "s", 1, 100, 10, 1)], PLAN)
    sample, report = S.draw(df, plan)
    assert sample.count() == 2 and report.count() == 2
    assert S.draw(df.limit(0), plan)[1].filter("unmet").count() == 2 and S.draw(df, plan.limit(0))[0].count() == 0
