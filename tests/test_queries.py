import math
import os
from glob import glob

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
FOUND = {"p1_found": ["line_id", "reason"], "p5_found": ["kind", "id_a", "id_b"]}
CORE = {k: v for k, v in entry.oracle_sql().items() if k in entry.registry.SQL}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, D)
    want = duck.sql(CORE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    for name, columns in FOUND.items():
        assert names[name](spark, D).columns == columns
    assert set(entry.oracle_sql()) <= set(names)


def test_scans_read_only_what_is_needed(spark):
    plan = entry.queries()["b1_objects_of_class"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(semantic_label), EqualTo(semantic_label,column)]" in plan and "cx" not in plan
