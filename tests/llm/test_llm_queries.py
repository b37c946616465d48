import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
COLUMNS = {"p2_found": ["annotation_id", "record_id"], "p3_found": ["plan_id", "class_id"], "p4_found": ["annotation_id", "class_id"], "p6_found": ["head_id", "point_id"], "p7_found": ["annotation_id", "field_name"], "p10_found": ["doc_id", "lang_found"]}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n[0] == "p" and n[1:2].isdigit() and n.split("_")[0] not in ("p1", "p5")))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, D)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    assert df.count() > 0
