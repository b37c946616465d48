import struct

import numpy as np
import pytest

from cloudmason.sources import annotation_csv as C
from cloudmason.sources import sinks
from cloudmason.sources.las import LasSource, read_header
from cloudmason.sources.questions import read_questions
from cloudmason.streaming import ingest


def write_las(path, xyz, label, cls):
    """LAS 1.2, format 2 (colour), with semantic_label as an extra byte."""
    n, scale, size, offset = len(xyz), 0.001, 27, 227 + 54 + 192
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 2))
    struct.pack_into("<HII", head, 94, 227, offset, 1)
    struct.pack_into("<BHI", head, 104, 2, size, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, 100.0, 0.0, 0.0)
    vlr = bytearray(54)
    vlr[2:11] = b"LASF_Spec"
    struct.pack_into("<HH", vlr, 18, 4, 192)
    body = bytearray(192)
    body[2] = 1
    body[4:18] = b"semantic_label"
    rec = np.zeros((n, size), np.uint8)
    ints = np.round((xyz - [100.0, 0, 0]) / scale).astype("<i4")
    rec[:, :12] = ints.view(np.uint8).reshape(n, 12)
    rec[:, 15] = cls
    rec[:, 20:26] = np.tile(np.array([1, 2, 3], "<u2").view(np.uint8), (n, 1))
    rec[:, 26] = label
    path.write_bytes(bytes(head + vlr + body) + rec.tobytes())


def test_las(spark, tmp_path):
    rng = np.random.default_rng(0)
    xyz = np.round(rng.uniform(-50, 50, (2500, 3)), 3)
    label, cls = rng.integers(0, 10, 2500), rng.integers(0, 31, 2500)
    write_las(tmp_path / "a.las", xyz, label, cls)
    spark.dataSource.register(LasSource)
    df = spark.read.format("las").option("points_per_partition", 700).load(str(tmp_path / "*.las"))
    assert df.rdd.getNumPartitions() == 4
    got = df.toPandas().sort_values("row_idx")
    assert np.allclose(got[["x", "y", "z"]], xyz, atol=5e-4) and (got["semantic_label"] == label).all() and (got["classification"] == cls).all() and set(got["blue"]) == {3} and got["nx"].isna().all()
    raw = (tmp_path / "a.las").read_bytes()
    (tmp_path / "b.laz").write_bytes(raw[:104] + bytes([0x82]) + raw[105:])
    assert read_header(str(tmp_path / "b.laz")).compressed
    with pytest.raises(Exception, match="laspy"):
        spark.read.format("las").load(str(tmp_path / "b.laz")).count()


def test_annotation_files(spark, tmp_path):
    (tmp_path / "s_annotations.csv").write_bytes("Semantic Label;Global_Box_Center_X;y;Età\nporta;1,5;2;città\n;;;\n".encode("cp1252"))
    (tmp_path / "t.csv").write_text('label,x,y,note\n"wall,3,4,""a, b""",,,\narch,1,,"x\ny"\n', encoding="utf-8-sig")
    assert C.find_annotations(str(tmp_path / "s.laz")).endswith("s_annotations.csv") and C.find_annotations(str(tmp_path / "none.laz")) is None
    with pytest.raises(FileNotFoundError):
        C.find_annotations("x.laz", str(tmp_path / "missing.csv"))
    rows = {(r["source_csv"].rsplit("/", 1)[1], r["source_row"]): r for r in C.annotation_rows(C.read_annotation_files(spark, str(tmp_path))).collect()}
    a = rows["s_annotations.csv", 2]
    assert a["semantic_label"] == "porta" and a["global_box_center_x"] == 1.5 and a["attrs"]["eta"] == "città"
    b = rows["t.csv", 2]
    assert b["semantic_label"] == "wall" and b["global_box_center_y"] == 4.0 and b["attrs"]["note"] == "a, b" and rows["t.csv", 3]["attrs"]["note"] == "x\ny"


def test_questions(spark, tmp_path):
    (tmp_path / "q.txt").write_text("- Quante volte ci sono?\n1. What is above?\nno question\n2. quante  VOLTE ci sono?\n")
    assert {r["question"] for r in read_questions(spark, str(tmp_path / "q.txt")).collect()} == {"Quante volte ci sono?", "What is above?"}


def test_reports(spark, tmp_path):
    r = spark.createDataFrame([("q", "m", None, [("t", "{}", "a\nb", "as asked")], "ans", "ref", [("k", "d")], 1.0, None), ("q2", "m", None, None, None, None, None, None, "boom")], "question string, model string, chain_of_thought string, tool_calls array<struct<name:string,args:string,output:string,reasoning:string>>, final_answer string, reference_answer string, grounding_issues array<struct<kind:string,detail:string>>, latency_s double, error string")
    sinks.write_csv_report(r, str(tmp_path / "c"))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == sinks.CSV_COLUMNS and {x["reliability"] for x in back.collect()} == {"ungrounded", "error"}
    one = next(x for x in back.collect() if x["question"] == "q")
    assert one["trace"].split("\n")[:2] == ["1. Domanda: q", "2. Tool chiamato: t({})"] and one["trace"].endswith("4. Risposta finale: ans") and one["tool_call_reasoning"] == "t: as asked" and one["num_tool_calls"] == "1" and one["latency_s"] == "1.000"
    assert {x["trace"] for x in back.collect() if x["question"] == "q2"} == {"1. Domanda: q2\n2. Errore: boom"}
    sinks.write_json_report(r, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_stream(spark, tmp_path):
    pts = spark.read.parquet("/root/testdata/sf0.001/points.parquet")
    pts.write.parquet(str(tmp_path / "in"))
    q = ingest.class_counts(ingest.point_stream(spark, str(tmp_path / "in"), pts.schema)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").count() > 0
    c = ingest.cluster_scenes(ingest.point_stream(spark, str(tmp_path / "in"), pts.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    c.awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
