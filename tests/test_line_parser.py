import math
import random

import pytest

from cloudmason.operators.line_parser import SHEET_ERRORS, RowPattern, parse_lines, rejects, valid_rows

HEADER = "semantic_label,global_box_center_x,global_box_center_y,global_box_center_z,material,typology,function,description"
LINES = "line_id long, source_csv string, source_row int, raw_line string"


def brute(header: str, line: str) -> str | None:
    """The rules of the problem, character by character."""
    header = header.rstrip("\r")
    sep = max(",;\t|", key=header.count)
    columns = header.split(sep)
    line = line[:-1] if line.endswith("\r") else line

    def cells(text):
        out, i = [], 0
        while True:
            if text[i : i + 1] == '"':
                j, value = i + 1, ""
                while True:
                    k = text.find('"', j)
                    if k < 0:
                        return None
                    value += text[j:k]
                    if text[k + 1 : k + 2] == '"':
                        value += '"'
                        j = k + 2
                        continue
                    i = k + 1
                    break
            else:
                k = text.find(sep, i)
                k = len(text) if k < 0 else k
                value = text[i:k]
                if '"' in value:
                    return None
                i = k
            out.append(value)
            if i == len(text):
                return out
            if text[i] != sep:
                return None
            i += 1

    got = cells(line)
    if got is not None and len(got) == 1 and line[:1] == '"' and len(columns) > 1:
        inner = cells(got[0])
        if inner is not None and len(inner) == len(columns):
            got = inner
    if got is None:
        return "quoting"
    if len(got) != len(columns):
        return "column_count"
    for name, value in zip(columns, got, strict=True):
        if any(ord(c) < 32 and c not in "\t\n\r" or 127 <= ord(c) < 160 for c in value) or value.strip().upper() in SHEET_ERRORS:
            return "invalid_value"
        if name.startswith("global_box") and value.strip():
            v = value.strip().removeprefix("+") if value.strip()[:1] == "+" else value.strip().removeprefix("-")
            whole, _, part = v.replace(",", ".").partition(".")
            if not (whole.isascii() and whole.isdigit()) or (("." in v or "," in v) and not (part.isascii() and part.isdigit())):
                return "invalid_value"
    return None


CASES = [
    ("wall,1.5,-2,+3,stone,plain,,ok", None, None),
    ('"wall","1,5"," 2 ","","a ""b"" c",,,"x\ny"', None, None),
    ("wall,1.5,2,3,stone,plain,,ok\r", None, None),
    ('wall,1,2,3,sto"ne,plain,,ok', "quoting", "material"),
    ('wall,1,2,3,"stone,plain,,ok', "quoting", "material"),
    ("wall,1,2,3,stone,plain,ok", "column_count", "description"),
    ("wall,1,2,3,stone,plain,,ok,more", "column_count", "description"),
    ("wall,1.2.3,2,3,stone,plain,,ok", "invalid_value", "global_box_center_x"),
    ("wall,1,12 m,3,stone,plain,,ok", "invalid_value", "global_box_center_y"),
    ("wall,1,2,.5,stone,plain,,ok", "invalid_value", "global_box_center_z"),
    ("wall,1,2,3,#REF!,plain,,ok", "invalid_value", "material"),
    ("wall,1,2,3,sto\x02ne,plain,,ok", "invalid_value", "material"),
    ('"wall,1,2,3,""a, b"",plain,,ok"', None, None),
    ('"wall,1,2,3"', "column_count", "global_box_center_x"),
    ("", "column_count", "global_box_center_x"),
    ("# note", "column_count", "global_box_center_x"),
]


@pytest.mark.parametrize(("line", "reason", "field"), CASES)
def test_reason_and_field(line, reason, field):
    got = RowPattern(HEADER).read(line)
    assert got[:2] == (reason, field)
    assert brute(HEADER, line) == reason


def test_against_brute_force_on_random_lines():
    rng = random.Random(1)
    for sep in ",;":
        header = HEADER.replace(",", sep)
        pattern = RowPattern(header)
        for _ in range(4000):
            cells = [rng.choice(["wall", "", '"a"', '"a""b"', 'a"b', "1,5", "1.5", "#N/A", "x\x07", '"open', '"a" ', "+3", "1e5", '"1,5"', '" #REF! "', "a\nb"]) for _ in range(rng.choice([7, 8, 8, 8, 9]))]
            line = sep.join(cells)
            line = '"' + line.replace('"', '""') + '"' if rng.random() < 0.1 else line
            assert pattern.read(line)[0] == brute(header, line), line


def test_table(spark):
    rows = [(1, "a", 1, HEADER), (2, "a", 2, "wall,\"1,5\",2,3,stone,plain,,ok"), (3, "a", 3, None), (4, "a", None, "x"), (5, "b", 2, "wall"), (6, None, 2, "wall"), (7, "a", 4, "wall,1,2,3," + "s" * 300_000 + ",,,"), (7, "a", 4, "wall,1,2,3,\"" + 'q""' * 50_000 + "\",,,"), (8, "a", 1, "other,header")]
    df = spark.createDataFrame(rows, LINES).selectExpr("*", "'clash' header", "1 salt", "'x' raw", "2 reason")
    got = {(r["line_id"], r["reason"]) for r in parse_lines(df).collect()}
    assert got == {(2, None), (3, "column_count"), (4, "column_count"), (5, "no_header"), (6, "no_header"), (7, None)}
    valid = {r["line_id"]: r for r in valid_rows(parse_lines(df)).collect()}
    assert valid[2]["global_box_center_x"] == 1.5 and valid[2]["material"] == "stone"
    assert rejects(parse_lines(df)).count() == 4
    assert parse_lines(df.limit(0)).count() == 0


def test_real_lines_against_brute_force(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/annotation_lines.parquet")
    rows = lines.collect()
    headers = {r["source_csv"]: r["raw_line"] for r in rows if r["source_row"] == 1}
    want = {r["line_id"]: brute(headers[r["source_csv"]], r["raw_line"]) for r in rows if r["source_row"] != 1}
    got = {r["line_id"]: r["reason"] for r in parse_lines(lines).collect()}
    assert got == want and any(want.values()) and not math.isnan(len(got))
