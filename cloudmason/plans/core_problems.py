"""Queries of the core problems: rows that fail to parse, points near points or in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmason.operators.line_parser import SEPARATORS, SHEET_ERRORS, parse_lines, rejects, valid_rows
from cloudmason.operators.spatial_join import containing_boxes, near_pairs

NEAR_M = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(parse_lines(table(spark, sf_dir, "annotation_lines"))).select("line_id", "reason")


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(parse_lines(table(spark, sf_dir, "annotation_lines")))


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(parse_lines(table(spark, sf_dir, "annotation_lines"))).drop("other_fields")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "objects").select(F.col("scene_id").alias("grp"), F.col("object_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return near_pairs(o, NEAR_M)


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "annotations").select(F.col("scene_id").alias("grp"), F.col("annotation_id").alias("id"), *(F.col(f"global_box_center_{c}").alias(c) for c in "xyz"))
    o = table(spark, sf_dir, "objects").select(F.col("scene_id").alias("grp"), F.col("object_id").alias("id"), *(F.col(f"min_{c}").alias(f"lo_{c}") for c in "xyz"), *(F.col(f"max_{c}").alias(f"hi_{c}") for c in "xyz"))
    return containing_boxes(a, o)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda d, kind: d.select(F.lit(kind).alias("kind"), F.col("left_id").alias("id_a"), F.col("right_id").alias("id_b"))
    return pair(_near(spark, sf_dir), "near").unionByName(pair(_inside(spark, sf_dir), "inside"))


def p5_near_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select(F.col("grp").alias("scene_id"), F.col("left_id").alias("id_a"), F.col("right_id").alias("id_b"), F.round("measure", 6).alias("distance_m"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_valid, p5_found, p5_near_distance)}

_SHEET = "|".join(e.replace("/", "\\/").replace("?", "\\?").replace("#", "\\#") for e in SHEET_ERRORS)
_BLANK = "[\\s\\x{00A0}]*"


def _rejects_of(mark: str) -> str:
    """Lines of the files with this separator, judged cell by cell."""
    sep = f"\\x{{{ord(mark):02X}}}"
    cell = f'"[^"]*(?:""[^"]*)*"|[^"{sep}]*'
    structure, whole = f"^(?:{cell})(?:{sep}(?:{cell}))*$", '^"[^"]*(?:""[^"]*)*"$'
    cells = lambda c: f"regexp_extract_all(chr({ord(mark)}) || {c}, '{sep}({cell})', 1)"
    fits = lambda c: f"regexp_full_match({c}, '(?s)(?:{cell})(?:{sep}(?:{cell}))*')"
    number, plain = f"{_BLANK}(?:[+-]?[0-9]+(?:[.,][0-9]+)?)?{_BLANK}", f"{_BLANK}(?:[+-]?[0-9]+(?:[.{'' if mark == ',' else ','}][0-9]+)?)?{_BLANK}"
    bad = f"""CASE WHEN columns[i] IN ('global_box_center_x', 'global_box_center_y', 'global_box_center_z') THEN NOT regexp_full_match(cs[i], '(?s)"{number}"|{plain}')
        ELSE regexp_matches(cs[i], '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]') OR regexp_full_match(upper(cs[i]), '(?s)"?{_BLANK}(?:{_SHEET.upper()}){_BLANK}"?') END"""
    return f"""SELECT line_id, reason FROM (
        SELECT line_id, CASE WHEN line IS NULL THEN 'column_count' WHEN NOT {fits('line')} THEN 'quoting' WHEN len(cs) <> len(columns) THEN 'column_count'
            WHEN len(list_filter(generate_series(1, len(columns)), lambda i: {bad})) > 0 THEN 'invalid_value' END AS reason
        FROM (SELECT *, {cells('line')} AS cs FROM (
            SELECT line_id, columns, CASE WHEN len(columns) > 1 AND regexp_full_match(raw, '(?s)"[^"]*(?:""[^"]*)*"') AND {fits('inner_line')} AND len({cells('inner_line')}) = len(columns) THEN inner_line ELSE raw END AS line
            FROM (SELECT *, replace(substring(raw, 2, greatest(len(raw) - 2, 0)), '""', '"') AS inner_line FROM judged WHERE sep = chr({ord(mark)}))))) WHERE reason IS NOT NULL"""


_COUNT_OF = lambda q: f"len(header) - len(replace(header, {q}, ''))"
_MARKS = ["','", "';'", "chr(9)", "'|'"]
P1_SQL = f"""WITH heads AS (SELECT source_csv, ltrim(rtrim(arg_min(raw_line, line_id), chr(13) || chr(10)), chr(65279)) AS header FROM annotation_lines WHERE source_row = 1 AND raw_line IS NOT NULL AND source_csv IS NOT NULL GROUP BY source_csv),
    laid AS (SELECT *, CASE greatest({', '.join(map(_COUNT_OF, _MARKS))}) {' '.join(f'WHEN {_COUNT_OF(q)} THEN {q}' for q in _MARKS)} END AS sep FROM heads),
    named AS (SELECT source_csv, sep, list_transform(string_split(header, sep), lambda c: lower(trim(trim(trim(c), '"')))) AS columns FROM laid),
    judged AS (SELECT line_id, CASE WHEN right(raw_line, 1) = chr(13) THEN left(raw_line, len(raw_line) - 1) ELSE raw_line END AS raw, sep, columns FROM annotation_lines l LEFT JOIN named USING (source_csv) WHERE source_row IS NULL OR source_row <> 1)
    SELECT line_id, 'no_header' AS reason FROM judged WHERE sep IS NULL UNION ALL """ + " UNION ALL ".join(map(_rejects_of, SEPARATORS))

SQL = {
    "p1_found": P1_SQL,
    "p5_found": """
        SELECT 'near' AS kind, a.object_id AS id_a, b.object_id AS id_b
        FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.object_id < b.object_id
        WHERE sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) <= 3.0
        UNION ALL
        SELECT 'inside', n.annotation_id, o.object_id
        FROM annotations n JOIN objects o ON n.scene_id = o.scene_id
        WHERE n.global_box_center_x BETWEEN o.min_x AND o.max_x AND n.global_box_center_y BETWEEN o.min_y AND o.max_y
          AND n.global_box_center_z BETWEEN o.min_z AND o.max_z""",
    "p5_near_distance": """
        SELECT a.scene_id, a.object_id AS id_a, b.object_id AS id_b,
               round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2), 6) AS distance_m
        FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.object_id < b.object_id
        WHERE sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) <= 3.0""",
}
