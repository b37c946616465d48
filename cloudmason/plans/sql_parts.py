"""Shared pieces of SQL, written independently of the Spark expressions they check."""

from __future__ import annotations

from cloudmason.functions import vocabulary as V


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def case(column: str, table: dict[str, str], default: str) -> str:
    """CASE over a word table, words of one group together."""
    groups: dict[str, list[str]] = {}
    for k, v in table.items():
        groups.setdefault(v, []).append(k)
    return "CASE " + " ".join(f"WHEN {column} IN ({quoted(ks)}) THEN '{v}'" for v, ks in groups.items()) + f" ELSE {default} END"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def fold(c: str) -> str:
    return f"strip_accents(lower({strip(c)}))"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


ROLE = case("semantic_label", V.ROLES, "'unknown'")
L2_LABEL = "nullif(" + case(fold("semantic_label"), V.LABEL_WORDS, fold("semantic_label")) + ", '')"

AREA = "greatest(max_x - min_x, 0.0) * greatest(max_y - min_y, 0.0)"
VOLUME = "(max_x - min_x) * (max_y - min_y) * (max_z - min_z)"


def _gap(x: str) -> str:
    return f"greatest(b.min_{x} - a.max_{x}, a.min_{x} - b.max_{x}, 0.0)"


def _shared(x: str) -> str:
    return f"greatest(0.0, least(a.max_{x}, b.max_{x}) - greatest(a.min_{x}, b.min_{x}))"


def area_of(p: str) -> str:
    return f"greatest({p}.max_x - {p}.min_x, 0.0) * greatest({p}.max_y - {p}.min_y, 0.0)"


GAP = f"sqrt({_gap('x')} * {_gap('x')} + {_gap('y')} * {_gap('y')} + {_gap('z')} * {_gap('z')})"
DIST = "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + (a.cz - b.cz) * (a.cz - b.cz))"
RATIO = f"CASE WHEN least({area_of('a')}, {area_of('b')}) > 0 THEN {_shared('x')} * {_shared('y')} / least({area_of('a')}, {area_of('b')}) ELSE 0.0 END"
GAP_X, GAP_Y, GAP_Z = _gap("x"), _gap("y"), _gap("z")

PAIRS = f"""pairs AS (
    SELECT a.scene_id, a.obj_ord AS oa, b.obj_ord AS ob, a.obj_name AS na, b.obj_name AS nb, a.semantic_label AS la, b.semantic_label AS lb,
           {DIST} AS dist, {GAP} AS gap, {RATIO} AS ratio,
           a.cz AS za, b.cz AS zb, a.min_z - b.max_z AS a_over_b, b.min_z - a.max_z AS b_over_a
    FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.obj_ord < b.obj_ord),
flagged AS (
    SELECT *, za > zb AND a_over_b BETWEEN -0.15 AND 0.75 AND ratio >= 0.05 AND NOT (la = 'column' AND lb = 'arch') AS a_up,
           zb > za AND b_over_a BETWEEN -0.15 AND 0.75 AND ratio >= 0.05 AND NOT (lb = 'column' AND la = 'arch') AS b_up
    FROM pairs)"""

L1 = (
    PAIRS
    + """,
l1 AS (
    SELECT scene_id, na AS source, nb AS target, 'near' AS rel_type, 'geometric' AS rel_level, la AS source_label, lb AS target_label, oa AS ord_a, ob AS ord_b, 0 AS k FROM flagged WHERE dist <= 3.0
    UNION ALL SELECT scene_id, nb, na, 'near', 'geometric', lb, la, oa, ob, 1 FROM flagged WHERE dist <= 3.0
    UNION ALL SELECT scene_id, na, nb, 'above', 'geometric', la, lb, oa, ob, 2 FROM flagged WHERE a_up
    UNION ALL SELECT scene_id, nb, na, 'below', 'geometric', lb, la, oa, ob, 3 FROM flagged WHERE a_up
    UNION ALL SELECT scene_id, nb, na, 'above', 'geometric', lb, la, oa, ob, 2 FROM flagged WHERE b_up AND NOT a_up
    UNION ALL SELECT scene_id, na, nb, 'below', 'geometric', la, lb, oa, ob, 3 FROM flagged WHERE b_up AND NOT a_up
    UNION ALL SELECT scene_id, na, nb, 'adjacent_to', 'geometric', la, lb, oa, ob, 4 FROM flagged WHERE gap <= 0.75
    UNION ALL SELECT scene_id, nb, na, 'adjacent_to', 'geometric', lb, la, oa, ob, 5 FROM flagged WHERE gap <= 0.75)"""
)

EDGES = L1 + """,
edge_items AS (SELECT scene_id, source, target, rel_type, min((ord_a, ord_b, k)) AS o FROM l1 GROUP BY ALL),
edges AS (SELECT scene_id, source, target, string_agg(rel_type, ', ' ORDER BY o) AS relationship, count(*) AS n_types FROM edge_items GROUP BY scene_id, source, target)"""

COUNTS = "counts AS (SELECT scene_id, count(*) AS n_objects, " + ", ".join(f"count(*) FILTER (semantic_label = '{c}') AS n_{c}" for c in V.CLASSES) + " FROM objects GROUP BY scene_id)"

MATCH = f"""ann AS (
    SELECT annotation_id, scene_id, {L2_LABEL} AS label, global_box_center_x AS x, global_box_center_y AS y, global_box_center_z AS z,
           nullif({strip('description')}, '') AS description, nullif({strip('historical_description')}, '') AS historical_description,
           nullif({strip('material_description')}, '') AS material_description, nullif({strip('typology')}, '') AS typology,
           nullif({strip('function')}, '') AS function, nullif({strip('notes')}, '') AS notes
    FROM annotations),
centred AS (SELECT scene_id, obj_ord, obj_name, semantic_label, (min_x + max_x) / 2 AS bx, (min_y + max_y) / 2 AS by_, (min_z + max_z) / 2 AS bz FROM objects),
cand AS (
    SELECT n.annotation_id, o.obj_ord, o.obj_name, o.semantic_label AS obj_label,
           sqrt((n.x - o.bx) * (n.x - o.bx) + (n.y - o.by_) * (n.y - o.by_) + coalesce((n.z - o.bz) * (n.z - o.bz), 0.0)) AS d
    FROM ann n JOIN centred o ON n.scene_id = o.scene_id AND (n.label IS NULL OR n.label = o.semantic_label)),
nearest AS (
    SELECT annotation_id, count(*) AS n_cand, arg_min(obj_name, (d, obj_ord)) FILTER (d IS NOT NULL) AS nearest_object,
           arg_min(obj_label, (d, obj_ord)) FILTER (d IS NOT NULL) AS nearest_label, min(d) AS distance_m
    FROM cand GROUP BY annotation_id),
matched AS (
    SELECT n.*, c.nearest_object, c.distance_m, CASE WHEN c.n_cand IS NULL THEN 'none' ELSE 'global_box_center' END AS method,
           CASE WHEN c.n_cand IS NULL THEN 'no candidates for semantic label' WHEN c.distance_m IS NULL THEN 'missing global_box_center_x/y/z'
                WHEN c.distance_m > 2.0 THEN 'nearest object box_center is beyond max_distance' END AS reason,
           CASE WHEN c.distance_m <= 2.0 THEN c.nearest_object END AS obj_name, CASE WHEN c.distance_m <= 2.0 THEN c.nearest_label END AS obj_label
    FROM ann n LEFT JOIN nearest c USING (annotation_id))"""

# The adapter of the test tables: bearing elements carry vaults and roofs, bracing ones rest on walls.
EVIDENCE = MATCH + """,
low_up AS (
    SELECT DISTINCT m.scene_id, m.obj_name AS lower_, o.obj_name AS upper_, m.obj_label AS lower_label, o.semantic_label AS upper_label
    FROM matched m JOIN objects o ON m.scene_id = o.scene_id AND o.semantic_label IN ('vault', 'roof') AND o.semantic_label <> m.obj_label
    WHERE m.obj_name IS NOT NULL AND m.function = 'bearing'
    UNION
    SELECT DISTINCT m.scene_id, o.obj_name, m.obj_name, o.semantic_label, m.obj_label
    FROM matched m JOIN objects o ON m.scene_id = o.scene_id AND o.semantic_label = 'wall' AND o.semantic_label <> m.obj_label
    WHERE m.obj_name IS NOT NULL AND m.function = 'bracing'),
evidence AS (
    SELECT scene_id, lower_ AS source, upper_ AS target, 'supports' AS rel_type, 'csv_structural_evidence' AS rel_level, lower_label AS source_label, upper_label AS target_label FROM low_up
    UNION ALL SELECT scene_id, upper_, lower_, 'rests_on', 'csv_structural_evidence', upper_label, lower_label FROM low_up)"""

ORDER_HASH = "((row_idx % 1000000000) * 2654435761 + 40503) % 4294967296"
POINTS = "pts AS (SELECT point_id, scene_id, row_idx, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, coalesce(semantic_label, classification) AS code FROM points)"
NAMED = POINTS + ", named AS (SELECT pts.*, c.semantic_label AS label FROM pts JOIN class_list c ON pts.code = c.class_id)"


def mentioned(c: str) -> str:
    """List of the classes named in a folded text, in the order of the word list."""
    import re

    parts = [f"CASE WHEN regexp_matches({c}, '\\b(?:{'|'.join(map(re.escape, words))})\\b') THEN '{label}' END" for label, words in V.TEXT_WORDS]
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
