"""SQL for the llm queries that SQL can express on whole tables."""

_UNITS = """SELECT scene_id, row_idx, arg_min(coalesce(semantic_label, classification), point_id) AS code
            FROM points WHERE scene_id IS NOT NULL GROUP BY scene_id, row_idx"""

SQL = {
    "p3_found": f"""
        WITH units AS ({_UNITS}), n AS (SELECT scene_id, code, count(*) AS available FROM units GROUP BY scene_id, code)
        SELECT p.plan_id, p.class_id FROM sample_plan p LEFT JOIN n ON p.scene_id = n.scene_id AND p.class_id = n.code
        WHERE coalesce(n.available, 0) < greatest(p.target_pct * p.sample_size / 100.0, p.min_rows)""",
}
