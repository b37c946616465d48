"""All queries outside the llm subpackage, by name, and their SQL."""

from __future__ import annotations

from cloudmason.plans import core_problems, ontology_queries, scene_queries, text_queries

MODULES = [core_problems, scene_queries, ontology_queries, text_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
