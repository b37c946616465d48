"""Dimension tables of fixed size: classes with code, role and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudmason.functions import vocabulary as V

CLASS_SCHEMA = "class_id int, semantic_label string, role string, structural boolean, can_support array<string>, can_rest_on array<string>, part_of array<string>"


def class_rules(spark: SparkSession) -> DataFrame:
    """The ten classes; always small enough to broadcast."""
    rows = [(i, c, V.ROLES[c], c in V.STRUCTURAL, V.CAN_SUPPORT[c], V.CAN_REST_ON[c], V.PART_OF.get(c, [])) for i, c in enumerate(V.CLASSES)]
    return spark.createDataFrame(rows, CLASS_SCHEMA)
