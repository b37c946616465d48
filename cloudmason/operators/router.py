"""Questions to data operators: the first handler whose conditions hold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudmason.functions import text as X

#: (handler, conditions) in the order in which they are tried. A condition is an intent or one of: "label" (a class is
#: named), "two_labels" (named twice, be it the same class), "one_label" (named exactly once), "pair" (two different
#: classes), "not_wall" (a class other than wall), "object" and "two_objects" (object names), "prompt_N" as an exact
#: evaluation question ("=prompt_N"). A leading "!" negates; "a|b" holds if one of them does; "default" is the class that
#: the conversation is about, if there is one.
HANDLERS: list[tuple[str, list[str]]] = [
    ("area_and_volume", ["area", "volume"]),
    ("area", ["area"]),
    ("coordinates", ["coordinates", "object|label|scene_words"]),
    ("dominant_element", ["dominant"]),
    ("material_inventory", ["!label", "!object", "attribute|material_names"]),
    ("annotated_description", ["label|object", "description|material_names"]),
    ("opening_in_wall", ["opening_in_wall", "not_wall"]),
    ("part_of_classes", ["two_labels", "part_of"]),
    ("load_bearing", ["load_bearing"]),
    ("class_role", ["label", "role|scope_correction"]),
    ("class_role", ["default", "scope_correction"]),
    ("class_role", ["default", "role_follow_up", "!whole_scene", "role"]),
    ("objects_of_class", ["object_list", "!relationships", "!coordinates", "label"]),
    ("class_pair_relations", ["relation_words", "pair"]),
    ("class_relations", ["relation_words", "label|class_words"]),
    ("inconsistencies", ["inconsistencies"]),
    ("layer_l2_is_no_graph", ["l2_as_graph"]),
    ("layer_l3_is_no_part_of", ["l3_as_part_of"]),
    ("layer_l1_is_not_structural", ["l1_as_structural"]),
    ("relationship_list", ["relationships", "relationship_list"]),
    ("relationship_summary", ["relationships"]),
    ("above_below", ["above_below"]),
    ("scene_brief", ["scene_brief"]),
    *((f"prompt_{n}", [f"=prompt_{n}"]) for n in range(1, 21)),
    ("prompt_2", ["dominant"]),
    *((f"prompt_{n}", [f"prompt_{n}"]) for n in (*range(4, 18), 20)),
    ("count_of_class", ["count", "label"]),
    ("present_classes", ["present_classes"]),
    ("class_count", ["class_count"]),
    ("support_between", ["support", "two_labels"]),
    ("open_support", ["support", "one_label"]),
    ("requested_facts", ["inventory|area|top_object|volume|box|cloud"]),
    ("distance", ["distance", "two_objects|two_labels"]),
    ("nearest_objects", ["distance", "object", "nearest"]),
    ("material_inventory", ["material"]),
]


def _holds(condition: str, folded: Column, classes: Column, names: Column, default: Column) -> Column:
    if "|" in condition:
        found = F.lit(False)
        for c in condition.split("|"):
            found |= _holds(c, folded, classes, names, default)
        return found
    if condition[0] == "!":
        return ~_holds(condition[1:], folded, classes, names, default)
    if condition.startswith("=prompt_"):
        return folded == X.fold(F.lit(X.PROMPTS[int(condition.removeprefix("=prompt_")) - 1]))
    special = {
        "label": F.size(classes) >= 1,
        "two_labels": F.size(classes) >= 2,
        "one_label": F.size(classes) == 1,
        "pair": F.size(F.array_distinct(classes)) >= 2,
        "not_wall": F.exists(classes, lambda c: c != "wall"),
        "object": F.size(names) >= 1,
        "two_objects": F.size(names) >= 2,
        "default": default.isNotNull(),
    }
    return special[condition] if condition in special else X.intent(folded, condition)


def route(questions: DataFrame, column: str, default_label: str | None = None) -> DataFrame:
    """questions with handler, classes and objects (named in the question, in order), language and passive (of support
    questions); unanswered where no handler fits. A null question is unanswered.

    default_label: the class the conversation is about; without it, follow-up questions need a class of their own."""
    d = questions.withColumn("folded_", F.coalesce(X.fold(F.col(column)), F.lit("")))
    d = d.withColumn("classes", F.coalesce(X.question_classes(F.col(column)), F.array().cast("array<string>"))).withColumn("objects", F.coalesce(X.object_names(F.col(column)), F.array().cast("array<string>")))
    handler = F.lit("unanswered")
    for name, conditions in reversed(HANDLERS):
        found = F.lit(True)
        for c in conditions:
            found &= _holds(c, F.col("folded_"), F.col("classes"), F.col("objects"), F.lit(default_label).cast("string"))
        handler = F.when(found, name).otherwise(handler)
    if default_label is not None:
        d = d.withColumn("classes", F.when(F.size("classes") == 0, F.array(F.lit(default_label))).otherwise(F.col("classes")))
    return d.withColumn("handler", handler).withColumn("language", X.response_language(F.col("folded_"))).withColumn("passive", X.intent(F.col("folded_"), "passive_support")).drop("folded_")


def parts(questions: DataFrame, column: str) -> DataFrame:
    """questions with part (from 0) and text: one row per question of an input; an input of one question stays whole."""
    several = X.split_questions(F.col(column))
    whole = F.when(F.size(several) <= 1, F.array(F.col(column))).otherwise(several)
    return questions.select("*", F.posexplode(whole).alias("part", "text"))
