"""Checks of written answers against the scene, and the figures of a run of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudmason.functions import text as X
from cloudmason.functions import vocabulary as V

ABSENT = "\\b(?:" + "|".join(V.ABSENCE_MARKERS) + ")|\\bno\\b"


def absent_classes(objects: DataFrame) -> DataFrame:
    """scene_id, semantic_label of the classes a scene has no object of."""
    all_classes = F.explode(F.array(*map(F.lit, V.CLASSES))).alias("semantic_label")
    return objects.select("scene_id").distinct().select("scene_id", all_classes).join(objects.select("scene_id", "semantic_label").distinct(), ["scene_id", "semantic_label"], "left_anti")


def absent_claimed(answers: DataFrame, objects: DataFrame) -> DataFrame:
    """answer_id, semantic_label: an absent class named in a sentence that has no word of absence."""
    said = answers.select("answer_id", "scene_id", F.explode(X.split_sentences(F.col("answer"))).alias("s")).withColumn("s", X.fold(F.col("s"))).filter(~F.col("s").rlike(f"(?U){ABSENT}"))
    named = said.select("answer_id", "scene_id", "s", F.explode(F.array(*map(F.lit, V.CLASSES))).alias("semantic_label"))
    hit = F.lit(False)
    for c in V.CLASSES:
        hit |= (F.col("semantic_label") == c) & X.has_word(F.col("s"), c)
    return named.filter(hit).select("answer_id", "scene_id", "semantic_label").distinct().join(absent_classes(objects), ["scene_id", "semantic_label"], "left_semi").select("answer_id", "semantic_label")


def invalid_relations(answers: DataFrame) -> DataFrame:
    text = X.fold(F.col("answer"))
    words = F.array_compact(F.array(*(F.when(X.has_word(text, w), w) for w in V.INVALID_RELATIONS)))
    return answers.select("answer_id", F.explode(words).alias("relation_type"))


def unknown_objects(answers: DataFrame, objects: DataFrame) -> DataFrame:
    """answer_id, obj_name: object ids of known classes that the scene does not have."""
    named = answers.select("answer_id", "scene_id", F.explode(X.object_names(F.col("answer"))).alias("obj_name"))
    return named.join(objects.select("scene_id", "obj_name"), ["scene_id", "obj_name"], "left_anti").select("answer_id", "obj_name")


def count_checks(answers: DataFrame, objects: DataFrame) -> DataFrame:
    """answer_id, kind, stated, expected where the first number of an answer contradicts the count that its question asks for."""
    q = X.fold(F.col("question"))
    d = answers.select("answer_id", "scene_id", X.first_integer(F.col("answer")).alias("stated"), X.intent(q, "class_count").alias("classes"), X.intent(q, "count").alias("counts"), X.first_mentioned(q).alias("label"), X.has_any(q, V.OBJECT_WORDS).alias("things")).filter(F.col("stated").isNotNull())
    totals = objects.groupBy("scene_id").agg(F.count("*").alias("n_objects"), F.count_distinct("semantic_label").alias("n_classes"))
    per = objects.groupBy("scene_id", F.col("semantic_label").alias("label")).agg(F.count("*").alias("n_label"))
    d = d.join(totals, "scene_id", "left").join(per, ["scene_id", "label"], "left").fillna(0, ["n_objects", "n_classes", "n_label"])
    kinds = [
        (F.col("classes"), "class_count_mismatch", F.col("n_classes")),
        (F.col("counts") & F.col("label").isNotNull(), "object_count_mismatch", F.col("n_label")),
        (F.col("counts") & F.col("label").isNull() & F.col("things"), "object_total_count_mismatch", F.col("n_objects")),
    ]
    made = F.array_compact(F.array(*(F.when(asked & (F.col("stated") != n), F.struct(F.lit(kind).alias("kind"), n.alias("expected"))) for asked, kind, n in kinds)))
    return d.select("answer_id", "stated", F.explode(made).alias("m")).select("answer_id", "m.kind", "stated", "m.expected")


def all_issues(answers: DataFrame, objects: DataFrame) -> DataFrame:
    """answer_id, kind, detail of every check."""
    a = absent_claimed(answers, objects).select("answer_id", F.lit("absent_class_claimed_present").alias("kind"), F.col("semantic_label").alias("detail"))
    b = invalid_relations(answers).select("answer_id", F.lit("invalid_relation_type").alias("kind"), F.col("relation_type").alias("detail"))
    c = unknown_objects(answers, objects).select("answer_id", F.lit("unknown_object_name").alias("kind"), F.col("obj_name").alias("detail"))
    e = count_checks(answers, objects).select("answer_id", "kind", F.concat_ws(" / ", F.col("stated").cast("string"), F.col("expected").cast("string")).alias("detail"))
    return a.unionByName(b).unionByName(c).unionByName(e)


def reliability(results: DataFrame) -> DataFrame:
    """results with reliability: error, unanswered, ungrounded, unverified_no_tool or grounded, the first that applies.

    results: error, final_answer, n_issues, n_tool_calls; nulls count as none."""
    verdict = F.when(F.coalesce(F.col("error"), F.lit("")) != "", "error").when(F.coalesce(F.col("final_answer"), F.lit("")) == "", "unanswered").when(F.coalesce(F.col("n_issues"), F.lit(0)) > 0, "ungrounded").when(F.coalesce(F.col("n_tool_calls"), F.lit(0)) == 0, "unverified_no_tool").otherwise("grounded")
    return results.withColumn("reliability", verdict)


def summary(results: DataFrame) -> DataFrame:
    """One row: totals, errors, questions without tool, mean latency and calls, grounded rate."""
    d = reliability(results)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    errors, grounded = n(F.col("reliability") == "error"), n(F.col("reliability") == "grounded")
    return d.agg(F.count("*").alias("total"), errors.alias("errors"), n(F.coalesce("n_tool_calls", F.lit(0)) == 0).alias("zero_tool"), F.avg("latency_s").alias("avg_latency_s"), F.avg("n_tool_calls").alias("avg_tool_calls"), F.when(F.count("*") > errors, grounded / (F.count("*") - errors)).alias("grounded_rate"))


def step_trace(results: DataFrame) -> DataFrame:
    """One row per tool call of each question: question_id, step, name, args, output. tool_calls: array of structs."""
    return results.select("question_id", F.posexplode("tool_calls").alias("step", "call")).select("question_id", (F.col("step") + 1).alias("step"), "call.name", "call.args", "call.output")


def calls_with_outputs(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    return calls.join(outputs, ["question_id", "call_id"], "left")
