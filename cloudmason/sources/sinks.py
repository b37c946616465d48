"""Reports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudmason.operators.grounding import reliability

# Fixed value: the columns of the CSV report, in order.
CSV_COLUMNS = ["question", "model", "chain_of_thought", "trace", "num_tool_calls", "tool_names", "tool_call_reasoning", "final_answer", "reference_answer", "grounding_issues", "reliability", "latency_s", "error"]


def trace(question: Column, calls: Column, answer: Column, error: Column) -> Column:
    """The numbered steps of a run as an array: the question, each call and its result, the answer; an error ends it."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    of_call = F.flatten(F.transform(calls, lambda c: F.array(F.concat(F.lit("Tool chiamato: "), c["name"], F.lit("("), F.coalesce(c["args"], F.lit("")), F.lit(")")), F.concat(F.lit("Risultato del tool: "), F.when(said(c["output"]), c["output"]).otherwise("(nessun output)")))))
    middle = F.when(F.size(calls) > 0, of_call).otherwise(F.array(F.lit("Nessun tool chiamato.")))
    last = F.array(F.concat(F.lit("Risposta finale: "), F.when(said(answer), answer).otherwise("(nessuna risposta)")))
    steps = F.when(said(error), F.array(F.concat(F.lit("Errore: "), error))).otherwise(F.concat(middle, last))
    steps = F.concat(F.array(F.concat(F.lit("Domanda: "), F.coalesce(question, F.lit("")))), steps)
    return F.transform(steps, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def report_rows(results: DataFrame) -> DataFrame:
    """results (question, model, chain_of_thought, tool_calls, final_answer, reference_answer, grounding_issues, latency_s,
    error) with lists as text. tool_calls: array of structs name, args, output, reasoning; grounding_issues: array of structs
    kind, detail. Nulls become empty texts or lists."""
    calls = F.coalesce("tool_calls", F.filter("tool_calls", lambda c: F.lit(False)), F.expr("array()").cast(results.schema["tool_calls"].dataType))
    d = results.withColumn("tool_calls", calls).withColumn("n_tool_calls", F.size("tool_calls")).withColumn("n_issues", F.greatest(F.size(F.coalesce("grounding_issues", F.array())), F.lit(0)))
    d = reliability(d)
    why = F.transform(F.filter("tool_calls", lambda c: F.coalesce(c["reasoning"], F.lit("")) != ""), lambda c: F.concat_ws(": ", c["name"], c["reasoning"]))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = d.withColumns({
        "trace": F.array_join(trace(F.col("question"), F.col("tool_calls"), F.col("final_answer"), F.col("error")), "\n"),
        "num_tool_calls": F.col("n_tool_calls"),
        "tool_names": F.array_join(F.transform("tool_calls", lambda c: F.coalesce(c["name"], F.lit(""))), ", "),
        "tool_call_reasoning": F.array_join(why, " | "),
        "grounding_issues": F.array_join(F.transform("grounding_issues", lambda g: F.concat_ws(": ", g["kind"], g["detail"])), " | "),
        "latency_s": F.format_string("%.3f", F.coalesce(F.col("latency_s").cast("double"), F.lit(0.0))),
    })
    return d.select(*(F.col(c) if c in ("num_tool_calls", "latency_s") else text(c) for c in CSV_COLUMNS))


def write_csv_report(results: DataFrame, path: str) -> None:
    report_rows(results).write.mode("overwrite").option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def write_json_report(results: DataFrame, path: str) -> None:
    """One JSON object a line, nested lists kept."""
    results.write.mode("overwrite").json(path)


def write_run_report(report: DataFrame, path: str) -> None:
    """The one row of a run: counts and parameters."""
    report.coalesce(1).write.mode("overwrite").json(path)
