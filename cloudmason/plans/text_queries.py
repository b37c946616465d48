"""Queries of text functions, grounding checks, question routing and run figures, with SQL for the same results.

Answers are the documents of the source agent_answer that name a scene: the part up to the first question mark is the
question, the whole text the answer. Run results come from the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmason.functions import text as X
from cloudmason.functions import vocabulary as V
from cloudmason.operators import grounding as K
from cloudmason.operators import router
from cloudmason.plans import sql_parts as Q
from cloudmason.plans.scene_queries import objects, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "source", "scene_id")


def answers(s: SparkSession, d: str) -> DataFrame:
    a = documents(s, d).filter((F.col("source") == "agent_answer") & F.col("scene_id").isNotNull() & F.col("text").isNotNull())
    return a.select(F.col("doc_id").alias("answer_id"), "scene_id", F.regexp_extract("text", "(?s)^([^?]*\\?)", 1).alias("question"), F.regexp_replace("text", "(?s)^[^?]*\\?", "").alias("answer"))


ANSWERS = """ans AS (SELECT doc_id AS answer_id, scene_id, regexp_extract(text, '^([^?]*\\?)', 1, 's') AS question, regexp_replace(text, '^[^?]*\\?', '', 's') AS answer
    FROM documents WHERE source = 'agent_answer' AND scene_id IS NOT NULL AND text IS NOT NULL)"""
SAID = ANSWERS + f", said AS (SELECT answer_id, scene_id, {Q.fold('s')} AS s FROM (SELECT answer_id, scene_id, unnest(regexp_split_to_array(answer, '[.\\n;]')) AS s FROM ans))"


@query(f"SELECT annotation_id, {Q.fold('semantic_label')} AS folded FROM annotations WHERE semantic_label IS NOT NULL")
def f1_fold(s, d):
    return table(s, d, "annotations").filter(F.col("semantic_label").isNotNull()).select("annotation_id", X.fold(F.col("semantic_label")).alias("folded"))


_ASCII = "translate({0}, 'àèéìòùÀÈÉÌÒÙ''’', 'aeeiouAEEIOU')"


@query(f"SELECT record_id, {_ASCII.format('description')} AS plain FROM catalogue WHERE description IS NOT NULL")
def f2_ascii_fold(s, d):
    return table(s, d, "catalogue").filter(F.col("description").isNotNull()).select("record_id", X.ascii_fold(F.col("description")).alias("plain"))


_CAP = "array_to_string(list_transform({0}, lambda w: upper(w[1]) || lower(w[2:])), '')"


@query(f"SELECT annotation_id, coalesce(nullif({_CAP.format('regexp_extract_all(' + _ASCII.format('material_description') + ', ' + chr(39) + '[A-Za-z0-9]+' + chr(39) + ')')}, ''), 'Unspecified') AS slug FROM annotations WHERE material_description IS NOT NULL")
def f3_slug(s, d):
    return table(s, d, "annotations").filter(F.col("material_description").isNotNull()).select("annotation_id", X.slug(F.col("material_description")).alias("slug"))


@query(f"SELECT object_id, {_CAP.format('list_filter(string_split_regex(obj_name, ' + chr(39) + '[_\\W]+' + chr(39) + '), lambda w: w <> ' + chr(39) * 2 + ')')} AS pascal FROM objects")
def f4_pascal(s, d):
    return objects(s, d).select("object_id", X.pascal(F.col("obj_name")).alias("pascal"))


_HEADER_SEP = "CASE greatest(" + ", ".join(f"len(raw_line) - len(replace(raw_line, {q}, ''))" for q in ("','", "';'", "chr(9)", "'|'")) + ") " + " ".join(f"WHEN len(raw_line) - len(replace(raw_line, {q}, '')) THEN {q}" for q in ("','", "';'", "chr(9)", "'|'")) + " END"


@query(f"SELECT line_id, column_no, regexp_replace(regexp_replace({Q.fold('name')}, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM (SELECT line_id, unnest(string_split(raw_line, {_HEADER_SEP})) AS name, generate_subscripts(string_split(raw_line, {_HEADER_SEP}), 1) AS column_no FROM annotation_lines WHERE source_row = 1)")
def f5_a10_header_slug(s, d):
    """The column names of every header row."""
    h = table(s, d, "annotation_lines").filter(F.col("source_row") == 1)
    sep, most = F.lit(","), F.size(F.split("raw_line", ","))
    for mark in (";", "\t", "|"):
        n = F.size(F.split("raw_line", "\\" + mark if mark == "|" else mark))
        sep, most = F.when(n > most, F.lit("\\|" if mark == "|" else mark)).otherwise(sep), F.greatest(n, most)
    return h.select("line_id", F.posexplode(F.split("raw_line", sep)).alias("at", "name")).select("line_id", (F.col("at") + 1).alias("column_no"), X.header_slug(F.col("name")).alias("slug"))


@query("SELECT record_id, trim(unnest(string_split_regex(function, '[;|]'))) AS function FROM catalogue WHERE function IS NOT NULL")
def f6_split_values(s, d):
    return table(s, d, "catalogue").filter(F.col("function").isNotNull()).select("record_id", F.explode(X.split_values(F.col("function"))).alias("function"))


@query("SELECT line_id, regexp_replace(regexp_replace(coalesce(raw_line, ''), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'), '^\"+|\"+$', '', 'g') AS cell FROM annotation_lines")
def f7_row_text(s, d):
    return table(s, d, "annotation_lines").select("line_id", X.row_text(F.col("raw_line")).alias("cell"))


_L3 = f"replace(replace(lower({Q.strip('coalesce(class_semantic_label, semantic_label)')}), '/', '_'), ' ', '_')"


@query(f"SELECT record_id, {Q.case(_L3, V.ONTOLOGY_WORDS, _L3)} AS class_word FROM catalogue")
def f8_ontology_class(s, d):
    return table(s, d, "catalogue").select("record_id", X.l3_class(F.coalesce("class_semantic_label", "semantic_label")).alias("class_word"))


@query(f"SELECT annotation_id, {Q.L2_LABEL} AS label FROM annotations")
def f9_label_alias(s, d):
    return table(s, d, "annotations").select("annotation_id", X.l2_label(F.col("semantic_label")).alias("label"))


# Spellings met in turn by the rows of a table, with blanks around every third.
WRITTEN = [*V.PREDICATES, "P999", "crm:P46", "near"]
TRUTHS = ["yes", "No", "SI", "0", "1", "true", "FALSE", "y", "s", "", "perhaps"]
LEVELS = ["geometric", "csv_structural_evidence", "L3", "l1", "KG", "L2", "all", "structural", "zzz"]


def _in_turn(s, d, words: list[str], name: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, words)), (F.col("record_id") % len(words) + 1).cast("int"))
    return table(s, d, "catalogue").select("record_id", F.when(F.col("record_id") % 3 == 0, F.concat(F.lit(" "), word, F.lit(" "))).otherwise(word).alias(name))


def _turned(words: list[str], name: str) -> str:
    word = f"[{Q.quoted(words)}][record_id % {len(words)} + 1]"
    return f"(SELECT record_id, CASE WHEN record_id % 3 = 0 THEN ' ' || {word} || ' ' ELSE {word} END AS {name} FROM catalogue)"


@query(f"SELECT record_id, {Q.case('trim(written)', V.PREDICATES, 'trim(written)')} AS predicate FROM {_turned(WRITTEN, 'written')}")
def f10_predicate_alias(s, d):
    return _in_turn(s, d, WRITTEN, "written").select("record_id", X.predicate(F.col("written")).alias("predicate"))


_TOKENS = "(SELECT line_id, unnest(string_split_regex(raw_line, '[;|\\t\"]')) AS cell FROM annotation_lines WHERE raw_line IS NOT NULL)"


@query(f"SELECT line_id, cell, try_cast(replace(regexp_replace(cell, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'), ',', '.') AS DOUBLE) AS number FROM {_TOKENS} WHERE regexp_matches(cell, '[0-9]') AND NOT regexp_matches(cell, '[A-Za-z]')")
def f11_decimal(s, d):
    """Every cell of every line that holds a digit and no letter."""
    cells = table(s, d, "annotation_lines").filter(F.col("raw_line").isNotNull()).select("line_id", F.explode(F.split("raw_line", '[;|\t"]')).alias("cell"))
    return cells.filter(F.col("cell").rlike("[0-9]") & ~F.col("cell").rlike("[A-Za-z]")).select("line_id", "cell", X.decimal(F.col("cell")).alias("number"))


@query(f"SELECT annotation_id, coalesce(nullif({Q.strip('notes')}, ''), nullif({Q.strip('typology')}, ''), nullif({Q.strip('function')}, '')) AS value FROM annotations")
def f12_f13_first_value(s, d):
    return table(s, d, "annotations").select("annotation_id", X.first_value(F.col("notes"), F.col("typology"), F.col("function")).alias("value"))


@query(f"SELECT record_id, lower(trim(word)) IN ('1', 'true', 'yes', 'y', 'si', 's') AS truthy FROM {_turned(TRUTHS, 'word')}")
def f14_truthy(s, d):
    return _in_turn(s, d, TRUTHS, "word").select("record_id", X.truthy(F.col("word")).alias("truthy"))


@query(f"SELECT doc_id, array_to_string({Q.mentioned(Q.fold('text'))}, ',') AS classes FROM documents WHERE text IS NOT NULL")
def f22_mentioned_classes(s, d):
    return documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.array_join(X.mentioned_classes(F.col("text")), ",").alias("classes"))


_WORDS = sorted((w for _, ws in V.TEXT_WORDS for w in ws), key=lambda w: -len(w))
_CLASSES = "regexp_extract_all(t, '\\b(" + "|".join(_WORDS) + ")\\b', 1)"
_NAMED = "list_transform(cs, lambda w: " + Q.case("w", {w: label for label, ws in V.TEXT_WORDS for w in ws}, "NULL") + ")"


@query(f"SELECT doc_id, array_to_string({{named}}, ',') AS classes FROM (SELECT doc_id, {{found}} AS cs FROM (SELECT doc_id, {Q.fold('text')} AS t FROM documents WHERE text IS NOT NULL))".replace("{named}", _NAMED).replace("{found}", _CLASSES))
def f23_question_classes(s, d):
    return documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.array_join(X.question_classes(F.col("text")), ",").alias("classes"))


@query(f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\b((?:{'|'.join(V.CLASSES)})_[0-9]+)\\b', 1)) AS obj_name FROM documents WHERE text IS NOT NULL")
def f24_object_names(s, d):
    return documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.explode(X.object_names(F.col("text"))).alias("obj_name"))


def _score(words: list[str]) -> str:
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


@query(f"SELECT doc_id, CASE WHEN {_score(V.ENGLISH_MARKERS)} > {_score(V.ITALIAN_MARKERS)} THEN 'en' ELSE 'it' END AS language FROM (SELECT doc_id, {Q.fold('text')} AS t FROM documents WHERE text IS NOT NULL)")
def f25_response_language(s, d):
    return documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", X.response_language(F.col("text")).alias("language"))


@query(f"WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^?]*\\?|[^?]+$')) AS q FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n_questions FROM q WHERE {Q.strip('q')} <> '' GROUP BY doc_id")
def f26_question_split(s, d):
    q = documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.explode(X.split_questions(F.col("text"))).alias("q"))
    return q.groupBy("doc_id").agg(F.count("*").alias("n_questions"))


def _first(c: str, table_: list[tuple[str, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {Q.any_of(c, w)} THEN '{n}'" for n, w in table_) + f" ELSE {default} END"


@query(f"SELECT doc_id, {_first('t', V.LEVEL_TEXT, chr(39) + 'all' + chr(39))} AS level, {_first('t', V.RELATION_WORDS, 'NULL')} AS rel_type, CASE WHEN {Q.any_of('t', V.BOX_CENTRE_WORDS)} THEN 'box_center' WHEN {Q.any_of('t', ['centroide', 'centroid'])} THEN 'centroid' ELSE 'coordinates' END AS mode, {_first('t', V.POSITION_WORDS, 'NULL')} AS position FROM (SELECT doc_id, {Q.fold('text')} AS t FROM documents WHERE text IS NOT NULL)")
def f27_f28_text_modes(s, d):
    t = documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", X.fold(F.col("text")).alias("t"))
    return t.select("doc_id", X.relation_level(F.col("t")).alias("level"), X.relation_type(F.col("t")).alias("rel_type"), X.coordinate_mode(F.col("t")).alias("mode"), X.position(F.col("t")).alias("position"))


@query("SELECT object_id, printf('%.3f', cx) AS cx_text, printf('%.2f', cz) AS cz_text FROM objects")
def f29_number_formats(s, d):
    return objects(s, d).select("object_id", X.fixed(F.col("cx"), 3).alias("cx_text"), X.fixed(F.col("cz"), 2).alias("cz_text"))


@query("SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT) AS first_number FROM documents WHERE text IS NOT NULL")
def f30_first_integer(s, d):
    return documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", X.first_integer(F.col("text")).alias("first_number"))


@query("SELECT doc_id, len(regexp_split_to_array(text, '[.\\n;]')) AS n_sentences FROM documents WHERE text IS NOT NULL")
def f31_sentence_split(s, d):
    return documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.size(X.split_sentences(F.col("text"))).alias("n_sentences"))


_LAYER = {"geometric": "L1", "l1": "L1", "csv_structural_evidence": "structural_evidence", "structural": "structural_evidence", "l2": "L2_DETAIL", "l3": "L3_KG_DETAIL", "kg": "L3_KG_DETAIL", "all": "all"}


@query(f"SELECT record_id, {Q.case('lower(trim(level))', _LAYER, 'NULL')} AS layer FROM {_turned(LEVELS, 'level')}")
def f32_b7_layer_of_level(s, d):
    rows = _in_turn(s, d, LEVELS, "level")
    return rows.select("record_id", X.layer_key(F.regexp_replace("level", "csv_", "")).alias("layer"))


@query("SELECT scene_id, regexp_replace(scene_name, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM scenes")
def f33_path_safe(s, d):
    return table(s, d, "scenes").select("scene_id", X.path_safe(F.col("scene_name")).alias("safe"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN regexp_matches(line, '^\\s*[0-9]+\\s*\\.\\s*\\S') THEN regexp_replace(line, '^\\s*[0-9]+\\s*\\.\\s*', '') ELSE line END AS line FROM l WHERE regexp_matches(line, '^\\s*[0-9]')")
def f34_strip_ordinal(s, d):
    lines = documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.col("line").rlike("^\\s*[0-9]")).select("doc_id", X.strip_ordinal(F.col("line")).alias("line"))


_REPLACED = "text"
for _old, _new in X.PHRASES:
    _REPLACED = f"replace({_REPLACED}, '{_old}', '{_new}')"


@query(f"SELECT doc_id, md5({_REPLACED}) AS digest FROM documents WHERE text IS NOT NULL")
def f35_phrases(s, d):
    return documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.md5(X.to_english(F.col("text"))).alias("digest"))


def _intent(name: str) -> str:
    return " AND ".join(Q.any_of("t", w) for w in X.INTENTS[name])


@query("SELECT doc_id, " + ", ".join(f"({_intent(n)}) AS {n}" for n in X.INTENTS) + f" FROM (SELECT doc_id, {Q.fold('text')} AS t FROM documents WHERE text IS NOT NULL)")
def i1_i24_intents(s, d):
    t = documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", X.fold(F.col("text")).alias("t"))
    return t.select("doc_id", *(X.intent(F.col("t"), n).alias(n) for n in X.INTENTS))


# ---- K: groundedness

_FIRST_NAMED = f"({_NAMED})[1]"


@query(f"""WITH {SAID}, absent AS (SELECT s.scene_id, c.semantic_label FROM (SELECT DISTINCT scene_id FROM objects) s, class_list c WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.scene_id = s.scene_id AND o.semantic_label = c.semantic_label))
    SELECT DISTINCT answer_id, a.semantic_label FROM said JOIN absent a USING (scene_id) WHERE regexp_matches(s, '\\b' || a.semantic_label || '\\b') AND NOT regexp_matches(s, '\\b(?:{'|'.join(V.ABSENCE_MARKERS)})|\\bno\\b')""")
def k1_absent_class_claimed(s, d):
    return K.absent_claimed(answers(s, d), objects(s, d))


_CLAIMS = "claims AS (SELECT scene_id || ' ' || class_id AS answer_id, scene_id, CASE class_id % 3 WHEN 0 THEN 'The scene shows a ' || semantic_label || '. It is old' WHEN 1 THEN 'No ' || semantic_label || ' here. A wall; nothing else' ELSE 'There is no stairs' || chr(10) || 'A ' || semantic_label || ' stands alone' END AS answer FROM scenes, class_list)"


@query(f"""WITH {_CLAIMS}, said AS (SELECT answer_id, scene_id, {Q.fold('s')} AS s FROM (SELECT answer_id, scene_id, unnest(regexp_split_to_array(answer, '[.\\n;]')) AS s FROM claims)),
    absent AS (SELECT s.scene_id, c.semantic_label FROM (SELECT DISTINCT scene_id FROM objects) s, class_list c WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.scene_id = s.scene_id AND o.semantic_label = c.semantic_label))
    SELECT DISTINCT answer_id, a.semantic_label FROM said JOIN absent a USING (scene_id) WHERE regexp_matches(s, '\\b' || a.semantic_label || '\\b') AND NOT regexp_matches(s, '\\b(?:{'|'.join(V.ABSENCE_MARKERS)})|\\bno\\b')""")
def k1_claims_of_every_class(s, d):
    """Made-up answers, three wordings in turn, that claim each class for each scene."""
    each = table(s, d, "scenes").select("scene_id", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(V.CLASSES)))).alias("k")).select("scene_id", "k.i", "k.c")
    text = F.when(F.col("i") % 3 == 0, F.concat(F.lit("The scene shows a "), "c", F.lit(". It is old"))).when(F.col("i") % 3 == 1, F.concat(F.lit("No "), "c", F.lit(" here. A wall; nothing else"))).otherwise(F.concat(F.lit("There is no stairs\nA "), "c", F.lit(" stands alone")))
    return K.absent_claimed(each.select(F.concat_ws(" ", "scene_id", F.col("i").cast("string")).alias("answer_id"), "scene_id", text.alias("answer")), objects(s, d))


@query(f"WITH {ANSWERS}, r AS (SELECT unnest(['contains', 'inside']) AS w) SELECT answer_id, w AS relation_type FROM ans, r WHERE regexp_matches({Q.fold('answer')}, '\\b' || w || '\\b')")
def k2_invalid_relation(s, d):
    return K.invalid_relations(answers(s, d))


@query(f"WITH {ANSWERS}, n AS (SELECT DISTINCT answer_id, scene_id, unnest(regexp_extract_all(lower(answer), '\\b((?:{'|'.join(V.CLASSES)})_[0-9]+)\\b', 1)) AS obj_name FROM ans) SELECT answer_id, obj_name FROM n WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.scene_id = n.scene_id AND o.obj_name = n.obj_name)")
def k3_unknown_object(s, d):
    return K.unknown_objects(answers(s, d), objects(s, d))


@query(f"""WITH {ANSWERS}, f AS (SELECT *, {Q.fold('question')} AS q, try_cast(nullif(regexp_extract(answer, '([0-9]+)', 1), '') AS BIGINT) AS stated FROM ans),
    g AS (SELECT answer_id, scene_id, stated, {_intent('class_count')} AS classes, {_intent('count')} AS counts, ({_FIRST_NAMED}) AS label, {Q.any_of('t', V.OBJECT_WORDS)} AS things FROM (SELECT *, q AS t, {_CLASSES.replace('t,', 'q,')} AS cs FROM f)),
    h AS (SELECT g.*, (SELECT count(*) FROM objects o WHERE o.scene_id = g.scene_id) AS n_objects, (SELECT count(DISTINCT semantic_label) FROM objects o WHERE o.scene_id = g.scene_id) AS n_classes, (SELECT count(*) FROM objects o WHERE o.scene_id = g.scene_id AND o.semantic_label = g.label) AS n_label FROM g WHERE stated IS NOT NULL)
    SELECT answer_id, 'class_count_mismatch' AS kind, stated, n_classes AS expected FROM h WHERE classes AND stated <> n_classes
    UNION ALL SELECT answer_id, 'object_count_mismatch', stated, n_label FROM h WHERE counts AND label IS NOT NULL AND stated <> n_label
    UNION ALL SELECT answer_id, 'object_total_count_mismatch', stated, n_objects FROM h WHERE counts AND label IS NULL AND things AND stated <> n_objects""")
def k4_k6_count_mismatch(s, d):
    return K.count_checks(answers(s, d), objects(s, d))


def results(s: SparkSession, d: str) -> DataFrame:
    """Run results read from events: one question per event."""
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("question_id"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.when(F.col("event_type") != "signup", "text").alias("final_answer"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("n_issues"), F.pmod(F.floor("value"), F.lit(4)).cast("int").alias("n_tool_calls"), (F.col("value") / 100).alias("latency_s"))


_VERDICT = "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'unanswered' WHEN event_type = 'click' THEN 'ungrounded' WHEN floor(value) % 4 = 0 THEN 'unverified_no_tool' ELSE 'grounded' END"


@query(f"SELECT {_VERDICT} AS reliability, count(*) AS n FROM events GROUP BY ALL")
def k7_reliability(s, d):
    return K.reliability(results(s, d)).groupBy("reliability").agg(F.count("*").alias("n"))


@query(f"WITH v AS (SELECT *, {_VERDICT} AS r FROM events) SELECT count(*) AS total, count(*) FILTER (r = 'error') AS errors, count(*) FILTER (floor(value) % 4 = 0) AS zero_tool, round(avg(value / 100), 6) AS avg_latency_s, round(avg(floor(value) % 4), 6) AS avg_tool_calls, round(count(*) FILTER (r = 'grounded') / count(*) FILTER (r <> 'error'), 6) AS grounded_rate FROM v")
def d26_run_summary(s, d):
    return K.summary(results(s, d)).select("total", "errors", "zero_tool", *(F.round(c, 6).alias(c) for c in ("avg_latency_s", "avg_tool_calls", "grounded_rate")))


def calls(s: SparkSession, d: str) -> DataFrame:
    """Two tool calls of each event: its type and its user."""
    e = table(s, d, "events")
    call = lambda name, args: F.struct(F.lit(name).alias("name"), args.cast("string").alias("args"), F.col("event_type").alias("output"))
    return e.select(F.col("event_id").alias("question_id"), F.array(call("count_objects", F.col("user_id")), call("list_objects", F.col("event_id"))).alias("tool_calls"))


@query("SELECT event_id AS question_id, 1 AS step, 'count_objects' AS name, user_id::VARCHAR AS args, event_type AS output FROM events UNION ALL SELECT event_id, 2, 'list_objects', event_id::VARCHAR, event_type FROM events")
def k9_step_trace(s, d):
    return K.step_trace(calls(s, d))


@query("SELECT e.event_id AS question_id, 1 AS call_id, e.user_id AS args, CASE WHEN e.value > 50 THEN e.event_type END AS output FROM events e")
def k8_calls_with_outputs(s, d):
    e = table(s, d, "events")
    asked = e.select(F.col("event_id").alias("question_id"), F.lit(1).alias("call_id"), F.col("user_id").alias("args"))
    given = e.filter(F.col("value") > 50).select(F.col("event_id").alias("question_id"), F.lit(1).alias("call_id"), F.col("event_type").alias("output"))
    return K.calls_with_outputs(asked, given)


@query(f"""WITH l AS (SELECT doc_id, i, {Q.strip("regexp_replace(line, '^[\\s]*-+', '')")} AS line FROM (SELECT doc_id, unnest(string_split(replace(text, '?', '?' || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '?', '?' || chr(10)), chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
    q AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '^\\s*[0-9]+\\s*\\.\\s*\\S') THEN regexp_replace(line, '^\\s*[0-9]+\\s*\\.\\s*', '') ELSE line END AS line FROM l WHERE line LIKE '%?'),
    k AS (SELECT *, regexp_replace({Q.fold('line')}, '[\\s\\x{{00A0}}]+', ' ', 'g') AS key FROM q)
    SELECT key, arg_min(line, (doc_id, i)) AS question FROM k GROUP BY key""")
def a14_question_list(s, d):
    from cloudmason.sources.questions import questions

    return questions(documents(s, d).filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("?"), F.lit("?\n")), "\n")).alias("line_no", "line")))


_OBJECTS = f"list_distinct(regexp_extract_all(lower(q), '\\b((?:{'|'.join(V.CLASSES)})_[0-9]+)\\b', 1))"
_SPECIAL = {"label": "len(cs) >= 1", "two_labels": "len(cs) >= 2", "one_label": "len(cs) = 1", "pair": f"len(list_distinct({_NAMED})) >= 2", "not_wall": f"len(list_filter({_NAMED}, lambda w: w <> 'wall')) >= 1",
            "object": f"len({_OBJECTS}) >= 1", "two_objects": f"len({_OBJECTS}) >= 2", "default": "FALSE"}


def _condition(c: str) -> str:
    if "|" in c:
        return "(" + " OR ".join(f"({_condition(x)})" for x in c.split("|")) + ")"
    if c[0] == "!":
        return f"NOT ({_condition(c[1:])})"
    if c[0] == "=":
        return f"t = {Q.fold(Q.quoted([X.PROMPTS[int(c.removeprefix('=prompt_')) - 1]]))}"
    return _SPECIAL.get(c) or _intent(c)


_ROUTED = " ".join(f"WHEN {' AND '.join(map(_condition, cs))} THEN '{h}'" for h, cs in router.HANDLERS)


@query(f"WITH {ANSWERS} SELECT answer_id, CASE {_ROUTED} ELSE 'unanswered' END AS handler FROM (SELECT answer_id, q, t, {_CLASSES} AS cs FROM (SELECT answer_id, question AS q, {Q.fold('question')} AS t FROM ans))")
def r1_r26_router(s, d):
    return router.route(answers(s, d), "question").select("answer_id", "handler")


@query(f"SELECT doc_id, CASE {_ROUTED} ELSE 'unanswered' END AS handler FROM (SELECT doc_id, q, t, {_CLASSES} AS cs FROM (SELECT doc_id, text AS q, {Q.fold('text')} AS t FROM documents WHERE text IS NOT NULL))")
def r1_r26_router_on_texts(s, d):
    return router.route(documents(s, d).filter(F.col("text").isNotNull()), "text").select("doc_id", "handler")


# Questions and the handler that the documented order gives each, written down by hand.
EXPECTED = [
    ("Descrivi la scena in modo sintetico, indicando gli elementi principali che riconosci.", "scene_brief"),
    ("Qual e l'elemento piu importante o dominante nella scena?", "dominant_element"),
    ("Quali oggetti o elementi architettonici riesci a identificare con maggiore sicurezza?", "prompt_3"),
    ("La scena rappresenta uno spazio interno, esterno o misto?", "prompt_4"),
    ("Quali sono i confini principali dello spazio rappresentato?", "prompt_5"),
    ("Quali elementi sembrano delimitare, contenere o organizzare la scena?", "prompt_6"),
    ("Quali elementi risultano adiacenti tra loro?", "prompt_7"),
    ("Quali elementi sembrano essere sopra o sotto altri elementi?", "above_below"),
    ("Ci sono elementi che si intersecano o si sovrappongono?", "prompt_9"),
    ("Quali elementi sembrano supportare o sostenere altri elementi?", "prompt_10"),
    ("Quali oggetti sembrano appartenere allo stesso sistema costruttivo?", "prompt_11"),
    ("Riesci a distinguere tra elementi portanti ed elementi non portanti?", "prompt_12"),
    ("Quali elementi sembrano avere una funzione strutturale?", "material_inventory"),
    ("Quali elementi sembrano avere una funzione distributiva, di passaggio o di accesso?", "material_inventory"),
    ("La scena mostra una gerarchia chiara tra elementi principali e secondari?", "prompt_15"),
    ("Quali relazioni spaziali sono piu evidenti nella scena?", "relationship_summary"),
    ("Ci sono elementi ambigui o difficili da interpretare? Quali e perche?", "prompt_17"),
    ("La risposta del modello distingue tra cio che vede e cio che inferisce?", "prompt_18"),
    ("Il modello sta descrivendo correttamente le relazioni tra oggetti o sta facendo ipotesi troppo generiche?", "relationship_summary"),
    ("Se dovessi sintetizzare la scena con una sola etichetta tipologica, quale useresti e con quale livello di confidenza?", "material_inventory"),
    ("What is the area and the volume of the scene?", "area_and_volume"),
    ("Qual è l'impronta delle colonne?", "area"),
    ("Give me the coordinates of column_3", "coordinates"),
    ("Give me the coordinates of everything", "unanswered"),
    ("L'apertura porta è nel muro?", "opening_in_wall"),
    ("La colonna è parte dell'arco?", "part_of_classes"),
    ("Quali elementi sono portanti?", "load_bearing"),
    ("La colonna è portante?", "class_role"),
    ("Elencami gli archi", "objects_of_class"),
    ("Which relationships are there between walls and floors?", "class_pair_relations"),
    ("Relazioni della classe muro", "class_relations"),
    ("Ci sono incongruenze?", "inconsistencies"),
    ("Mostra il grafo L2", "layer_l2_is_no_graph"),
    ("Is L3 a mereological layer?", "layer_l3_is_no_part_of"),
    ("Is L1 structural?", "layer_l1_is_not_structural"),
    ("Elenca tutte le relazioni", "relationship_list"),
    ("Quali relazioni ci sono?", "relationship_summary"),
    ("Describe the scene briefly", "scene_brief"),
    ("How many columns are there?", "count_of_class"),
    ("Which classes are present?", "present_classes"),
    ("Quante classi semantiche?", "class_count"),
    ("Does the column support the arch?", "support_between"),
    ("What supports the roof?", "open_support"),
    ("Qual è l'oggetto con più punti?", "requested_facts"),
    ("Distanza tra wall_1 e wall_2", "distance"),
    ("Oggetto vicino a wall_1", "nearest_objects"),
    ("Is there plaster?", "material_inventory"),
    ("Di che materiale è la colonna centrale?", "annotated_description"),
    ("Ciao", "unanswered"),
    (None, "unanswered"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {Q.quoted([h])})" for i, (_, h) in enumerate(EXPECTED)) + ") v(question_no, handler)")
def r14_r18_expected_handlers(s, d):
    rows = s.createDataFrame([(i, q) for i, (q, _) in enumerate(EXPECTED)], "question_no int, question string")
    return router.route(rows, "question").select("question_no", "handler")
