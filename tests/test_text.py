import pytest
from pyspark.sql import functions as F

from cloudmason.functions import text as X


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (X.fold, "\t Àrco\xa0", "arco"), (X.fold, "Cupolá", "cupola"), (X.slug, "Pietra d'Istria", "PietraDistria"), (X.slug, "--", "Unspecified"), (X.pascal, "arco_a tutto", "ArcoATutto"),
        (X.header_slug, " Global Box-Center X ", "global_box_center_x"), (X.split_values, "a; b|c;;", ["a", "b", "c"]), (X.split_values, None, []), (X.row_text, None, ""), (X.row_text, ' "x" ', "x"),
        (X.l2_label, " Pareti ", "wall"), (X.l2_label, "Altar", "altar"), (X.l2_label, "  ", None), (X.l3_class, "Porta/Finestra", "door_window"), (X.decimal, " 1,5 ", 1.5), (X.decimal, "x", None),
        (X.truthy, " Si ", True), (X.truthy, None, False), (X.mentioned_classes, "La volta e l'arco, non archivolto", ["arch", "vault"]), (X.question_classes, "archi, muro e porta finestra e archi", ["arch", "wall", "door_window", "arch"]),
        (X.object_names, "wall_3 and Arch_10, item_4, wall_3", ["wall_3", "arch_10"]), (X.split_questions, "a? b? c", ["a?", "b?", "c"]), (X.first_integer, "no 12 and 3", 12), (X.first_integer, "none", None),
        (X.strip_ordinal, "12. what?", "what?"), (X.strip_ordinal, "12.", "12."), (X.layer_key, " KG ", "L3_KG_DETAIL"), (X.layer_key, "zzz", None), (X.response_language, "How many walls are there?", "en"), (X.path_safe, "a b/c", "a_b_c"),
        (X.position, "la colonna sinistra", "left"), (X.relation_type, "cosa sta sopra", "above"),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, f, value) == want


def test_formats(spark):
    d = spark.createDataFrame([(96.115,), (None,), (2.5,)], "v double").select(X.fixed(F.col("v"), 2).alias("r"))
    assert [r["r"] for r in d.collect()] == ["96.11", None, "2.50"]
    assert X.material_words("Pietra serena") == ["pietra", "stone"] and X.material_words("Bronzo") == ["bronzo"]
