import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudmason.llm import language as G

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labelled(documents):
    d = documents.filter(F.col("text").isNotNull()).withColumn("n", G.named_language(F.col("lang"))).filter("n is not null").orderBy("doc_id").toPandas()
    return d


def test_held_out_accuracy(labelled):
    even = labelled.iloc[::2].groupby("n").head(40)
    model = G.train(list(even["text"]), list(even["n"]))
    odd = labelled.iloc[1::2]
    hit = [G.LANGUAGES[int(model.score([s.text for s in G.sentences(t)]).sum(0).argmax())] == n for t, n in zip(odd["text"], odd["n"], strict=True) if G.sentences(t)]
    assert np.mean(hit) > 0.9  # part of the labels are wrong


def test_sentences():
    text = 'Il muro è alto (the chancel arch). Secondo il rilievo, «la torre» cade. "The side opening keeps traces. It is old." Fine del testo qui.\nwall_3 -> arch_2 | 1.5\n(12.5, 3.4, 5.6)'
    got = [s.text for s in G.sentences(text)]
    assert [g for g in got if "side opening" in g] == ["The side opening keeps traces."] and not any("chancel" in g or "torre" in g or "wall_3" in g for g in got)
    for s in G.sentences(text):
        assert 0 <= s.start < s.end <= len(text)
    assert G.sentences("") == [] and len(G.sentences("Una frase lunga abbastanza qui. " * 5000)) == 5000


def test_mixtures(labelled):
    model = G.train(list(labelled["text"]), list(labelled["n"]))
    one = [s.text for t in labelled[labelled.n == "it"]["text"].head(20) for s in G.sentences(t)][:20]
    two = [s.text for t in labelled[labelled.n == "de"]["text"].head(5) for s in G.sentences(t)]
    two = [t for t in two if any(c in t for c in "äöüß")][:1]
    subset, share, resp = G.languages_of(model.score(one + two))
    assert {G.LANGUAGES[k] for k in subset} >= {"it", "de"} and share.sum() == pytest.approx(1) and resp.shape[0] == len(one + two)
    assert [G.LANGUAGES[k] for k in G.languages_of(model.score(two))[0]] == ["de"]


def test_named_language(spark):
    rows = [(" IT ",), ("en-GB",), ("xx",), ("und",), ("",), (None,), ("pt_BR",), ("\xa0fr",), ("italian",)]
    got = [r["n"] for r in spark.createDataFrame(rows, "l string").select(G.named_language(F.col("l")).alias("n")).collect()]
    assert got == ["it", "en", None, None, None, None, "pt", "fr", None]


def test_table(spark, documents):
    extra = spark.createDataFrame([(10**9 + i, t, lang) for i, (t, lang) in enumerate([(None, "it"), ("", "it"), ("  ", None), ("The rear wall keeps traces of older plaster. " * 1000, "it"), ("The rear wall keeps traces of older plaster.", "it"), ("The rear wall keeps traces of older plaster.", "it"), ("La parete di fondo mantiene la propria integrità geometrica.", None)])], "doc_id long, text string, lang string")
    df = documents.select("doc_id", "text", "lang").unionByName(extra).selectExpr("*", "1 language", "2 share", "3 named")
    spans = G.find_languages(df).filter(F.col("doc_id") >= 10**9)
    found = sorted((r["doc_id"] - 10**9, r["lang_found"]) for r in G.unnamed_languages(spans).collect())
    assert found == [(3, "en"), (4, "en"), (5, "en"), (6, "it")]
    assert {r["language"] for r in G.document_languages(spans).collect()} == {"en", "it"}
    assert G.find_languages(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        G.find_languages(extra.withColumn("lang", F.lit("xx")))


def test_penalty_and_proportions_decide():
    """One doubtful sentence makes no second language; where there are two, the proportions settle an undecided sentence."""
    doubtful = np.full((8, 6), -100.0)
    doubtful[:, 0] = -50.0
    doubtful[3, 0], doubtful[3, 4] = -52.0, -52.0 + 0.75 * G.PENALTY
    assert doubtful.argmax(1)[3] == 4 and G.languages_of(doubtful)[0] == [0]
    mixed = np.full((10, 6), -100.0)
    mixed[:8, 0], mixed[8:, 3] = -50.0, -50.0
    mixed[7, 0], mixed[7, 3] = -50.2, -50.0
    subset, share, resp = G.languages_of(mixed)
    assert subset == [0, 3] and mixed[7].argmax() == 3 and resp[7].argmax() == 0 and share == pytest.approx([0.78, 0.22], abs=0.03)


def test_stretches_agree_with_the_choice_for_each_document(labelled):
    model = G.train(list(labelled["text"]), list(labelled["n"]))
    rows = G.stretches(labelled.assign(lang=labelled["n"]), model)
    for doc, own in rows.groupby("doc_id"):
        text = labelled[labelled.doc_id == doc]["text"].iloc[0]
        subset, _, resp = G.languages_of(model.score(G.Split([text])))
        assert set(own["language"]) == {G.LANGUAGES[subset[k]] for k in resp.argmax(1)}
        assert own["n_sentences"].sum() == len(resp)
