import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudmason.llm import mixing as X
from cloudmason.llm import packing as P
from cloudmason.llm.tokens import encoding, n_tokens, VOCABULARY

ITEMS = "item_id long, source string, size int"


def check(rows, items, capacity):
    fill, pieces = Counter(), defaultdict(list)
    for r in rows:
        fill[r["container_id"]] += r["size"]
        pieces[r["item_id"], r["source"]].append((r["piece"], r["size"]))
    assert max(fill.values()) <= capacity
    want = Counter()
    for i, s, n in items:
        if n:
            want[i, s] += n
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == dict(want)
    for (i, s), v in pieces.items():
        n = want[i, s]
        if n <= capacity:
            assert v == [(0, n)]
        else:
            assert sorted(v) == [(k, min(capacity, n - k * capacity)) for k in range(-(-n // capacity))]
    return fill


@pytest.mark.parametrize("part_tokens", [4_000_000, 30_000])
def test_pack(spark, part_tokens):
    rng = random.Random(0)
    items = [(i, rng.choice(["a", "a", "a", "b", None]), int(rng.paretovariate(1.2) * 20) % 6000) for i in range(3000)]
    fill = check(P.pack_items(spark.createDataFrame(items, ITEMS), 2048, part_tokens).collect(), items, 2048)
    assert sum(fill.values()) / len(fill) / 2048 > 0.985


def test_mixture_stays_near_the_shares():
    rng = random.Random(1)
    items = [(s, rng.randint(1, 60), i, 0) for i in range(6000) for s in [rng.choices("abc", [6, 3, 1])[0]]]
    share = Counter()
    for s, n, *_ in items:
        share[s] += n
    whole = sum(share.values())
    containers, left = P.pack(items, {}, 2048, {s: n / whole for s, n in share.items()})
    for c in containers[:-2]:
        got = Counter()
        for s, n, *_ in c:
            got[s] += n
        assert all(abs(got[s] / 2048 - share[s] / whole) < 0.08 for s in share)
    assert all(abs(v) < 2 * 2048 for v in left.values())


def test_given_targets_hold_until_a_source_runs_out(spark):
    """Twice as much of b as its target asks for: containers keep the target while a lasts, then the rest of b follows."""
    rng = random.Random(2)
    items = [(i, "ab"[i % 2], rng.randint(1, 80)) for i in range(8000)]
    packed = P.pack_items(spark.createDataFrame(items, ITEMS), 2048, 60_000, targets={"a": 2, "b": 1})
    of = defaultdict(Counter)
    for r in packed.collect():
        of[r["container_id"]][r["source"]] += r["size"]
    kept = [c["a"] / sum(c.values()) for c in of.values() if c["a"]]
    assert abs(sorted(kept)[len(kept) // 2] - 2 / 3) < 0.03
    report = {r["source"]: r for r in P.mixture(packed, {"a": 2 / 3, "b": 1 / 3}, 2048).collect()}
    assert abs(report["a"]["actual_share"] - 0.5) < 0.02 and report["b"]["running_off"] > 1 > report["a"]["running_off"]


def test_mixture_of_real_documents(spark):
    """Documents of the test table: each source's running total stays within a few containers of its share."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id item_id", "source", "cast(length(text) / 4 as int) size")
    shares = P.source_shares(docs)
    packed = P.pack_items(docs, targets=shares)
    report = P.mixture(packed, shares).collect()
    assert sum(r["target_share"] for r in report) == pytest.approx(1) and all(r["actual_share"] == pytest.approx(r["target_share"], abs=1e-3) for r in report)
    assert max(r["running_off"] for r in report) < 8 and P.container_fill(packed).selectExpr("avg(fill)").first()[0] > 0.98


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 50)), max_size=60))
def test_every_item_is_packed_once(items):
    rows = [(s, n, i, 0) for i, (s, n) in enumerate(items)]
    containers, _ = P.pack(rows, {}, 50, {"a": 0.5})
    assert sorted(x for c in containers for x in c) == sorted(rows) and all(sum(x[1] for x in c) <= 50 for c in containers)


def test_pack_missing_and_empty(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "a", None), (3, None, 5), (3, None, 5), (4, "a", 5000)], ITEMS).selectExpr("*", "1 part", "2 piece", "3 container_id")
    rows = P.pack_items(df).collect()
    assert sorted((r["item_id"], r["source"], r["size"]) for r in rows) == [(3, None, 5), (3, None, 5), (4, "a", 904), (4, "a", 2048), (4, "a", 2048)]
    assert P.pack_items(df.limit(0)).count() == 0
    assert P.container_fill(P.pack_items(df)).selectExpr("max(fill)").first()[0] == 1.0


def test_tokens(spark):
    texts = [None, "", "La volta è alta.", "x" * 200_000 + " y", "<|endoftext|>"]
    from pyspark.sql import functions as F

    got = [r["n"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", n_tokens(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got[:2] == [0, 0] and got[2:] == [len(encoding(VOCABULARY).encode_ordinary(t)) for t in texts[2:]]


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, s, rng.randint(1, 400)) for i, s in enumerate(rng.choices(["big", "mid", "tiny", "extra"], [70, 25, 1, 4], k=8000))] + [(9000, None, 50), (9001, "big", 0)]
    targets = [{"source": "big", "target_share": 0.5, "max_repeats": 1}, {"source": "mid", "target_share": 0.4, "max_repeats": 3}, {"source": "tiny", "target_share": 0.1, "max_repeats": 4}, {"source": "absent", "target_share": 0.0, "max_repeats": 2}]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens int").selectExpr("*", "1 budget", "2 h", "3 uses")
    uses, report = X.mix(df, targets)
    rows, total = uses.collect(), sum(d[2] for d in docs)
    rep = {r["source"]: r for r in report.collect()}
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "mid", "tiny"}
    for s, t in ((t["source"], t) for t in targets):
        own = [r for r in rows if r["source"] == s]
        used = sum(r["tokens"] * r["uses"] for r in own)
        assert used == rep[s]["used_tokens"] and all(r["uses"] <= t["max_repeats"] for r in own)
        assert rep[s]["capped"] or abs(used - t["target_share"] * total) <= 200
    assert rep["tiny"]["capped"] and rep["tiny"]["most_uses"] == 4 and rep["tiny"]["used_tokens"] == 4 * rep["tiny"]["source_tokens"]
    assert X.mix(df.limit(0), targets)[0].count() == 0 and X.mix(df, [])[0].count() == 0


def test_temperature():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0}
    assert X.tempered(sizes, 0.0) == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}) and X.tempered(sizes, 1.0)["c"] == pytest.approx(10 / 1110)
    target = 0.8
    a, why = X.exponent_for(sizes, target, {s: math.inf for s in sizes})
    assert why == "entropy" and X.entropy(X.tempered(sizes, a)) == pytest.approx(target, abs=1e-6)
    a, why = X.exponent_for(sizes, math.log(3), {"a": 1, "b": 3, "c": 5})
    w = X.tempered(sizes, a)
    assert why == "repeats" and max(w[s] * 1110 / (sizes[s] * r) for s, r in {"a": 1, "b": 3, "c": 5}.items()) == pytest.approx(1, abs=1e-6)
    assert X.tempered({"a": 0.0, "b": 5.0}, 0.5) == {"a": 0.0, "b": 1.0} and X.tempered({}, 1.0) == {}
