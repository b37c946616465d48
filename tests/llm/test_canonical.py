import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudmason.llm import canonical as C

ROWS = [{"class_id": i, "semantic_label": n, "name_it": it, "gloss": g} for i, (n, it, g) in enumerate([("arch", "arco", "also archway"), ("column", "colonna", "also pillar, shaft"), ("moldings", "modanature", ""), ("floor", "pavimento", ""), ("door_window", "porta finestra", "also door, window"), ("wall", "parete", ""), ("stairs", "scala", ""), ("vault", "volta", ""), ("roof", "tetto", ""), ("other", "altro", "also miscellaneous")])]
CANON = C.Canon(C.class_entries(ROWS), range(10), [9])


def naive(a, b):
    """The textbook recurrence of the unrestricted distance."""
    da, inf = {}, len(a) + len(b)
    d = {(-1, -1): inf}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = inf, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = inf, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            i1, j1 = da.get(b[j - 1], 0), db
            cost = a[i - 1] != b[j - 1]
            if not cost:
                db = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[i1 - 1, j1 - 1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        da[a[i - 1]] = i
    return d[len(a), len(b)]


WORDS = st.text("abc", max_size=7)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_distance_is_the_metric(a, b, c):
    assert C.distance(a, b) == naive(a, b) == C.distance(b, a)
    assert C.distance(a, c) <= C.distance(a, b) + C.distance(b, c)
    assert (C.distance(a, b) == 0) == (a == b)


def test_tree_finds_every_entry_within():
    rng = random.Random(0)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(600)}
    tree = C.BKTree()
    for w in sorted(words):
        tree.add(w, 1)
    for _ in range(150):
        q = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 8)))
        for r in (0, 1, 2, 3):
            assert tree.within(q, r) == sorted((C.distance(q, w), w) for w in words if C.distance(q, w) <= r)


@pytest.mark.parametrize(
    ("value", "want"),
    [(" Arch ", 0), ("coulmn", 1), ("C0lumn", 1), ("col.", 1), ("colonne", 1), ("pilasters", -1), ("pillars", 1), ("column shaft", 1), ("st.case", -1), ("cur.wall", 5), ("wall_21", 5), ("[2]", 2), ("3 - floor", 3), ("05", 5), ("7.0", 7), ("class 9", 9), ("cls_31", -1), ("12", -1), ("???", -1), ("17 - ?", -1), ("4 - ?", 4), ("vault (north)", 7),
     ("roof/roof", 8), ('"tetto" - to check', 8), ("rf.", 8), ("par.", 5), ("albero", -1), ("scaffolding", -1), ("misc.", 9), ("others", 9), ("altri", 9), ("finestre", 4), ("porta", 4), ("flooring", 3), ("halfcolumn", 1), ("wall of the roof", -1), ("unknown", -1), ("??? alto", -1), ("dr/wnd", 4), ("x" * 5000, -1)],
)
def test_meaning(value, want):
    assert C.meaning(CANON, value)[0] == want


def test_map_values(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t", 5), (4, "colunm", 5), (4, "colunm", 5), (5, "zzzzzz", 5)]
    df = spark.createDataFrame(rows, "id long, v string, canon_id int")
    got = C.map_values(df, "v", CANON)
    assert sorted((r["id"], r["canon_id"], r["canon_entry"]) for r in got.collect() if r["canon_id"] is not None) == [(4, 1, "column"), (4, 1, "column"), (5, -1, None)]
    assert got.count() == 6 and C.map_values(df.limit(0), "v", CANON).count() == 0


def test_a_long_list_gives_the_same_in_shards(spark):
    """Codes, decoration, abbreviations, ties and near misses read alike whether the list is shipped whole or in shards."""
    rng = random.Random(3)
    entries = [("".join(rng.choice("abcdef") for _ in range(rng.randint(4, 9))), i) for i in range(400)] + C.class_entries(ROWS)
    values = ["".join(rng.choice("abcdef") for _ in range(rng.randint(4, 9))) for _ in range(200)] + [entries[0][0], None, " ", "colunm", "wall (north)", "4 - ?", "7.0", "999", "colu.", "c.", "dr/wnd", "column wall", "old wall", "stonewall", "fa.", "abc."]
    rows, listed = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, canon_id int"), spark.createDataFrame(entries, "word string, entry_id long").selectExpr("*", "1 v", "'x' value_")
    found = [{(r["v"], r["canon_id"], r["canon_entry"], r["canon_distance"]) for r in C.map_to_list(rows, "v", listed, codes=True, most_broadcast=m, shard_entries=60).collect()} for m in (10_000, 10)]
    assert found[0] == found[1] and len(found[0]) == len(set(values))
    by = {v: (i, d) for v, i, _, d in found[0]}
    for v in values[:200]:
        at = [(C.distance(v, w), i) for w, i in entries if C.distance(v, w) <= C.threshold(max(v, w, key=len))]
        assert not at or by[v][1] == 0 or min(at)[0] >= by[v][1]
    assert by[None] == by[" "] == (None, None) and by["999"][0] == -1 and by["7.0"][0] == 7
    assert C.map_to_list(rows.limit(0), "v", listed, most_broadcast=10).count() == 0 and {r["canon_id"] for r in C.map_to_list(rows, "v", listed.limit(0)).collect()} == {None, -1}


def test_learned_entries(spark):
    rows = [("Copertura", "roof")] * 9 + [("copertura ", "wall")] + [("Volta", "vault")] * 2 + [(None, "roof"), ("x", None), ("muro", "wall"), ("muro", "wall"), ("muro", "roof")]
    got = C.learned_entries(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert [(r["word"], r["name"], r["n"]) for r in got] == [("copertura", "roof", 9)]
