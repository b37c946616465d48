"""Free-entered values mapped to the closest entry of a reference list.

The reference entries form a BK-tree under the unrestricted Damerau-Levenshtein distance, a true metric, so that the
triangle inequality prunes and every entry within the threshold is found. A list of bounded size is shipped with the
tasks; a longer one is split into shards, every distinct value meets each shard's tree and the shards' readings merge. Both
ways read codes, decoration, abbreviations and compounds alike and give the same result.

The list may be widened by wordings learned from another column that names the same things (learned_entries).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudmason.functions.frames import plain

#: Entries up to which the tree is shipped whole; a longer list is sharded.
MAX_BROADCAST_ENTRIES = 50_000
SHARD_ENTRIES = 20_000
NONE = -1

# Words that say where or how large, not what.
QUALIFIERS = {"north", "south", "east", "west", "nord", "sud", "est", "ovest", "sx", "dx", "left", "right", "links", "rechts", "small", "large", "piccolo", "grande", "alto", "basso", "upper", "lower", "sur", "norte", "este", "oeste", "ost", "süd", "klein", "groß", "petit", "grand"}


def fold(text: str) -> str:
    """Lower case, without accents and with single blanks."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, swap of neighbours, each 1. A metric."""
    if a == b:
        return 0
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, above, swap = [far, i], rows[i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), swap
            if x == y:
                cost, swap = above[j], j
            else:
                cost = min(above[j], row[j], above[j + 1]) + 1
            jump = rows[k][m] + (i - k - 1) + 1 + (j - m - 1)
            row.append(cost if cost < jump else jump)
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


class BKTree:
    """Entries under a metric. within() returns every entry not farther than the radius."""

    def __init__(self, metric: Callable[[str, str], int] = distance):
        self.metric, self.root, self.kids = metric, None, {}
        self.payload: dict[str, list] = defaultdict(list)

    def add(self, word: str, value: object) -> None:
        if value in self.payload[word]:
            return
        self.payload[word].append(value)
        if self.root is None:
            self.root, self.kids[word] = word, {}
        if word in self.kids:
            return
        at = self.root
        while True:
            d = self.metric(word, at)
            if d not in self.kids[at]:
                self.kids[at][d], self.kids[word] = word, {}
                return
            at = self.kids[at][d]

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        found, todo = [], [self.root] if self.root is not None else []
        while todo:
            at = todo.pop()
            d = self.metric(word, at)
            if d <= radius:
                found.append((d, at))
            todo += [kid for edge, kid in self.kids[at].items() if d - radius <= edge <= d + radius]
        return sorted(found)


def threshold(word: str) -> int:
    """Edits allowed by length: the share of wrong letters stays about a quarter."""
    return 0 if len(word) < 3 else 1 if len(word) <= 6 else 2 if len(word) <= 9 else 3


_LEET = [str.maketrans("0135", "oles"), str.maketrans("0135", "oies"), str.maketrans("0135", "oaes")]
_CODE = re.compile(r"(?:class|classe|klasse|clase|cls|code|label)?[ _.:#-]*([0-9]+)(?:[.,]0+)?")
_CODED = re.compile(r"([0-9]{1,3})\s*[-:=]\s*(.+)")
_CHECK = re.compile(r"[-,;(]\s*(?:to check|da verificare|check|zu prüfen|por revisar|a verificar|à vérifier)\)?$")
_NUMBERED = re.compile(r"(?:\s*(?:#|\bn\.|\bnr\.?|_|-)\s*[0-9]+|\s*\[[0-9]+\]|\s+[0-9]+)$")


def _clean(text: str) -> str:
    """The typed value without quotes, brackets, running numbers, places, remarks and repeats."""
    text = " ".join(text.replace("\xa0", " ").split())
    while True:
        was = text
        text = _CHECK.sub("", text).strip()
        text = text if re.fullmatch(r"[a-z]{1,6}\.", text) else text.rstrip(" ?!.,;:").lstrip(" .,;:") or text
        if len(text) > 1 and (text[0], text[-1]) in {("[", "]"), ("(", ")"), ('"', '"'), ("'", "'"), ("«", "»"), ("“", "”")}:
            text = text[1:-1]
        text = _NUMBERED.sub("", text)
        if m := re.fullmatch(r"(.+?)\s*\(([^()]*)\)", text):
            text = m[1] if all(w in QUALIFIERS for w in m[2].split()) else text
        words = text.split()
        if len(words) > 1 and words[-1] in QUALIFIERS:
            text = " ".join(words[:-1])
        elif len(words) > 1 and words[0] in QUALIFIERS:
            text = " ".join(words[1:])
        parts = [x.strip() for x in text.split("/")]
        if len(parts) % 2 == 0 and [x.rstrip(".") for x in parts[: len(parts) // 2]] == [x.rstrip(".") for x in parts[len(parts) // 2 :]]:
            text = "/".join(parts[: len(parts) // 2])
        text = text.strip()
        if text == was:
            return text


def _spaced(text: str) -> str:
    return re.sub(r"[\s_/.-]+", " ", text).strip()


def _skeleton(word: str) -> str:
    """The first letter and the consonants after it."""
    return word[:1] + re.sub("[aeiou]", "", word[1:])


#: What a value can be read as, in the order in which readings count; a reading counts only if all its entries mean the same.
KINDS = ["exact", "begins", "consonants", "closest", "words", "last_word", "compound", "stem"]


class Canon:
    """Entries of a list, or of one shard of it, and what typed values can be read as among them.

    entries: (word, value); codes: numbers that stand for themselves; catch_all: values that take only near misses of one
    edit, because whatever resembles nothing else would resemble them."""

    def __init__(self, entries: Iterable[tuple[str, int]], codes: Iterable[int], catch_all: Iterable[int] = ()):
        self.tree, self.codes, self.catch_all = BKTree(), set(codes), set(catch_all)
        for word, value in entries:
            self.tree.add(fold(word), value)
            self.tree.add(_spaced(fold(word)), value)
        self.words = sorted(w for w in self.tree.payload if w)

    def _best(self, words: Iterable[str]) -> list[tuple[int, str]]:
        """(value, entry) of the entries: the lowest value and, if they mean several, another one."""
        got = sorted({(v, w) for w in words for v in self.tree.payload[w]})
        return got[:1] + [x for x in got if x[0] != got[0][0]][:1]

    def nearest(self, text: str) -> tuple[int, list[tuple[int, str]]] | None:
        """(distance, entries) of the closest entries within the threshold."""
        found = [(d, w) for d, w in self.tree.within(text, threshold(text)) if d <= threshold(max(text, w, key=len)) and d < min(len(text), len(w)) - 1]
        found = [(d, w, v) for d, w in found for v in self.tree.payload[w] if d <= 1 or v not in self.catch_all]
        if not found:
            return None
        return found[0][0], [(v, w) for v, w in sorted((v, w) for d, w, v in found if d == found[0][0])][:1]

    def _short(self, text: str, begins: Callable[[str, str], bool]) -> list[str]:
        """Entries that the text shortens: cut by a full stop, each word cut, or with its middle left out."""
        if m := re.fullmatch(r"([a-z]{2,})\.", text):
            return [w for w in self.words if begins(w, m[1])]
        if m := re.fullmatch(r"([a-z]{2,})\.([a-z]{3,})", text):
            return [w for w in self.words if w.startswith(m[1]) and w.endswith(m[2])]
        parts = text.split("/")
        if len(parts) > 1 and all(re.fullmatch("[a-z]{2,}", p) for p in parts):
            return [w for w in self.words if len(x := w.split()) == len(parts) and all(begins(a, b) for a, b in zip(x, parts, strict=True))]
        return []

    def readings(self, value: str) -> dict[str, list]:
        """By kind: [distance, (value, entry), ...] with one value, or two if the reading is ambiguous; "code": [code, alone, listed]."""
        typed = " ".join(value.replace("\xa0", " ").casefold().split())
        folded = fold(_clean(typed))
        got: dict[str, list] = {}
        if m := _CODE.fullmatch(fold(typed).strip("[](){}\"' ?.")) or _CODE.fullmatch(folded):
            return {"code": [int(m[1]), True, int(m[1]) in self.codes]}
        if m := _CODED.fullmatch(fold(typed)) or _CODED.fullmatch(folded):
            folded = _clean(m[2])
            if not re.search("[a-z]{2}", folded):
                got["code"] = [int(m[1]), False, int(m[1]) in self.codes]
        forms = dict.fromkeys([folded, _spaced(folded)])
        for form in list(forms):
            if re.search("[0135]", form) and re.search("[a-z]", form):
                forms |= dict.fromkeys(form.translate(t) for t in _LEET)

        def note(kind: str, words: Iterable[str]) -> None:
            if kind not in got and (best := self._best(words)):
                got[kind] = [0, *best]

        for form in forms:
            note("exact", [form] if form in self.tree.payload and form else [])
        if "exact" in got:
            return got
        closest = min((x for form in forms if form and (x := self.nearest(form))), default=None)
        if closest:
            got["closest"] = [closest[0], *closest[1]]
        for form in forms:
            note("begins", self._short(form, str.startswith))
            note("consonants", self._short(form, lambda w, m: w[:1] == m[:1] and _skeleton(w).startswith(m)))
            words = form.split()
            if len(words) > 1:
                note("words", [w for w in words if len(w) > 2 and w in self.tree.payload])
                if len(words[-1]) > 3 and (x := self.nearest(words[-1])) and x[0] <= 1:
                    note("last_word", [w for _, w in x[1]])
            elif len(form) > 3 and form.isalpha():
                note("compound", [w for w in self.words if len(w) > 4 and form.endswith(w)])
                note("stem", [w for w in self.words if len(w) > len(form) and w.startswith(form) or len(w) > 4 and form.startswith(w) and len(form) - len(w) <= 3])
        return got


def merged(several: Iterable[dict[str, list]]) -> dict[str, list]:
    """The readings of all shards as one list would give them."""
    out: dict[str, list] = {}
    for got in several:
        for kind, new in got.items():
            old = out.get(kind)
            if old is None:
                out[kind] = new
            elif kind == "code":
                out[kind] = [*old[:2], old[2] or new[2]]
            elif kind == "closest":
                out[kind] = min(old, new)
            else:
                best = sorted({tuple(x) for x in old[1:] + new[1:]})
                out[kind] = [0, *best[:1], *[x for x in best if x[0] != best[0][0]][:1]]
    if "exact" in out:
        return {k: out[k] for k in ("exact", "code") if k in out}
    return out


def decided(got: dict[str, list]) -> tuple[int, str | None, int]:
    """(value or NONE, entry, distance) from all readings."""
    code = got.get("code")
    if code and code[1]:
        return (code[0], str(code[0]), 0) if code[2] else (NONE, None, 0)
    for kind in KINDS:
        if kind in got:
            distance, first, *other = got[kind]
            if kind == "exact" or not other:  # of equal entries the lowest value
                return first[0], first[1], distance
            if kind in ("begins", "words"):
                break  # cut too short to say which, or several are named: no further guess
    if code and code[2]:
        return code[0], str(code[0]), 0
    return NONE, None, 0


def meaning(canon: Canon, value: str) -> tuple[int, str | None, int]:
    return decided(canon.readings(value))


def plurals(word: str, language: str) -> list[str]:
    """Regular plurals of the languages that the list may be written in."""
    ends = {
        "it": [("co", "chi"), ("go", "ghi"), ("ca", "che"), ("ga", "ghe"), ("o", "i"), ("a", "e"), ("e", "i")],
        "fr": [("eau", "eaux"), ("", "s")],
        "de": [("e", "en")] if word.endswith("e") else [("", "e"), ("", "en")],
        "es": [("z", "ces"), *((v, v + "s") for v in "aeiou"), ("", "es")],
        "pt": [("m", "ns"), ("ao", "oes"), *((v, v + "s") for v in "aeiou"), ("", "es")],
        "en": [("ch", "ches"), ("s", "ses"), ("", "s")],
    }[language]
    found = [word[: len(word) - len(a)] + b for a, b in ends if word.endswith(a)]
    return found if language == "de" else found[:1]


def class_entries(rows: Iterable[dict]) -> list[tuple[str, int]]:
    """Entries from the class list: names in all its languages, what the gloss adds, and their plurals. Where the gloss
    names the parts of a compound name, the parts are entries in every language."""
    entries: dict[tuple[str, int], None] = {}
    for row in rows:
        gloss = [w.strip() for w in (row.get("gloss") or "").partition("also ")[2].split(",") if w.strip()]
        names = [("en", w) for w in [row.get("semantic_label"), *gloss] if w] + [(k[5:], v) for k, v in row.items() if k.startswith("name_") and v]
        parts = _spaced(row.get("semantic_label") or "").split()
        if len(parts) > 1 and set(parts) <= set(gloss):
            names += [(language, w) for language, name in names for w in _spaced(name).split() if len(_spaced(name).split()) == len(parts)]
        for language, name in names:
            for word in [name, *plurals(fold(name), language)]:
                entries[word, row["class_id"]] = None
    return list(entries)


def list_entries(listed: DataFrame) -> DataFrame:
    """word, entry_id: class_entries() of a table with class_id, semantic_label, gloss, name_it, ..."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{k: v for k, v in r.items() if isinstance(v, str)} | {"class_id": r["class_id"]} for r in batch.to_dict("records")]
            yield pd.DataFrame(class_entries(rows), columns=["word", "entry_id"]).astype({"word": object, "entry_id": "int64"})

    return listed.mapInPandas(run, "word string, entry_id long")


def learned_entries(pairs: DataFrame, wording: str, name: str, least: int = 3, pure: float = 0.9) -> DataFrame:
    """word, name, n: wordings of one column that stand beside one name of another column, at least so often and in so
    large a share of their rows. Both columns name the same thing; rows with a null or blank in either are not counted."""
    both = pairs.select(F.lower(F.trim(wording)).alias("word"), F.col(name).alias("name")).filter((F.col("word") != "") & (F.trim("name") != ""))
    counts = both.groupBy("word", "name").agg(F.count("*").alias("n"))
    best = counts.groupBy("word").agg(F.sum("n").alias("total"), F.max_by(F.struct("name", "n"), F.struct("n", "name")).alias("top"))
    return best.filter((F.col("top.n") >= least) & (F.col("top.n") >= pure * F.col("total"))).select("word", F.col("top.name").alias("name"), F.col("top.n").alias("n"))


ADDED = [T.StructField("canon_id", T.LongType()), T.StructField("canon_entry", T.StringType()), T.StructField("canon_distance", T.IntegerType())]


def map_values(values: DataFrame, column: str, canon: Canon) -> DataFrame:
    """values with canon_id, canon_entry and canon_distance appended; one pass, no shuffle, repeats cached in each task.

    Defined cases: null and blank values get null in all three; values that mean none get canon_id -1 and a null entry;
    ties go to the lowest id; repeated rows each keep their row. Existing columns of the appended names are replaced.
    """
    values = values.drop("canon_id", "canon_entry", "canon_distance")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lru_cache(maxsize=200_000)(lambda v: meaning(canon, v))
        for batch in batches:
            got = [of(v) if isinstance(v, str) and v.strip() else (None, None, None) for v in batch[column]]
            yield plain(batch.assign(canon_id=pd.array([g[0] for g in got], "Int64"), canon_entry=[g[1] for g in got], canon_distance=pd.array([g[2] for g in got], "Int32")))

    return values.mapInPandas(run, T.StructType([*values.schema.fields, *ADDED]))


def map_to_list(values: DataFrame, column: str, entries: DataFrame, codes: bool = False, catch_all: Iterable[int] = (), most_broadcast: int = MAX_BROADCAST_ENTRIES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """As map_values(), for a list of any length given as a table.

    entries: word string, entry_id long; further columns are ignored, rows with a null in either are left out. codes:
    whether the ids themselves may be typed. Up to most_broadcast entries go to every task; a longer list is cut into
    shards, every distinct value is read by each shard, and the readings merge to the same result.
    """
    listed = entries.select(F.col("word").cast("string").alias("word"), F.col("entry_id").cast("long").alias("entry_id")).dropna()
    catch_all = list(catch_all)

    def canon(rows: list[tuple[str, int]]) -> Canon:
        return Canon(rows, {i for _, i in rows} if codes else (), catch_all)

    n = listed.count()
    if n <= most_broadcast:
        return map_values(values, column, canon([(r["word"], r["entry_id"]) for r in listed.collect()]))
    shards, parts = -(-n // shard_entries), 64
    values = values.drop("canon_id", "canon_entry", "canon_distance")
    texts = values.select(F.col(column).cast("string").alias("value_")).filter(F.trim("value_") != "").distinct()
    asked = texts.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part", F.pmod(F.xxhash64("value_"), F.lit(parts)).cast("int"))
    dealt = listed.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = canon(list(zip(right["word"], right["entry_id"].astype(int), strict=True)))
        return pd.DataFrame({"value_": left["value_"], "read": [json.dumps(own.readings(v)) for v in left["value_"]]}, columns=["value_", "read"]).astype(object)

    read = asked.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInPandas(probe, "value_ string, read string").groupBy("value_").agg(F.collect_list("read").alias("read"))  # one per shard

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [decided(merged(map(json.loads, r))) for r in batch["read"]]
            yield plain(pd.DataFrame({"value_": batch["value_"], "canon_id": pd.array([g[0] for g in got], "Int64"), "canon_entry": pd.Series([g[1] for g in got], dtype=object), "canon_distance": pd.array([g[2] for g in got], "Int32")}))

    chosen = read.mapInPandas(choose, T.StructType([T.StructField("value_", T.StringType()), *ADDED]))
    return values.join(chosen, F.col(column).cast("string") == chosen["value_"], "left").drop("value_")
