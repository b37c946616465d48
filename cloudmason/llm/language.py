"""Missing or wrong language labels: the language of each document and of each stretch in another language.

A character n-gram model per language is fitted on a bounded sample of labelled documents and sharpened by re-assigning
their sentences (labels may be wrong, texts mixed). Every document is cut into sentences, quoted ones included. Its
language proportions come from expectation-maximisation over the sentences' n-gram likelihoods; the set of languages is
selected greedily by penalised likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.functions.frames import plain

LANGUAGES = ["it", "en", "fr", "de", "es", "pt"]
#: Labelled documents per language that the model is fitted on, at most; candidates are drawn by a hash of their id.
TRAIN_DOCS = 400
#: n-gram orders and the slots of the hashed table of each order.
ORDERS, SLOTS = (1, 2, 3, 4), 1 << 16
REFITS = 3
WHOLE_CHARS = 2000
#: Natural-log likelihood, per character made comparable across orders, that a further language must bring.
PENALTY = 4.0
EM_STEPS = 12
LEAST_WORDS = 3

_QUOTED = re.compile(r"«([^«»]*)»|“([^“”]*)”|„([^„“”]*)[“”]|\"([^\"]*)\"|\(([^()]*)\)|‘([^‘’]{12,})’|‹([^‹›]*)›")
_OPENS, _ENDED = re.compile("[«“„\"(‘‹]"), re.compile("[.!?…]")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"(?<=[.!?…])[\s»”\"')\]]+|\n+")
_OBJECT, _ID = re.compile(r"\b[A-Za-z]+(?:_[A-Za-z]+)?_\d+"), re.compile(r"\b\w+_\d+")
#: What a character can be, as bits.
LETTER, CLOSES, ENDS, NEWLINE, BLANK, UNDERLINE = 1, 2, 4, 8, 16, 32


@dataclass
class Sentence:
    text: str
    start: int
    end: int


def _kind(c: str) -> int:
    return (LETTER * (c.isalnum() and not c.isdecimal()) | CLOSES * (c.isspace() or c in "»”\"')]") | ENDS * (c in ".!?…") | NEWLINE * (c == "\n") | BLANK * (c == " ") | UNDERLINE * (c == "_"))


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower-case code of each character below 0x10000."""
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x10000)]
    return np.array([_kind(c) for c in chars], np.uint8), np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], np.uint32)


class Split:
    """The full sentences of many texts, found on all their characters at once; those in quotes or brackets by themselves.

    Terms in quotes or brackets belong to no sentence. owner: the text of each sentence; start, end: its place there."""

    def __init__(self, texts: list[str]):
        pieces: list[tuple[int, int, str]] = []
        for i, text in enumerate(texts):
            if not _OPENS.search(text):
                pieces.append((i, 0, text))
                continue
            at, shown = 0, []
            for m in _QUOTED.finditer(text):
                inner = m[m.lastindex]
                if _ENDED.search(inner) and any(len(_WORD.findall(p)) >= LEAST_WORDS for p in _BREAK.split(inner)):
                    pieces.append((i, m.start() + 1, inner))
                shown += [text[at : m.start()], " " * (m.end() - m.start())]
                at = m.end()
            pieces.append((i, 0, "".join(shown) + text[at:]))
        joined = "\n".join([p[2] for p in pieces])
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        kinds, lower = _characters()
        wide = code > 0xFFFF
        kind = kinds[np.where(wide, 0, code)]
        if wide.any():
            kind[wide] = [_kind(chr(c)) for c in code[wide]]
        first = np.cumsum([0, *(len(p[2]) + 1 for p in pieces)])[:-1] if pieces else np.zeros(0, int)
        # A break: closing signs and blanks after a full stop, or line ends.
        closes = (kind & CLOSES) > 0
        ended = np.r_[False, (kind[:-1] & ENDS) > 0]
        opens = closes & ~np.r_[False, closes[:-1]]
        run = np.cumsum(opens)
        breaks = closes & (np.r_[False, ended[opens]][run] | ((kind & NEWLINE) > 0))
        edge = np.diff(np.r_[True, breaks, True].astype(np.int8))
        a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        letter = (kind & LETTER) > 0
        upto = lambda mask: np.r_[0, np.cumsum(mask)]
        counted = lambda mask: (c := upto(mask))[b] - c[a]
        words, letters, blanks, lines = counted(letter & ~np.r_[False, letter[:-1]]), counted(letter), counted((kind & BLANK) > 0), counted((kind & UNDERLINE) > 0)
        good = (words >= LEAST_WORDS) & (letters >= 0.6 * (b - a - blanks))  # else coordinates or table rows
        self.letter = letter.copy()
        for k in np.flatnonzero(good & (lines > 0)):
            part = joined[a[k] : b[k]]
            ids = len(_OBJECT.findall(part))
            good[k] = ids < len(_WORD.findall(_OBJECT.sub("", part)))
            for m in _ID.finditer(part):
                self.letter[a[k] + m.start() : a[k] + m.end()] = False
        a, b = a[good], b[good]
        piece = np.searchsorted(first, a, "right") - 1
        owner = np.array([p[0] for p in pieces], int)[piece] if pieces else piece
        start = a - first[piece] + np.array([p[1] for p in pieces], int)[piece] if pieces else a
        order = np.lexsort((start, owner))
        self.joined = joined
        self.at, self.to, self.owner, self.start = a[order], b[order], owner[order], start[order]
        self.end = self.start + self.to - self.at
        self.lower = np.where(wide, code, lower[np.where(wide, 0, code)]) if wide.any() else lower[code]

    def __len__(self) -> int:
        return len(self.at)

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower-case letters of all sentences as numbers, other characters as one blank, and each sentence's first position."""
        size = self.to - self.at
        which = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.at[which]
        letter = self.letter[place]
        before = np.r_[False, letter[:-1]] & np.r_[False, which[1:] == which[:-1]] if len(which) else letter
        keep = letter | before
        which, place, letter = which[keep], place[keep], letter[keep]
        # a blank before each sentence and three after it: no n-gram reaches into the next one
        kept = np.bincount(which, minlength=len(size))
        starts = np.cumsum(kept + 4) - kept - 4
        out = np.full(int(kept.sum() + 4 * len(size)), 32, np.uint64)
        out[np.arange(len(which)) + 4 * which + 1] = np.where(letter, self.lower[place], 32)
        return out, starts


def sentences(text: str) -> list[Sentence]:
    """Full sentences of one text, in order."""
    s = Split([text])
    return [Sentence(s.joined[at:to], int(a), int(b)) for at, to, a, b in zip(s.at, s.to, s.start, s.end, strict=True)]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As Split.codes(), of whole texts."""
    clean = [" " + re.sub(r"[\W\d_]+", " ", _ID.sub(" ", t.lower())) + "   " for t in texts]
    starts = np.cumsum([0, *map(len, clean)])[:-1] if clean else np.zeros(0, int)
    return np.frombuffer("".join(clean).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64), starts


def _slots(codes: np.ndarray, order: int) -> np.ndarray:
    """Slot of the n-gram that starts at each position."""
    h = np.zeros(max(0, len(codes) - order + 1), np.uint64)
    for k in range(order):
        h *= np.uint64(0x100000001B3)
        h += codes[k : len(codes) - order + 1 + k] + np.uint64(k + 1)
        h &= np.uint64(0xFFFFFFFFFFFF)
    return ((h ^ (h >> np.uint64(17))) % np.uint64(SLOTS)).astype(np.int32)


class LanguageModel:
    """Hashed n-gram log probabilities by order and language, shaped (orders, slots, languages)."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    @staticmethod
    def fit(slots: list[np.ndarray], owner: np.ndarray, weights: np.ndarray) -> LanguageModel:
        """slots: of each order; owner: the text of each position; weights: (texts, languages), the share of each text that
        counts for each language."""
        tables = np.empty((len(ORDERS), SLOTS, weights.shape[1]), np.float32)
        for k in range(weights.shape[1]):
            own = weights[:, k][owner]
            for o, slot in enumerate(slots):
                n = np.bincount(slot, own[: len(slot)], SLOTS) + 0.02
                tables[o, :, k] = np.log(n / n.sum())
        return LanguageModel(tables)

    def sums(self, slots: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Log-likelihoods (texts, languages): the orders' sums, averaged."""
        if not len(starts):
            return np.zeros((0, self.tables.shape[2]))
        per = np.zeros((max(map(len, slots)), self.tables.shape[2]), np.float32)
        for o, slot in enumerate(slots):
            per[: len(slot)] += self.tables[o].take(slot, axis=0)
        return np.add.reduceat(per, starts, axis=0, dtype=np.float64) / len(ORDERS)

    def score(self, texts: list[str] | Split) -> np.ndarray:
        codes, starts = texts.codes() if isinstance(texts, Split) else _codes(texts)
        return self.sums([_slots(codes, order) for order in ORDERS], starts)


def train(texts: list[str], labels: list[str]) -> LanguageModel:
    """Fit on whole documents by label, then on their sentences by what the model itself takes them for."""
    onehot = np.eye(len(LANGUAGES))[[LANGUAGES.index(x) for x in labels]]
    # a document counts as much as WHOLE_CHARS characters at most: one long text with a wrong label must not make a language
    size = np.array([max(1, len(t)) for t in texts])
    even = np.minimum(1.0, WHOLE_CHARS / size)

    def placed(codes: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        return [_slots(codes, order) for order in ORDERS], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))

    model = LanguageModel.fit(*placed(*_codes(texts)), onehot * even[:, None])
    parts = Split(texts)
    if not len(parts):
        return model
    codes, starts = parts.codes()
    slots, owner = placed(codes, starts)
    prior = np.log(0.02 + 0.9 * onehot[parts.owner])
    for _ in range(REFITS):
        ll = model.sums(slots, starts) / 2 + prior
        share = np.exp(ll - ll.max(1, keepdims=True))
        model = LanguageModel.fit(slots, owner, share / share.sum(1, keepdims=True) * even[parts.owner][:, None])
    return model


def mixture(ll: np.ndarray, subset: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for one document: (log-likelihood, proportions, responsibilities) over the languages of subset."""
    part = ll[:, subset]
    top = part.max(1, keepdims=True)
    like = np.exp(part - top)
    share = np.full(len(subset), 1 / len(subset))
    for _ in range(EM_STEPS):
        joint = like * share
        resp = joint / joint.sum(1, keepdims=True)
        share = resp.mean(0)
    mixed = np.maximum((like * share).sum(1), 1e-300)
    return float((np.log(mixed) + top[:, 0]).sum()), share, resp


def languages_of(ll: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Greedy forward selection: a language joins while it lifts the likelihood by more than the penalty."""
    subset = [int(ll.sum(0).argmax())]
    value, share, resp = mixture(ll, subset)
    while len(subset) < ll.shape[1]:
        own = ll[:, subset].max(1, keepdims=True)
        lift = np.maximum(ll - own, 0).sum(0)
        best = int(lift.argmax())
        if best in subset or lift[best] <= PENALTY:
            break
        more = mixture(ll, [*subset, best])
        if more[0] - value <= PENALTY:
            break
        subset, (value, share, resp) = [*subset, best], more
    return subset, share, resp


def named_language(lang: Column) -> Column:
    """it, en, ... from a label of any case, with blanks or a region; null where it names none of the languages."""
    code = F.lower(F.regexp_extract(F.trim(F.regexp_replace(lang, "[\\s\\u00a0]+", " ")), "^([A-Za-z]{2,3})(?:[-_ ].*)?$", 1))
    return F.when(code.isin(LANGUAGES), code)


def fit_model(documents: DataFrame) -> LanguageModel:
    """From at most TRAIN_DOCS labelled documents per language; only these reach the driver, as whole texts."""
    labelled = documents.select(F.col("doc_id").cast("long").alias("doc_id"), named_language(F.col("lang")).alias("named"), F.col("text").cast("string").alias("text")).filter(F.col("named").isNotNull() & (F.length("text") >= 40))
    counts = {r["named"]: r["n"] for r in labelled.groupBy("named").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("named") == name, F.lit(min(1.0, 1.5 * TRAIN_DOCS / n))).otherwise(share)
    drawn = labelled.withColumn("draw", F.xxhash64("doc_id", F.lit(11))).filter(F.pmod("draw", F.lit(1_000_000)) < share * 1_000_000)
    first = F.row_number().over(Window.partitionBy("named").orderBy("draw", "doc_id", "text"))  # over the few that were drawn
    rows = drawn.withColumn("nth", first).filter(F.col("nth") <= TRAIN_DOCS).orderBy("named", "nth").collect() if counts else []
    if not rows:
        raise ValueError("no labelled document to fit a language model on")
    return train([r["text"] for r in rows], [r["named"] for r in rows])


def stretches(batch: pd.DataFrame, model: LanguageModel) -> pd.DataFrame:
    """The columns of SPANS for the documents of a batch.

    A document whose sentences prefer no second language by more than the penalty needs no EM: it could not add one."""
    found = Split([t if isinstance(t, str) else "" for t in batch["text"]])
    if not len(found):
        return plain(pd.DataFrame([], columns=COLUMNS))
    ll = model.score(found)
    first = np.flatnonzero(np.r_[True, found.owner[1:] != found.owner[:-1]])
    last = np.r_[first[1:], len(found)]
    top = np.add.reduceat(ll, first, axis=0).argmax(1)
    lift = np.add.reduceat(np.maximum(ll - ll[np.arange(len(ll)), np.repeat(top, last - first)][:, None], 0), first, axis=0).max(1)
    rows = []
    ids, langs = batch["doc_id"].to_numpy(), batch["lang"].to_numpy()
    for a, b, doc, k, mixed in zip(first.tolist(), last.tolist(), found.owner[first].tolist(), top.tolist(), (lift > PENALTY).tolist(), strict=True):
        if not mixed:
            rows.append((ids[doc], langs[doc], found.start[a], found.end[b - 1], b - a, LANGUAGES[k], 1.0, 1.0))
            continue
        subset, share, resp = languages_of(ll[a:b])
        pick = resp.argmax(1)
        edges = np.r_[0, np.flatnonzero(np.diff(pick)) + 1, b - a]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            n = pick[i]
            rows.append((ids[doc], langs[doc], found.start[a + i], found.end[a + j - 1], int(j - i), LANGUAGES[subset[n]], float(resp[i:j, n].mean()), float(share[n])))
    return plain(pd.DataFrame(rows, columns=COLUMNS))


SPANS = "doc_id long, lang string, span_start int, span_end int, n_sentences int, language string, confidence double, share double"
COLUMNS = [c.split()[0] for c in SPANS.split(", ")]
#: Documents whose characters are held as arrays at a time.
DOCS_AT_ONCE = 256


def find_languages(documents: DataFrame) -> DataFrame:
    """Stretches of one language: doc_id, lang (as stored), span_start, span_end (characters), n_sentences, language,
    confidence (mean posterior of its sentences), share (of the document's sentences in that language).

    documents: doc_id, text, lang. Neighbouring sentences of one language form a stretch. Defined cases: null, empty and
    blank texts and texts without a full sentence give no row; texts are read whole at any length; repeated documents each
    give their rows; equal likelihoods go to the language named first in LANGUAGES; an empty table gives no row;
    further columns are ignored. Documents without any usable label in the whole table raise ValueError.
    """
    if not documents.select("doc_id").take(1):
        return documents.sparkSession.createDataFrame([], SPANS)
    model = fit_model(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model.tables)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LanguageModel(shared.value)
        for whole in batches:
            for at in range(0, len(whole), DOCS_AT_ONCE):
                yield stretches(whole.iloc[at : at + DOCS_AT_ONCE], model)

    wanted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return wanted.mapInPandas(judge, SPANS)


def unnamed_languages(spans: DataFrame) -> DataFrame:
    """doc_id, lang_found: each language found that the document's label does not name."""
    return spans.filter(F.coalesce(named_language(F.col("lang")), F.lit("")) != F.col("language")).select("doc_id", F.col("language").alias("lang_found")).distinct()


def document_languages(spans: DataFrame) -> DataFrame:
    """doc_id, language, confidence: the language most of the document's sentences are in; ties by name."""
    weight = spans.groupBy("doc_id", "language").agg(F.max("share").alias("share"), (F.sum(F.col("confidence") * F.col("n_sentences")) / F.sum("n_sentences")).alias("mean"))
    top = F.max_by(F.struct("language", "share", "mean"), F.struct(F.col("share"), F.col("language"))).alias("top")
    return weight.groupBy("doc_id").agg(top).select("doc_id", F.col("top.language").alias("language"), F.round(F.col("top.share") * F.col("top.mean"), 6).alias("confidence"))
