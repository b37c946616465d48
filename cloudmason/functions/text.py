"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudmason.functions import vocabulary as V

_BLANKS = "[\\s\\u00a0]"


def _accent_table() -> tuple[str, str]:
    """Every Latin letter with accents and its base letter, from the Unicode decompositions."""
    pairs = [(chr(n), d[0]) for n in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(n))) > 1 and unicodedata.combining(d[1]) and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_table()


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANKS}+|{_BLANKS}+$", "")


def fold(c: Column) -> Column:
    """Trimmed, lower case, Latin accents dropped; combining marks that stand alone go, too."""
    return F.regexp_replace(F.translate(F.lower(strip_blanks(c)), ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def fold_line(c: Column) -> Column:
    """fold with every run of blanks as one."""
    return F.regexp_replace(fold(c), f"{_BLANKS}+", " ")


def ascii_fold(c: Column) -> Column:
    """The twelve accented Italian letters without accent, apostrophes dropped."""
    return F.translate(c, "àèéìòùÀÈÉÌÒÙ'’", "aeeiouAEEIOU")


def slug(c: Column) -> Column:
    """Alphanumeric runs, each capitalised, joined; Unspecified where there is none."""
    runs = F.regexp_extract_all(ascii_fold(c), F.lit("([A-Za-z0-9]+)"), 1)
    joined = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")
    return F.when(joined == "", "Unspecified").otherwise(joined)


def pascal(c: Column) -> Column:
    runs = F.filter(F.split(c, "[_\\W]+"), lambda r: r != "")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def header_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")


def split_values(c: Column) -> Column:
    """Parts between ; or |, trimmed, empty ones dropped; an empty array for null."""
    return F.coalesce(F.filter(F.transform(F.split(c, "[;|]"), strip_blanks), lambda p: p != ""), F.array().cast("array<string>"))


def row_text(c: Column) -> Column:
    """Null as empty text; trimmed, without quotes around."""
    return F.coalesce(F.regexp_replace(strip_blanks(c), '^"+|"+$', ""), F.lit(""))


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """table[c], or default (c itself); a literal map of fixed size."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), c if default is None else default)


def l2_label(c: Column) -> Column:
    """Class of an annotation label; unknown words stand for themselves, blank ones for null."""
    return F.nullif(lookup(fold(c), V.LABEL_WORDS), F.lit(""))


def l3_class(c: Column) -> Column:
    word = F.regexp_replace(F.regexp_replace(F.lower(strip_blanks(c)), "/", "_"), " ", "_")
    return lookup(word, V.ONTOLOGY_WORDS)


def predicate(c: Column) -> Column:
    return lookup(strip_blanks(c), V.PREDICATES)


def decimal(c: Column) -> Column:
    """A number with decimal point or comma; null where it is none."""
    return F.regexp_replace(strip_blanks(c.cast("string")), ",", ".").try_cast("double")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_blanks(c), F.lit(""))


def first_value(*columns: Column) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip_blanks(c.cast("string"))).isin(V.TRUTHY), F.lit(False))


def has_any(c: Column, words: list[str]) -> Column:
    """Any of the words occurs as a substring."""
    found = F.lit(False)
    for w in words:
        found |= c.contains(w)
    return found


def has_word(c: Column, word: str) -> Column:
    return c.rlike(f"(?U)\\b{re.escape(word)}\\b")


def mentioned_classes(c: Column) -> Column:
    """Classes named in a text by whole words, in the order of the word list; an empty array for null."""
    listed = F.array(*(F.lit(label) for label, _ in V.TEXT_WORDS))
    return F.coalesce(F.array_intersect(listed, question_classes(c)), F.array().cast("array<string>"))


def first_mentioned(c: Column) -> Column:
    """The class named first in a folded text, the longest word at a place winning; null where none is named."""
    words = sorted(((w, label) for label, ws in V.TEXT_WORDS for w in ws), key=lambda x: -len(x[0]))
    found = F.regexp_extract(c, "(?U)\\b(" + "|".join(re.escape(w) for w, _ in words) + ")\\b", 1)
    return F.when(found != "", lookup(found, {w: label for w, label in words}))


def question_classes(c: Column) -> Column:
    """All classes named in a text, left to right, longest word first, spans not overlapping, repeats kept."""
    words = sorted(((w, label) for label, ws in V.TEXT_WORDS for w in ws), key=lambda x: -len(x[0]))
    found = F.regexp_extract_all(fold(c), F.lit("(?U)\\b(" + "|".join(re.escape(w) for w, _ in words) + ")\\b"), 1)
    table = F.create_map(*(F.lit(x) for kv in words for x in kv))
    return F.transform(found, lambda w: F.element_at(table, w))


def object_names(c: Column) -> Column:
    """Distinct object ids of known classes in a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("\\b((?:" + "|".join(V.CLASSES) + ")_[0-9]+)\\b"), 1))


def response_language(c: Column) -> Column:
    """en only where more English than Italian markers occur, else it."""
    folded = fold(c)
    score = lambda words: sum((folded.contains(w).cast("int") for w in words), F.lit(0))
    return F.when(score(V.ENGLISH_MARKERS) > score(V.ITALIAN_MARKERS), "en").otherwise("it")


def first_match(c: Column, table: list[tuple[str, list[str]]], default: str | None) -> Column:
    """The first entry of the table any of whose words occurs in the text."""
    out = F.lit(default)
    for name, words in reversed(table):
        out = F.when(has_any(c, words), name).otherwise(out)
    return out


def relation_level(c: Column) -> Column:
    return first_match(c, V.LEVEL_TEXT, "all")


def relation_type(c: Column) -> Column:
    return first_match(c, V.RELATION_WORDS, None)


def position(c: Column) -> Column:
    return first_match(c, V.POSITION_WORDS, None)


def coordinate_mode(c: Column) -> Column:
    return F.when(has_any(c, V.BOX_CENTRE_WORDS), "box_center").when(has_any(c, ["centroide", "centroid"]), "centroid").otherwise("coordinates")


def layer_key(c: Column) -> Column:
    """The relationship layer a level word means; null for unknown words, all for null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in V.LEVEL_WORDS.items() for x in kv)), F.lower(strip_blanks(F.coalesce(c, F.lit("all")))))


def split_questions(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "(?<=\\?)"), strip_blanks), lambda q: q != "")


def split_sentences(c: Column) -> Column:
    return F.split(c, "[.\\n;]")


def first_integer(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).cast("long")


def strip_ordinal(c: Column) -> Column:
    """Text after a leading '12.', if anything follows."""
    return F.regexp_replace(c, "^\\s*[0-9]+\\s*\\.\\s*(?=\\S)", "")


def path_safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, by its exact binary value (Java's formatting rounds the shortest decimal form)."""

    @F.pandas_udf("string")
    def form(v: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else f"{x:.{digits}f}" for x in v], dtype=object)

    return form(c)


def grouped(c: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(c, 0)


def material_words(material: str) -> list[str]:
    """The first alias group one of whose words occurs in the query, or the query itself."""
    folded = "".join(x for x in unicodedata.normalize("NFKD", material.strip().lower()) if not unicodedata.combining(x))
    return next((g for g in V.MATERIAL_GROUPS if any(w in folded for w in g)), [folded])


# Phrases of scripted answers and their English form, replaced one after the other.
PHRASES = [
    ("Osservato dai dati:", "Observed data:"),
    ("Relazioni usate:", "Relationships used:"),
    ("Inferenza:", "Inference:"),
    ("Confidenza:", "Confidence:"),
    ("Indizi presenti:", "Observed cues:"),
    ("Relazioni considerate in cascata", "Relationships considered in cascade"),
    ("La scena sembra coperta o semi-interna, ma i limiti laterali sono incompleti.", "The scene appears covered or semi-internal, but the lateral boundaries are incomplete."),
    ("La scena è probabilmente interna o coperta.", "The scene is probably internal or covered."),
    ("La distinzione interno/esterno resta ambigua dai soli oggetti disponibili.", "The internal/external distinction remains ambiguous from the available objects alone."),
    ("Limiti principali", "Main boundaries"),
    ("Colonne perimetrali candidate", "Candidate perimeter columns"),
    ("Colonne interne / organizzatrici", "Internal / organizing columns"),
    ("Elementi distributivi", "Circulation elements"),
    ("Ruoli:", "Roles:"),
    ("Potenzialmente portanti", "Potentially load-bearing"),
    ("Superfici di appoggio", "Support surfaces"),
    ("Non portanti o non determinati", "Non-load-bearing or undetermined"),
    ("Etichetta tipologica sintetica", "Synthetic typological label"),
    ("spazio coperto colonnato / portico o padiglione", "covered colonnaded space / portico or pavilion"),
    ("sono presenti molte colonne, un piano di base e una copertura.", "many columns, a base plane, and a roof are present."),
    ("media", "medium"),
    ("alta", "high"),
    ("bassa", "low"),
    ("nessuno", "none"),
    ("nessuna", "none"),
    ("floor come piano inferiore", "floor as lower plane"),
    ("roof/vault come copertura superiore", "roof/vault as upper cover"),
    ("wall come possibile limite laterale", "wall as possible lateral boundary"),
    ("column associate a copertura", "columns associated with a cover"),
]


def to_english(c: Column) -> Column:
    for old, new in PHRASES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def choice(language: Column, it: Column, en: Column) -> Column:
    """The English wording for en, else the Italian one."""
    return F.when(language == "en", en).otherwise(it)


# Intents of questions. Every list needs one of its words as a substring of the folded question.
INTENTS: dict[str, list[list[str]]] = {
    "count": [V.COUNT_WORDS],
    "class_count": list(V.CLASS_COUNT_WORDS),
    "present_classes": [["quali classi sono presenti", "che classi sono presenti", "classi presenti", "classi ci sono", "which classes are present", "what classes are present", "present classes"]],
    "object_list": [["elencami", "elenca", "lista", "mostra", "list", "show"]],
    "object_words": [["elementi", "elemento", "oggetti", "oggetto", "objects", "object"]],
    "dominant": [["elemento dominante", "oggetto dominante", "elemento piu importante", "dominant element", "most important element", "most dominant"]],
    "attribute": [["materiale", "materiali", "material", "materials", "materica", "materico", "tipologia", "tipo", "typology", "type", "funzione", "function"]],
    "description": [["descrivi", "descrizione", "scheda", "storico", "storica", "storiche", "historical", "history", "descrittiva", "testuale", "textual", "materiale", "materiali", "material", "materials", "materica", "materico",
                     "tipologia", "tipo", "typology", "type", "funzione", "function", "metadata", "metadati", "annotazione", "annotation", "csv"]],
    "spatial_selector": [["centrale", "centro", "central", "middle", "sinistra", "left", "ovest", "west", "destra", "right", "est", "east", "sud", "south", "davanti", "front", "nord", "north", "dietro", "back",
                          "bassa", "basso", "inferiore", "lower", "bottom", "alta", "alto", "superiore", "upper", "top"]],
    "opening_in_wall": [["apertura", "aperture", "opening", "openings"], ["wall", "muro", "muri", "parete", "pareti"]],
    "part_of": [["apertur", "opening", "openings", "ornament", "decor", "parte", "part of", "has_part", "is_opening_in", "is_ornament_of", "appartien", "apparten"]],
    "load_bearing": [["load-bearing", "load bearing", "portanti", "portante", "strutturali", "strutturale"],
                     ["which elements", "what elements", "which objects", "what objects", "quali elementi", "quali oggetti", "elementi sembrano", "oggetti sembrano"]],
    "role": [["strutturale", "strutturali", "structural", "portante", "portanti", "load-bearing", "load bearing", "non portante", "non portanti", "non strutturale", "non strutturali", "non-structural", "non structural",
              "ornamentale", "ornamentali", "ornamental", "decorativo", "decorativi", "opening", "apertura", "aperture", "circolazione", "distributiva", "passaggio", "accesso", "ruolo", "role", "funzione", "function"]],
    "relation_words": [["relazione", "relazioni", "relationship", "relationships"]],
    "class_words": [["classe", "classi", "altre classi", "semantic", "semantich", "con le altre", "con gli altri", "con altri"]],
    "relationships": [["relazione", "relazioni", "relationship", "relationships"],
                      ["quali", "che", "presenti", "presente", "tipi", "tipo", "conteggio", "distribuzione", "tutte", "tutti", "lista", "elenco", "fornisc", "elenca", "l1", "l2", "l3", "geometric", "structural", "mereolog",
                       "near", "adjacent_to", "adiac", "above", "below", "sopra", "sotto", "supports", "rests_on"]],
    "relationship_list": [["tutte", "tutti", "lista", "elenco", "elenca", "mostra", "dettaglio", "dettagli", "prime", "all relationships", "list", "show", "details"]],
    "inconsistencies": [["incongruen", "contraddizion", "contraddittor", "inconsistent", "inconsistency", "inconsistencies", "contradiction", "contradictory", "anomaly", "anomalies", "invalid",
                         "ambiguous relationship", "ambiguous relationships", "relazioni ambigue", "relazione ambigua"]],
    "above_below": [["above", "below", "sopra", "sotto"], ["which elements", "what elements", "which objects", "what objects", "other elements", "altri elementi", "quali elementi", "quali oggetti"]],
    "scene_brief": [["describe", "descrivi", "description", "descrizione"], ["scene", "scena"], ["brief", "briefly", "sintet", "short"]],
    "subject_supports": [["cosa supportano", "che cosa supportano", "cosa sostengono", "che cosa sostengono", "cosa sorreggono", "che cosa sorreggono", "what do", "what does", "which elements do", "which elements does"]],
    "supports_subject": [["da cosa", "da che cosa", "chi support", "what supports", "what is supporting", "which elements support", "cosa supporta", "cosa sostiene", "cosa sorregge"]],
    "support": [["support", "supports", "supported", "supporting", "supporta", "supportano", "supportato", "supportata", "supportati", "supportate", "sostiene", "sostengono", "sostenuto", "sostenuta", "sostenuti", "sostenute",
                 "sorregge", "sorreggono", "sorretto", "sorretta", "sorretti", "sorrette", "regge", "reggono", "hold up", "holds up", "held up"]],
    "passive_support": [["supportato da", "supportata da", "supportati da", "supportate da", "sostenuto da", "sostenuta da", "sostenuti da", "sostenute da", "sorretto da", "sorretta da", "sorretti da", "sorrette da", "supported by", "held up by"]],
    "area": [["area", "superficie occupata", "impronta", "footprint", "occupied area"]],
    "volume": [["volume"]],
    "coordinates": [["coordinate", "coordinates", "globali", "global coordinates", "centroide", "centroid", "global box center", "box center", "bbox center", "bounding box center", "centro box", "centro bounding", "centro aabb", "aabb center"]],
    "material": [["materiale", "materiali", "materico", "materica", "material", "materials", "stone", "pietra", "marmo", "calcare", "brick", "bricks", "laterizio", "mattoni", "intonaco", "plaster", "stucco", "wood", "legno",
                  "metal", "metallo", "glass", "vetro", "terracotta", "tile"]],
    "inventory": [["quanti oggetti", "quanti elementi", "che tipi", "classi", "classe", "inventario", "assenti", "strutturali", "decorativi", "finishing"]],
    "top_object": [["maggior numero di punti", "piu punti", "volume maggiore", "maggior volume", "piu volume", "piu compatto", "geometricamente compatto"]],
    "distance": [["distanza", "dista", "distano", "vicino", "vicini", "nearest", "closest"]],
    "nearest": [["vicino", "vicini", "nearest", "closest"]],
    "scene_words": [["scena", "scene"]],
    "material_names": [["marmo", "marble", "calcare", "limestone", "pietra", "stone", "laterizio", "brick", "mattoni", "intonaco", "plaster", "stucco", "legno", "wood", "metallo", "metal", "vetro", "glass", "terracotta", "cotto", "tile"]],
    "l2_as_graph": [["l2"], ["graph", "grafo", "relationship", "relationships", "relazione", "relazioni", "structural", "struttural"]],
    "l3_as_part_of": [["l3"], ["mereolog", "has_part", "part_of", "is_opening_in", "is_ornament_of"]],
    "l1_as_structural": [["l1"], ["structural", "strutturale", "strutturali"]],
    "scope_correction": [["non tutta la scena", "non la scena", "solo questa classe", "solo la classe", "solo queste", "solo questi", "not the whole scene", "not whole scene", "only this class"]],
    "role_follow_up": [["sono struttural", "sono portant", "sono ornamental", "sono aperture", "sono non portant", "are structural", "are load-bearing", "are ornamental", "are openings"]],
    "whole_scene": [["relazione", "relazioni", "relationship", "relationships", "above", "below", "l1", "l2", "l3", "quali elementi", "quali oggetti", "which elements", "what elements", "which objects", "what objects",
                     "all elements", "all objects", "scena", "scene"]],
    "box": [["bounding box", "boundingn box"]],
    "cloud": [["pointcloud", "point cloud", "nuvola"], ["punti", "points", "bounding"]],
    "prompt_4": [["interna", "interno", "inside", "internal"], ["esterna", "esterno", "mista", "mixed", "outside", "external"]],
    "prompt_5": [["confini", "confine", "boundar", "limiti", "limite"]],
    "prompt_6": [["delimit", "contain", "organize", "organise", "conten", "organizz"], ["spazio", "space", "scena", "scene", "elementi", "elements", "oggetti", "objects"]],
    "prompt_7": [["adiacent", "adjacent"]],
    "prompt_8": [["sopra", "sotto", "above", "below"]],
    "prompt_9": [["intersec", "sovrapp", "overlap", "intersect"]],
    "prompt_10": [["support", "sosteng", "sostiene", "sosten", "sorregg"], ["quali elementi", "quali oggetti", "elementi sembrano", "oggetti sembrano"]],
    "prompt_11": [["sistema costruttivo", "sistemi costruttivi"]],
    "prompt_12": [["portanti", "portante", "non portanti", "non portante", "load-bearing"]],
    "prompt_13": [["funzione strutturale", "funzioni strutturali"]],
    "prompt_14": [["distributiv", "passaggio", "accesso", "circolazione"]],
    "prompt_15": [["gerarchia", "principali", "secondari"]],
    "prompt_16": [["relazioni spaziali", "spatial relationships"]],
    "prompt_17": [["ambigui", "ambigu", "difficili da interpretare"]],
    "prompt_20": [["tipologia", "tipologica", "etichetta tipologica"]],
}

# The twenty questions of the evaluation, in order.
PROMPTS = [
    "Descrivi la scena in modo sintetico, indicando gli elementi principali che riconosci.",
    "Qual e l'elemento piu importante o dominante nella scena?",
    "Quali oggetti o elementi architettonici riesci a identificare con maggiore sicurezza?",
    "La scena rappresenta uno spazio interno, esterno o misto?",
    "Quali sono i confini principali dello spazio rappresentato?",
    "Quali elementi sembrano delimitare, contenere o organizzare la scena?",
    "Quali elementi risultano adiacenti tra loro?",
    "Quali elementi sembrano essere sopra o sotto altri elementi?",
    "Ci sono elementi che si intersecano o si sovrappongono?",
    "Quali elementi sembrano supportare o sostenere altri elementi?",
    "Quali oggetti sembrano appartenere allo stesso sistema costruttivo?",
    "Riesci a distinguere tra elementi portanti ed elementi non portanti?",
    "Quali elementi sembrano avere una funzione strutturale?",
    "Quali elementi sembrano avere una funzione distributiva, di passaggio o di accesso?",
    "La scena mostra una gerarchia chiara tra elementi principali e secondari?",
    "Quali relazioni spaziali sono piu evidenti nella scena?",
    "Ci sono elementi ambigui o difficili da interpretare? Quali e perche?",
    "La risposta del modello distingue tra cio che vede e cio che inferisce?",
    "Il modello sta descrivendo correttamente le relazioni tra oggetti o sta facendo ipotesi troppo generiche?",
    "Se dovessi sintetizzare la scena con una sola etichetta tipologica, quale useresti e con quale livello di confidenza?",
]


def intent(c: Column, name: str) -> Column:
    found = F.lit(True)
    for words in INTENTS[name]:
        found &= has_any(c, words)
    return found
