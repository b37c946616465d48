"""Classes, roles, aliases, word lists and limits of scene analysis. Small, shipped as literals."""

from __future__ import annotations

# Class codes, and the two groupings of the ten classes.
CLASSES = ["arch", "column", "moldings", "floor", "door_window", "wall", "stairs", "vault", "roof", "other"]
STRUCTURAL = ["arch", "column", "wall", "vault", "roof"]
# Architectural role by class, and what a class can support, rest on and be part of.
ROLES = {"arch": "structural", "column": "structural", "wall": "structural", "vault": "structural", "roof": "structural", "floor": "support_surface", "stairs": "circulation", "moldings": "ornamental", "door_window": "opening", "other": "unknown"}
CAN_SUPPORT = {"arch": ["vault", "roof"], "column": ["arch", "vault", "roof"], "wall": ["arch", "vault", "roof"], "vault": ["roof"], "roof": [], "floor": ["column", "wall", "stairs"], "stairs": [], "moldings": [], "door_window": [], "other": []}
CAN_REST_ON = {"arch": ["column", "wall"], "column": ["floor"], "wall": ["floor"], "vault": ["arch", "column", "wall"], "roof": ["arch", "column", "wall", "vault"], "floor": [], "stairs": ["floor"], "moldings": [], "door_window": [], "other": []}
PART_OF = {"arch": ["wall", "vault"], "stairs": ["floor", "wall"], "moldings": ["wall", "arch", "column"], "door_window": ["wall"], "other": ["wall", "floor", "column", "arch"]}
# Label words of annotation files and their class.
LABEL_WORDS = {
    "arch": "arch",
    "arco": "arch",
    "archi": "arch",
    "column": "column",
    "columns": "column",
    "colonna": "column",
    "colonne": "column",
    "door_window": "door_window",
    "door": "door_window",
    "doors": "door_window",
    "window": "door_window",
    "windows": "door_window",
    "apertura": "door_window",
    "aperture": "door_window",
    "floor": "floor",
    "floors": "floor",
    "pavimento": "floor",
    "pavimenti": "floor",
    "molding": "moldings",
    "moldings": "moldings",
    "modanatura": "moldings",
    "modanature": "moldings",
    "roof": "roof",
    "roofs": "roof",
    "tetto": "roof",
    "tetti": "roof",
    "stairs": "stairs",
    "stair": "stairs",
    "scala": "stairs",
    "scale": "stairs",
    "vault": "vault",
    "vaults": "vault",
    "volta": "vault",
    "volte": "vault",
    "wall": "wall",
    "walls": "wall",
    "muro": "wall",
    "muri": "wall",
    "parete": "wall",
    "pareti": "wall",
    "other": "other",
    "altro": "other",
}
# Words that name a class in running text, in the order in which they are tried.
TEXT_WORDS = [
    ("door_window", ["porta finestra", "porta-finestra", "porte finestre", "porte-finestre", "openings", "opening", "aperture", "apertura", "porte", "porta", "finestre", "finestra", "doors", "door", "windows", "window"]),
    ("arch", ["archi", "arco", "arches", "arch"]),
    ("column", ["colonne", "colonna", "columns", "column"]),
    ("wall", ["muri", "muro", "pareti", "parete", "walls", "wall"]),
    ("floor", ["pavimenti", "pavimento", "floors", "floor"]),
    ("roof", ["tetti", "tetto", "coperture", "copertura", "roofs", "roof"]),
    ("vault", ["volte", "volta", "vaults", "vault"]),
    ("stairs", ["scale", "scala", "stairs", "stair"]),
    ("moldings", ["modanatur", "modanature", "modanatura", "moldings", "molding"]),
    ("other", ["altro", "other"]),
]
SUPPORT_STEMS = ["support", "sostegn", "sosten", "sorregg", "regge", "portante", "load-bearing", "load bearing"]
MATERIAL_GROUPS = [["marmo", "marble"], ["calcare", "limestone"], ["pietra", "stone"], ["laterizio", "brick", "mattoni", "brick masonry"], ["intonaco", "plaster"], ["stucco"], ["legno", "wood"], ["metallo", "metal"], ["vetro", "glass"], ["terracotta", "cotto", "tile"]]
POSITION_WORDS = [
    ("central", ["central", "center", "centro", "centrale", "middle"]), ("left", ["left", "sinistra", "west", "ovest"]), ("right", ["right", "destra", "east", "est"]),
    ("south", ["south", "sud", "front", "davanti"]), ("north", ["north", "nord", "back", "dietro"]), ("bottom", ["bottom", "lower", "basso", "bassa", "inferiore"]), ("top", ["top", "upper", "alto", "alta", "superiore"]),
]
LEVEL_WORDS = {"all": "all", "l1": "L1", "geometric": "L1", "geometry": "L1", "l2": "L2_DETAIL", "csv": "L2_DETAIL", "metadata": "L2_DETAIL", "detail": "L2_DETAIL", "details": "L2_DETAIL",
               "structural": "structural_evidence", "structure": "structural_evidence", "structural_evidence": "structural_evidence", "support_evidence": "structural_evidence",
               "l3": "L3_KG_DETAIL", "cidoc": "L3_KG_DETAIL", "kg": "L3_KG_DETAIL", "knowledge_graph": "L3_KG_DETAIL", "mereological": "L3_KG_DETAIL", "composition": "L3_KG_DETAIL"}
RELATION_WORDS = [
    ("adjacent_to", ["adjacent_to", "adiacente", "adiacenti", "adiacenza", "adjacent"]), ("above", ["above", "sopra"]), ("below", ["below", "sotto"]), ("near", ["near", "vicino", "vicini", "prossim"]),
    ("supports", ["supports", "supporta", "supportano", "sostiene", "sostengono", "sorregge", "sorreggono"]), ("rests_on", ["rests_on", "appoggia", "appoggiato", "appoggiati", "rests on"]),
    ("is_opening_in", ["is_opening_in", "apertura"]), ("is_ornament_of", ["is_ornament_of", "ornament"]), ("is_rib_of", ["is_rib_of", "rib"]), ("is_placed_on", ["is_placed_on", "placed_on"]),
    ("is_connected_to", ["is_connected_to", "connected"]), ("part_of", ["part_of", "parte"]),
]
LEVEL_TEXT = [("L1", ["relazioni spaziali", "relazione spaziale", "spatial relationships", "spatial relations"]), ("L1", ["l1", "geometric", "geometrich"]), ("L2_DETAIL", ["l2"]), ("structural_evidence", ["structural", "struttural"]), ("L3", ["l3", "mereolog"])]
BOX_CENTRE_WORDS = ["global box center", "box center", "bbox center", "bounding box center", "centro box", "centro bounding", "centro aabb", "aabb center"]
ENGLISH_MARKERS = ["how many", "what", "which", "does", "do ", "is ", "are ", "support", "supported", "relationship", "relationships", "inside", "outside", "mixed", "load-bearing", "typology", "material", "materials"]
ITALIAN_MARKERS = ["quante", "quanti", "quali", "cosa", "che ", "scena", "relazioni", "supporta", "sostiene", "sorregge", "intern", "estern", "mista", "portant", "tipologia", "material", "materic"]
ABSENCE_MARKERS = ["assent", "absent", "non presente", "non sono presenti", "not present", "mancano", "manca", "nessun", "none"]
INVALID_RELATIONS = ["contains", "inside"]
COUNT_WORDS = ["quante", "quanti", "numero di", "conteggio", "count", "how many", "ci sono", "sono presenti", "presente", "esistono", "are there", "is there"]
CLASS_COUNT_WORDS = (["quante", "quanti", "numero di", "conteggio", "how many"], ["classi", "classe", "semantic classes", "semantic class"])
OBJECT_WORDS = ["oggetti", "objects", "elementi", "elements"]
TRUTHY = ["1", "true", "yes", "y", "si", "s"]
# Spellings of the predicates of the cultural heritage ontology.
PREDICATES = {
    "P46": "crm:P46_is_composed_of",
    "P46_is_composed_of": "crm:P46_is_composed_of",
    "crm:P46": "crm:P46_is_composed_of",
    "P46i": "crm:P46i_forms_part_of",
    "P46i_forms_part_of": "crm:P46i_forms_part_of",
    "crm:P46i": "crm:P46i_forms_part_of",
    "P56": "crm:P56_bears_feature",
    "P56_bears_feature": "crm:P56_bears_feature",
    "crm:P56": "crm:P56_bears_feature",
    "P56i": "crm:P56i_is_found_on",
    "P56i_is_found_on": "crm:P56i_is_found_on",
    "crm:P56i": "crm:P56i_is_found_on",
}
# Class words of ontology input rows and their class.
ONTOLOGY_WORDS = {
    "door": "door_window",
    "porta": "door_window",
    "finestra": "door_window",
    "window": "door_window",
    "window_door": "door_window",
    "doorwindow": "door_window",
    "porta_finestra": "door_window",
    "portafinestra": "door_window",
    "moulding": "molding",
    "moldings": "molding",
    "modanatura": "molding",
    "modanature": "molding",
    "arches": "arch",
    "arco": "arch",
    "archi": "arch",
    "arc": "arch",
    "arcade_arch": "arch",
    "architravi": "architrave",
    "architraves": "architrave",
    "ribs": "rib",
    "costolone": "rib",
    "costoloni": "rib",
    "ramps": "ramp",
    "rampa": "ramp",
    "rampe": "ramp",
    "steps": "step",
    "gradino": "step",
    "gradini": "step",
    "tetto": "roof",
    "roofing": "roof",
    "colonnato": "colonnade",
    "porticato": "portico",
    "arcade": "portico",
    "loggiato": "loggia",
    "pillars": "pillar",
    "pilastro": "pillar",
    "pilastri": "pillar",
}
# Node prefix, display label, ontology class and local class by ontology class word.
E22, E26, E55, E57, E16, E54 = "crm:E22_Human-Made_Object", "crm:E26_Physical_Feature", "crm:E55_Type", "crm:E57_Material", "crm:E16_Measurement", "crm:E54_Dimension"
REGISTRY = {
    "column": ("Colonna", "Colonna", E22, "Column"), "colonnade": ("Colonnato", "Colonnato", E22, "Colonnade"), "portico": ("Portico", "Portico/Porticato", E22, "Portico"), "loggia": ("Loggia", "Loggia/Loggiato", E22, "Loggia"),
    "wall": ("Muro", "Muro", E22, "Wall"), "vault": ("Volta", "Volta", E22, "Vault"), "roof": ("Roof", "Roof", E22, "Roof"), "floor": ("Pavimento", "Pavimento", E22, "Floor"), "stair": ("Scala", "Scala", E22, "Stair"),
    "door_window": ("PortaFinestra", "Porta/Finestra", E22, "DoorWindow"), "molding": ("Modanatura", "Modanatura", E26, "Molding"), "arch": ("Arco", "Arco", E22, "Arch"), "architrave": ("Architrave", "Architrave", E22, "Architrave"),
    "pillar": ("Pilastro", "Pilastro", E22, "Pillar"), "rib": ("Costolone", "Costolone", E22, "Rib"), "ramp": ("Rampa", "Rampa", E22, "Ramp"), "step": ("Gradino", "Gradino", E22, "Step"),
}
FEATURE_CLASSES = ["molding", "moulding", "cornice", "decoration", "decorative_feature"]
COVER_CLASSES, COVER_WORDS = ["Roof", "Vault", "Floor"], ["cover", "copertura", "solaio", "terrazza", "tetto", "orizzontamento"]
P2, P45, P103 = "crm:P2_has_type", "crm:P45_consists_of", "crm:P103_was_intended_for"
P46, P46I, P56, P56I = "crm:P46_is_composed_of", "crm:P46i_forms_part_of", "crm:P56_bears_feature", "crm:P56i_is_found_on"
P39, P43, P90 = "crm:P39_measured", "crm:P43_has_dimension", "crm:P90_has_value"
SPATIAL_SUPPORT = ["near", "adjacent", "touches", "intersects", "contains", "within", "overlaps"]
PORTICO_FIELDS = ["continuous_cover_above", "covered_walkable_space_behind", "ground_floor", "open_to_external_space", "opposite_side_against_building_or_walls"]
LOGGIA_FIELDS = ["covered_room_or_gallery", "fully_open_side_to_external_space", "arches_on_columns_or_pillars", "inside_building_volume", "intermediate_representative_function"]
SUPPORT_FUNCTION_STEMS = ["support", "sostegno", "struttur"]
# Thresholds.
NEAR_M, AUTO_SCALE, AUTO_FLOOR = 3.0, 2.5, 0.5
ABOVE_LOW, ABOVE_HIGH, ABOVE_OVERLAP, ADJACENT_SHARE, ADJACENT_MOST = -0.15, 0.75, 0.05, 0.25, 0.75
EPS_M, MIN_SAMPLES, VOXEL_M, ANNOTATION_M = 0.5, 15, 0.05, 2.0
SPACING_TOLERANCE, MIN_COLONNADE = 0.35, 4
