"""Dictionaries and word lists whose content decides results."""

# Relation dictionary as (name, predicate number, property id).
RELATIONS = [
    ("country", 0, "P17"),
    ("place of birth", 1, "P19"),
    ("spouse", 2, "P26"),
    ("country of citizenship", 3, "P27"),
    ("instance of", 4, "P31"),
    ("capital", 5, "P36"),
    ("child", 6, "P40"),
    ("shares border with", 7, "P47"),
    ("author", 8, "P50"),
    ("director", 9, "P57"),
    ("occupation", 10, "P106"),
    ("founded by", 11, "P112"),
    ("league", 12, "P118"),
    ("owned by", 13, "P127"),
    ("genre", 14, "P136"),
    ("named after", 15, "P138"),
    ("follows", 16, "P155"),
    ("headquarters location", 17, "P159"),
    ("cast member", 18, "P161"),
    ("manufacturer", 19, "P176"),
    ("located in or next to body of water", 20, "P206"),
    ("location", 21, "P625"),
    ("part of", 22, "P361"),
    ("mouth of the watercourse", 23, "P403"),
    ("member of", 24, "P102"),
    ("sport", 25, "P641"),
    ("characters", 26, "P674"),
    ("participant", 27, "P710"),
    ("notable work", 28, "P800"),
    ("replaces", 29, "P1365"),
    ("sibling", 30, "P3373"),
    ("inception", 31, "P571"),
]

# Entity-type codes and their long names.
ENTITY_TYPES = {
    "CEL": "CelestialBody",
    "Concept": "Concept",
    "DATE": "Date",
    "DIS": "Disease",
    "EVE": "Event",
    "LOC": "Location",
    "MEDIA": "Media",
    "MISC": "Miscellaneous",
    "NUMBER": "Number",
    "ORG": "Organization",
    "PER": "Person",
    "TIME": "Time",
    "UNK": "Unknown",
}

# Function-word prefixes of predicates, in the order they are tried (the last hit wins).
PREDICATE_PREFIXES = [
    "are ", "can be ", "at ", "author ", "became ", "become ", "becomes ", "began ", "can be ", "can ",
    "had ", "had a ", "has an ", "has a ", "has an ", "has been ", "in ", "is ", "is a ", "is an ",
    "main ", "most ", "must ", "must be ", "was ", "was a ", "was an ", "will ", "will be ",
]

# Texts shown for a knowledge-base id without label or description.
NO_LABEL = "No label available"
NO_DESCRIPTION = "No description available"

# Knowledge-base properties "instance of" and "subclass of".
INSTANCE_OF = "P31"
SUBCLASS_OF = "P279"

# Keys a list of triple objects may carry, and keys an object may hold such a list under.
TRIPLE_KEYS = ("subject", "predicate", "object")
CAPITAL_TRIPLE_KEYS = ("Subject", "Predicate", "Object")
RELATION_TRIPLE_KEYS = ("subject", "relation", "object")
LIST_KEYS = ("Triples", "triples", "knowledge_triples")
