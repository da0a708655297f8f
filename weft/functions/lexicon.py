"""Word lists and patterns that the text and relation rules are defined by."""

PART_VERBS = ("provide", "include", "comprise", "contain", "equip")
FUNCTION_VERBS = ("configure", "adapt", "operate", "enable", "allow", "cause", "generate", "lead")
FUNCTION_MARKERS = ("configured", "adapted", "operable")
SPATIAL_WORDS = ("in", "on", "between", "through", "from", "to", "into", "at", "of", "with", "upwardly", "adjacent")
CONDITION_WORDS = ("wherein", "when", "if")
CLAUSE_MARKERS = ("wherein", "thereby", "thereafter", "therefore")
CLAUSE_LABELS = ("S", "SBAR", "SINV", "SQ")
RELATION_WEIGHTS = {"part-of": 3.0, "function-of": 2.0, "property-of": 1.0, "spatial": 1.0, "condition": 1.0}
LABEL_STOP_WORDS = ("for", "of", "the", "a", "an", "said")
CONNECTORS = ("furthermore", "moreover", "in addition")
SUBJECTIVE = ("efficient", "simple")
QUANTITATIVE = {"wide": False, "full": True}
SYNONYMS = {"control unit": "<CONTROL_UNIT>", "controller": "<CONTROL_UNIT>"}
PREPOSITIONS = {"on top of": "above"}
UNITS = ("mm", "cm", "km", "kg", "ml")
#: Deleted in this order, which matters.
BOILERPLATE = (
    r"\bthe\s+present\s+invention\b",
    r"\baccording\s+to\s+(the\s+)?present\s+invention\b",
    r"\bin\s+one\s+embodiment\b",
    r"\bin\s+this\s+embodiment\b",
    r"\bin\s+an\s+embodiment\b",
    r"\bby\s+way\s+of\s+example\b",
    r"\bfor\s+example\b",
    r"\bfor\s+instance\b",
    r"\bas\s+such\b",
    r"\bin\s+particular\b",
    r"\btherefore\b",
    r"\bpreferably\b",
    r"\bmay\s+be\b",
    r"\bcan\s+be\b",
    r"\bshould\b",
    r"\bwherein\b",
    r"\bwhereby\b",
    r"\bsaid\b(?=\s+\w)",
)
