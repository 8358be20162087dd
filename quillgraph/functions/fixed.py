"""Word lists, tables, patterns and constants that right results depend on."""

# Fixed values of the keyword index: words that it leaves out, its token pattern, and BM25's constants.
# Single letters are left out by the pattern, not by the list.
STOPWORDS = (
    "about after again against also and are because been before being between both can "
    "does for from had has have how into its more not of off on only or other over same "
    "should such than that the their then there these they this those through to under "
    "uses was were what when where which while who why with within would you your"
).split()
TOKEN = r"[a-zA-Z][a-zA-Z0-9_\-]{1,}"
K1, B = 1.5, 0.75

# Fixed value: the pattern of capitalised names in a question.
NAME = r"\b[A-Z][A-Za-z0-9_\-]{1,}\b"

# Fixed value: legal forms that a resolution signature leaves out, as words with an optional full stop.
LEGAL_FORMS = "incorporated|inc|corp|corporation|co|company|ltd|limited|llc|plc"

# Fixed value: the similarity from which a name joins another.
SAME_ENTITY = 0.92

# Entity types and their colours.
COLOURS = {
    "PERSON": "#F39C12",
    "ORG": "#1ABC9C",
    "GPE": "#E74C3C",
    "LOC": "#E74C3C",
    "PRODUCT": "#E67E22",
    "EVENT": "#D35400",
    "WORK_OF_ART": "#8E44AD",
    "LAW": "#3498DB",
    "LANGUAGE": "#2ECC71",
    "NORP": "#9B59B6",
    "FAC": "#16A085",
}
DEFAULT_TYPE, DEFAULT_COLOUR = "DEFAULT", "#95A5A6"

# Parts of speech and dependency labels that make a triplet.
ROOT_POS = ("VERB", "AUX")
SUBJECTS = ("nsubj", "nsubjpass", "csubj")
OBJECTS = ("dobj", "pobj", "attr", "oprd", "dative")
MODIFIERS = ("compound", "amod", "nummod")

# Names of edges' predicates and kinds.
CO_OCCURS, CO_TYPE, FACT_TYPE = "co_occurs_with", "cooccurrence", "extracted_triplet"

# The channels' weights, PageRank's damping, and up to how many nodes betweenness is exact, from how many pivots above.
WEIGHTS = {"vector": 0.50, "keyword": 0.25, "graph": 0.25}
DAMPING = 0.85
EXACT_NODES, PIVOTS = 500, 100
