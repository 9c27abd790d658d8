"""Fixed values.

Everything in this module is data that has to equal the published behaviour of
the service being replaced, because results and ids depend on it: word lists,
the concept table, thresholds, weights and id labels.  No logic lives here.
"""

# --- fixed values: id labels and strategy names -----------------------------
ID_SEPARATOR = "\u001f"
SOURCE_EXPORT = "chatgpt"
SOURCE_MESSAGES = "mcp"
CHUNK_STRATEGY = "chat-turn-v2"
RANKING_STRATEGY = "normalized-weighted-v6"
EMBEDDING_DIMENSIONS = 1024
UNTITLED = "Untitled conversation"
DEFAULT_NAMESPACE = "personal"

# --- fixed values: chunk bounds ----------------------------------------------
HARD_TOKENS = 1800
GROUP_UNIT_MAX_TOKENS = 64
GROUP_MAX_TOKENS = 320
GROUP_MAX_UNITS = 6

# --- fixed values: source and maintenance bounds -----------------------------
MAX_ITEM_BYTES = 32 * 1024 * 1024
MAX_ATTEMPTS = 8
SCOPE_DELETE_LIMIT = 500

# --- fixed values: recent-but-not-indexed channel -----------------------------
RECENT_MAX_REVISIONS = 8
RECENT_MAX_AGE_SECONDS = 86_400
RECENT_MAX_MESSAGES = 200
RECENT_BOUNDS = {"max_revisions": (1, 50), "max_age_seconds": (60, 31 * 86_400), "max_messages": (1, 2000)}

# --- fixed values: full text --------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6

# --- fixed values: search page ------------------------------------------------
SEMANTIC_TOP_K = 50
POOL_MIN = 20
POOL_MAX = 200
LIMIT_MAX = 20
PER_CONVERSATION_MAX_RESULTS = 5
SCORE_FLOOR = 0.25
SNIPPET_MAX = 500

# --- fixed values: ranking ------------------------------------------------------
RRF_K = 60
QUERY_TOKEN_LIMIT = 12
SEMANTIC_MIN_SCORE = 0.3
SEMANTIC_SPAN = 0.65
SEMANTIC_HEADROOM_MIN_SCORE = 0.5
HEADING_EXACT_BOOST = 0.6
HEADING_PHRASE_BOOST = {2: 0.35, 3: 0.5, 4: 0.6}
HEADING_COVERAGE_RATE = 0.4
HEADING_MAX_PARTIAL = 0.9
STRUCTURED_LABEL_HEADING_BOOST = 0.3
STRUCTURED_LABEL_BODY_BOOST = 0.1
STRUCTURED_LABEL_MAX = 0.6
SPECIFICITY_RATE = 0.5
COOCCURRENCE_PER_CONCEPT = 0.05
COOCCURRENCE_MAX = 0.25
EXACT_QUERY_BOOST = 1.0
EXACT_PHRASE_BOOST = {3: 0.8, 2: 0.65}
EXACT_IDENTIFIER_BOOST = 0.4
ENTITY_BOOST = 0.35
TOKEN_OVERLAP_RATE = 0.45
ALIAS_OVERLAP_RATE = 0.15
FIELD_BOOST = 0.15
RECENCY_RATE = 0.1
RECENCY_DAYS = 365.0
TAG_RATE = 0.1
TAG_MAX = 0.25
AGREEMENT_RATE = 0.05
AGREEMENT_MAX = 0.1
ENTITY_EVIDENCE_RATE = 0.05
ENTITY_EVIDENCE_MAX = 0.25
RECENT_OVERLAP_RATE = 0.55
RECENT_ALIAS_RATE = 0.30
RECENT_PHRASE_RATE = 0.15

# --- fixed values: labels that count as structure when followed by a number --
STRUCTURED_LABEL_KINDS = ["event", "phase", "chapter", "scene", "act", "level", "mission"]

# --- fixed values: query stop words (English, then Indonesian) ----------------
STOP_WORDS = """
a an and are at be for from how in is of on or the to what when where which who why with
about above after am as before behind below between by can could did do does doing done during
had has have having he her hers him his me might mine must my our ours shall she should that
their theirs them these they this those us was we were will would you your yours
adalah akan atau dan dari dengan di dia ia ini itu juga kalian kami kamu karena ke ketika kita
mereka pada saat saya sebagai sejak setelah sudah untuk yang
""".split()

# --- fixed values: query-side concepts: (name, phrases, label) -----------------
CONCEPTS = [
    (
        "phone-background",
        [
            "wallpaper",
            "lock screen",
            "phone background",
            "screen background",
            "background hp",
            "latar layar",
            "background layar",
            "layar kunci",
        ],
        "wallpaper lock screen phone background",
    ),
    (
        "picture",
        ["picture", "photo", "image", "photograph", "foto", "gambar"],
        "picture photo image",
    ),
    (
        "relationship",
        [
            "started dating",
            "became a couple",
            "become a couple",
            "became official",
            "newly official",
            "official relationship",
            "jadian",
            "mulai pacaran",
            "resmi pacaran",
            "pacaran",
        ],
        "couple started dating official relationship",
    ),
    (
        "responsibility",
        ["pic", "person in charge", "responsible", "responsibility", "owner", "operator"],
        "person in charge responsible",
    ),
    (
        "packet-loss",
        ["packet loss", "lost packet", "dropped packet", "packet drop"],
        "packet loss dropped packets",
    ),
    (
        "network-outage",
        [
            "wan outage",
            "internet failure",
            "internet outage",
            "connection outage",
            "network failure",
            "network outage",
        ],
        "network outage internet failure",
    ),
    (
        "redundancy",
        ["backup", "secondary", "fallback", "standby"],
        "backup redundancy fallback",
    ),
    (
        "maintenance-window",
        ["maintenance window", "maintenance schedule", "service window", "service schedule"],
        "maintenance window",
    ),
    (
        "network-edge",
        ["gateway", "edge gateway", "router", "device", "appliance"],
        "network gateway router device",
    ),
    (
        "connection",
        ["link", "connection", "connectivity"],
        "network link connection",
    ),
]
MAX_ANCHOR_TOKENS = 24
MAX_VARIANTS = 2

# --- fixed values: index states -------------------------------------------------
PENDING_STATES = ["queued", "processing", "failed"]
INDEX_STATES = PENDING_STATES + ["indexed"]
IMPORT_DUPLICATE_STATES = ["uploaded", "processing", "complete"]
PARSER_ERROR = "PERMANENT_PARSER"
