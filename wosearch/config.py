"""Parameters and fixed values of the engine."""

# Vectors
EMBEDDING_DIM = 768
ENCODE_BATCH = 128
# Tokens whose slots a task remembers.
KNOWN_TOKENS = 1 << 16
# Instruction prefixes of query texts.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
CONTEXT_QUERY_PREFIX = "work order description: "

# Sources: longest file list that is sent to every executor.
BROADCAST_FILES = 100_000

# Cleaning
CHUNK_ROWS = 10_000
MIN_DESCRIPTION = 20
READY_DESCRIPTION = 30
PLACEHOLDER_BUCKETS = 20

# Retrieval
TOP_K = 10
POOL_FACTOR = 20
STRATEGIES = ("A", "B", "B_prime", "C")

# Evaluation
EVAL_QUERIES = 500
EVAL_KS = (1, 5, 10)
EVAL_SEED = 42
CONSTRAINED_FRACTION = 0.60
MIN_GROUP_ROWS = 5
MIN_RELEVANT = 2
MIN_QUERY_CHARS = 10

# Search execution. A block of queries travels to every task, so it is bounded; more
# queries than this come as several blocks.
PROBE_BLOCK_ROWS = 4096
PROBE_BLOCK_BYTES = 64 << 20
SCORE_CELLS = 4_000_000
# Rows whose double-precision copies a task holds at once.
SCORE_ROWS = 2048

# Global numbering: rows per bucket (see operators/numbering.py).
NUMBERING_BUCKET = 1 << 20

# Vocabulary of the rule-based router.
EQUIPMENT_TERMS = (
    "conveying", "electrical", "elevator", "equipment", "exterior", "fire protection",
    "furnishings", "hvac", "interior construction", "interior finishes", "plumbing",
    "roofing", "site", "specialties", "structural", "telecommunications",
)
TYPE_TERMS = (
    "mixed teaching research", "other", "research", "student experience", "teaching",
)

# Strings a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
