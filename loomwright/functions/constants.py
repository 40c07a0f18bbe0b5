"""Fixed values that results depend on."""

# Words that a keyword query leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "does", "do", "for", "from", "how", "in", "into", "is", "it", "its", "of", "on",
    "or", "that", "the", "this", "to", "what", "when", "where", "which", "who", "why", "with", "would", "could", "should", "will", "can",
)
# Path prefixes that recall leaves out by default.
NON_SOURCE_PREFIXES = ("tests/", "examples/", "docs/", "docs_src/", "scripts/")
# Priorities that let a prefix back in.
PRIORITY_PREFIXES = {
    "test": ["tests/"], "tests": ["tests/"], "testing": ["tests/"], "coverage": ["tests/"],
    "contributing": ["docs/", "docs_src/"], "docs": ["docs/", "docs_src/"], "documentation": ["docs/", "docs_src/"],
    "example": ["examples/"], "examples": ["examples/"], "usage": ["examples/"], "onboarding": ["docs/", "examples/"],
}
# Weights of term bands (symbol, split symbol, body).
BAND_WEIGHTS = {"A": 1.0, "B": 0.4, "D": 0.1}
# Lane weights (dense, sparse) for prose and for queries that spell an identifier; RRF constant.
PROSE_WEIGHTS, LEXICAL_WEIGHTS, RRF_K = (3.0, 1.0), (1.0, 2.0), 60
# Languages by file suffix.
SOURCE_LANGUAGES = {
    ".bash": "shell", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".cxx": "cpp", ".go": "go", ".h": "c", ".hpp": "cpp",
    ".java": "java", ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".mjs": "javascript", ".php": "php",
    ".rb": "ruby", ".rs": "rust", ".scala": "scala", ".sh": "shell", ".svelte": "svelte", ".swift": "swift", ".ts": "typescript",
    ".tsx": "typescript", ".vue": "vue", ".zsh": "shell",
}
# Folders that scans skip.
SKIP_FOLDERS = (
    ".git", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "coverage", "dist",
    "node_modules", "out", "target", "vendor", "venv",
)
# Manifest files worth reading, by whole name.
CONTEXT_FILE_NAMES = (
    "cargo.toml", "composer.json", "docker-compose.yaml", "docker-compose.yml", "dockerfile", "gemfile", "go.mod", "makefile",
    "package.json", "package.swift", "pom.xml", "pyproject.toml", "setup.cfg", "settings.gradle", "settings.gradle.kts", "tsconfig.json",
)
# Question classes by precedence, with the words that tell them.
INTENT_WORDS = (
    ("compare", ("compare", "difference", "versus", " vs ")),
    ("where_is", ("where", "located", "defined")),
    ("architectural", ("flow", "trace", "call", "through", "lifecycle")),
    ("procedural", ("how", "steps", "process")),
)
# Phrases of questions that need several hops.
MULTI_HOP_PHRASES = ("how does", "flow", "trace", "from ", "through", "interact", "between", "end to end")
# Edge types, surviving type first; order in which neighbours are shown.
EDGE_PRIORITY = ("calls", "inherits", "imports", "defines")
NEIGHBOUR_ORDER = ("defined_by", "calls", "called_by", "inherits", "inherited_by", "defines", "imports", "imported_by")
# Cut-offs of chunks, windows and prompts.
MAX_CHUNK_LINES, WINDOW_LINES, WINDOW_CHARS, WINDOW_OVERLAP = 150, 120, 6000, 10
MAX_INDEX_LOC, INDEX_VERSION, COVERAGE = 200_000, 6, 0.99
# Terms that the planner looks for.
FRAGILITY_TERMS = ("fragile", "problem", "audit", "security", "vulnerab")
HUB_BIAS_TERMS = (
    ("data_hubs", ("data", "schema", "model", "table", "storage")),
    ("decision_hubs", ("decision", "strategy", "tradeoff", "policy")),
    ("hot_path", ("latency", "throughput", "hot path", "performance", "perf")),
)
# Lane weights of the ranker by leaning, and without a plan.
RANKER_HUNT, RANKER_ISSUE, RANKER_EVEN = {"A": 0.3, "B": 0.3, "C": 0.4}, {"A": 0.6, "B": 0.3, "C": 0.1}, {"A": 0.4, "B": 0.4, "C": 0.2}
RANKER_DEFAULT = {"A": 0.34, "B": 0.33, "C": 0.33}
LANES = {"A_issue": "A", "B_quality": "B", "C_suspicion": "C", "D_feature": "D"}
# Headings of the bundles that prompts carry, and what stands for an empty one.
FACT_HEAD, FACT_HUBS, FACT_ENTRIES = "FACT BUNDLE (deterministic — do not contradict):", "HUBS:", "ENTRY POINTS:"
NO_HUBS, NO_ENTRIES = "  (none — graph has no high-fan-in symbols)", "  (none detected)"
PATH_HEAD, NO_PATHS = "TRACED PATHS (deterministic):", "  (no outgoing call edges)"
SOURCE_HEAD, NO_SOURCES = "SOURCE BUNDLE (grounded — reuse refs verbatim):", "SOURCE BUNDLE: (empty — upstream produced no grounded insights)"
# First impression of a snapshot, and what stands for missing names.
NO_HUB_NAMES, NO_ENTRY_NAMES = "no dominant hubs yet", "no clear entry points"
# Limits of flow tracing, rechecks, compression and section retries; the note of a provider that failed.
TRACE_TARGETS, TRACE_PATHS, RECHECK_REFS, COMPRESS_LINES, SECTION_RETRIES = 5, 3, 8, 15, 2
# Patterns of identifiers in a question, of repository addresses, and of phrases too certain for a suspicion.
IDENTIFIER_IN_QUESTION = (
    r"(?:[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?:[A-Za-z0-9]+_[A-Za-z0-9_]+)"
    r"|(?:\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)"
    r"|(?:\b[A-Z]{2,}[a-z][A-Za-z0-9]*)"
)
REPO_URL = r"^https?://github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"
TOO_CERTAIN = r"(?i)\b(?:bug|broken|will\s+crash|obviously\s+wrong)\b"
# The note that ends a shortened chunk; what a suspicion says.
SHORTENED = "\n… (chunk truncated for prompt size)"
SUSPICION_TITLE, SUSPICION_STEP = "Investigate structural risk around {}", "to_confirm: reproduce the behavior around {} before opening a PR."
# Labels of the block that opens every prompt.
GOAL_HEAD, PLAN_HEAD = "USER GOAL (verbatim, do not rephrase):", "PLAN TILT (set by the deterministic planner — honor it):"
GOAL_WEIGHTS, GOAL_KEYWORDS, GOAL_AUDIENCE, GOAL_SUCCESS = "  modality_weights: ", "  focus_keywords:   ", "  audience:         ", "  success looks like: "
PLAN_ACTIVE, PLAN_SHAPE, PLAN_HUBS = "  - active capabilities: ", "  - output shape:        ", "  - cartographer hub bias: "
PLAN_TARGETS, PLAN_LANE_B, NO_WEIGHTS, NO_KEYWORDS = "  - flow-tracer targets: ", "  - lane-B framing: ", "(none stated)", "(none)"
