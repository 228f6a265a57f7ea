"""Fixed values that define results: tables, word lists, patterns and constants, as plain text."""

# Trust by source type, bonus by author role, half-life of recency in days.
BASE_TIER = {
    "docs": 0.95, "github_release": 0.85, "blog": 0.62, "github_pr": 0.60, "so_answer": 0.48, "github_issue": 0.48,
    "github_comment": 0.48, "hn_story": 0.40, "so_question": 0.35, "reddit_post": 0.35,
}
DEFAULT_TIER = 0.40
ROLE_BONUS = {"maintainer": 0.20, "contributor": 0.05, "none": 0.0}
HALFLIFE_DAYS = {
    "docs": 3650.0, "github_release": 1460.0, "github_issue": 1825.0, "github_pr": 1825.0, "github_comment": 1825.0,
    "so_answer": 1460.0, "so_question": 1460.0, "blog": 1095.0, "hn_story": 730.0, "reddit_post": 730.0,
}
DEFAULT_HALFLIFE = 1460.0
DECAY_FLOOR, NO_DATE, ACCEPTED_BONUS = 0.40, 0.85, 0.10

# Ranking.
RRF_K, K_EACH, OVERSAMPLE, SIMHASH_BITS = 60, 30, 10, 14
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
FIELD_WEIGHTS = {"title": 10.0, "heading": 8.0, "body": 1.0}
SIGNAL_WEIGHTS = {"cited": 1.0, "helpful": 1.0, "fetched": 0.3, "unhelpful": -1.0}
ROUTE_WEIGHTS = {"exact": (0.9, 1.6), "semantic": (1.3, 0.8), "balanced": (1.0, 1.0)}
SEMANTIC_WORDS, PARAGRAPH_WORDS = 10, 30
MATCH_BOOST, OUTDATED_PENALTY = 1.25, 0.75
BOOSTS = {
    "troubleshooting": {"github_issue": 1.4, "github_comment": 1.25, "so_question": 1.3, "so_answer": 1.3},
    "comparison": {"hn_story": 1.2, "blog": 1.2, "reddit_post": 1.15},
    "how-to": {"docs": 1.3, "so_answer": 1.2},
    "definition": {"docs": 1.4, "blog": 1.2},
    "why": {"blog": 1.2, "docs": 1.2, "hn_story": 1.1},
}

# Evidence.
CONFIDENCE_SMOOTH, EXPLAIN_WEIGHT, DISPUTE_MASS = 0.5, 0.3, 0.4
SUPERSEDE_COSINE = 0.80
SUBJECT_SIM, NEGATION_OVERLAP, ANTONYM_OVERLAP = 0.45, 0.34, 0.12

# Query intent, in the order in which the rules are tried.
TROUBLE = (
    r"\bnot\b|\bkeeps?\s+(getting|failing|dying|crashing)\b|\bexhausted\b|\boverflow\b|\brun\s+out\b|\bcrash|\bfail|"
    r"\bbroken\b|\bstuck\b|\bleak|\berror\b|\bproblems?\b|\btimeout\b|\bhanging\b"
)
COMPARISON = (
    r"\bvs\.?\b|\bversus\b|\bdifference between\b|\bbetter\b|\bgood enough\b|"
    r"\bshould i (use|pick|choose)\b.*\bor\b|\bcompared? (to|with)\b"
)
INTENT_RULES = (
    (r"^what\b|^how (does|do)\b.*\bwork", "definition"),
    (r"^how (do|can|should|would) i\b|^how to\b", "how-to"),
    (TROUBLE, "troubleshooting"),
    (COMPARISON, "comparison"),
    (r"^(why|when should)\b", "why"),
)

# Routing signals.
IDENTIFIERS = (
    r"\b[a-z0-9]+_[a-z0-9_]+\b",
    r"\b[a-z]+[A-Z][A-Za-z]+\b",
    r"\b[A-Z][a-z]+[A-Z][A-Za-z]+\b",
    r"\b\w+\.\w+\.\w+\b",
    r"::|->\w|\w\(\)",
    r"\b[A-Z][A-Z0-9]+_[A-Z0-9_]+\b",
)
ERROR = r"(?i)\b(?:error|exception|traceback|panic|fatal|segfault|stack\s*trace|errno|E\d{3,5}|0x[0-9a-f]{4,})\b|exit\s+code\s+\d+"
QUOTED = "\"[^\"]{4,}\"|'[^']{4,}'"

# Built-in entity aliases.
ENTITY_ALIASES = {
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "pg": "PostgreSQL", "mysql": "MySQL", "mariadb": "MariaDB",
    "innodb": "MySQL", "sqlite": "SQLite", "sqlite3": "SQLite", "redis": "Redis", "pgbouncer": "PgBouncer",
    "jsonb": "JSONB", "mvcc": "MVCC", "wal": "WAL", "vacuum": "VACUUM", "autovacuum": "VACUUM", "rdb": "Redis RDB",
    "aof": "Redis AOF",
}

# Source types named by the type: operator.
TYPE_ALIASES = {
    "docs": ["docs"], "issue": ["github_issue"], "issues": ["github_issue"], "pr": ["github_pr"], "prs": ["github_pr"],
    "release": ["github_release"], "releases": ["github_release"], "blog": ["blog"], "so": ["so"],
    "stackoverflow": ["so"], "qa": ["so"], "hn": ["hn"], "reddit": ["reddit"],
    "github": ["github_issue", "github_pr", "github_release", "github_comment"],
}

# Query rewriting.
SCAFFOLD = r"(?i)^(why (is|are|does|do|did)( my| the)?|how (do|can|should) i|how to|what (is|are)( the)?|should i( use)?|when should i)\s+"
SYNONYMS = {
    "slow": "performance", "fast": "performance", "broken": "not working", "exhausted": "limit reached",
    "crash": "failure", "delete": "remove", "big": "large",
}

# Product names and versions.
PRODUCTS = {
    "postgresql": "postgresql", "postgres": "postgresql", "pg": "postgresql", "mysql": "mysql", "mariadb": "mariadb",
    "sqlite": "sqlite", "redis": "redis", "mongodb": "mongodb", "python": "python", "node": "node", "nodejs": "node",
    "node.js": "node", "django": "django", "fastapi": "fastapi", "flask": "flask", "react": "react", "vue": "vue",
    "angular": "angular", "kubernetes": "kubernetes", "k8s": "kubernetes", "docker": "docker",
    "terraform": "terraform", "go": "go", "golang": "go", "rust": "rust", "java": "java",
    "typescript": "typescript", "php": "php", "ruby": "ruby", "rails": "rails", "spring": "spring",
    "linux": "linux", "git": "git", "npm": "npm", "pip": "pip", "uv": "uv",
}
FOCUS_PRODUCTS = PRODUCTS | {
    "nginx": "nginx", "apache": "apache", "httpd": "apache", "kubectl": "kubernetes", "helm": "helm", "apt": "apt",
    "apt-get": "apt", "next.js": "nextjs", "nextjs": "nextjs", "tailwind": "tailwind", "pandas": "pandas",
    "numpy": "numpy", "pydantic": "pydantic", "javascript": "javascript", "c#": "csharp", ".net": "dotnet",
    "dotnet": "dotnet", "kotlin": "kotlin", "swift": "swift", "gradle": "gradle", "maven": "maven",
    "webpack": "webpack", "vite": "vite", "eslint": "eslint", "yarn": "yarn", "pnpm": "pnpm", "deno": "deno",
    "bun": "bun", "elasticsearch": "elasticsearch", "kafka": "kafka", "graphql": "graphql", "celery": "celery",
    "sqlalchemy": "sqlalchemy",
}
AMBIGUOUS_PRODUCTS = ("go", "pg", "uv", "spring", "rails", "swift", "bun", "helm", "apache")
VERSION = r"v?(\d+(?:\.\d+){0,3})(?:\+|\b)"

# Prompt-injection patterns by category.
INJECTION = {
    "role_override": (
        r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier|your)\s+(?:instructions|prompts?|rules|directives)",
        r"(?i)\bdisregard\s+(?:the\s+)?system\s+prompt\b",
        r"(?i)\byou\s+are\s+now\s+(?:a|an|in)\s+\w+\s+(?:mode|assistant|agent|ai)\b",
        r"(?i)\bnew\s+(?:system\s+)?instructions?\s*:",
        r"(?i)\bfrom\s+now\s+on\s*,?\s+you\s+(?:will|must|should)\b",
    ),
    "assistant_directed": (
        r"(?i)\bto\s+the\s+(?:ai|assistant|model|agent|llm)(?:\s+(?:assistant|model|agent))?\s+(?:reading|processing|summarizing)\s+this\b",
        r"(?i)\bif\s+you\s+are\s+an?\s+(?:ai|llm|language\s+model|assistant|agent)\b[^.\n]{0,80}(?:then|please|you must|do)\b",
        r"(?i)\b(?:dear|attention|hey)[ ,]+(?:ai|assistant|model|llm|agent)\b",
        r"(?i)\bwhen\s+summariz\w+\s+this\s+(?:page|document|content)[^.\n]{0,60}\binstead\b",
    ),
    "exfiltration": (
        r"(?i)\b(?:send|post|upload|forward|transmit|exfiltrate)\s+(?:this|the|your|all)\s+(?:conversation|chat|data|contents?|context|history|secrets?|keys?|credentials?|tokens?)\b",
        r"(?i)\b(?:reveal|print|show|output|repeat|disclose)\s+(?:your\s+)?(?:system\s+prompt|initial\s+instructions|hidden\s+instructions|api\s+keys?|credentials)\b",
        r"(?i)\b(?:read|send|leak|dump)\s+(?:the\s+)?environment\s+variables\b",
    ),
    "tool_markup": (
        r"<\|im_start\|>|<\|im_end\|>",
        r"\[/?INST\]",
        r"(?im)^###\s*(?:system|instruction)s?\b",
        r"(?im)^\s*(?:system|assistant)\s*:\s+\S",
    ),
}
ZERO_WIDTH, ZERO_WIDTH_LEAST = "​‌‍⁠﻿­", 4

# Polarity of statements.
NEGATIONS = (
    "not", "no", "never", "none", "cannot", "can't", "cant", "doesn't", "does not", "don't", "isn't", "is not",
    "aren't", "are not", "won't", "will not", "shouldn't", "should not", "wouldn't", "couldn't", "without", "nor",
    "unable", "fails to", "failed to", "lacks", "lack of",
)
ANTONYMS = (
    (("faster", "quicker", "speedup", "speeds up"), ("slower", "slowdown", "slows down")),
    (("better", "superior"), ("worse", "inferior")),
    (("thread-safe", "threadsafe"), ("unsafe", "race condition", "data race")),
    (("recommended", "preferred", "idiomatic", "best practice"), ("discouraged", "deprecated", "anti-pattern", "antipattern", "obsolete")),
    (("still supported", "still works", "still available"), ("unsupported", "was removed", "has been removed", "no longer works", "no longer supported")),
    (("required", "mandatory"), ("optional", "unnecessary", "not needed")),
    (("enabled by default", "on by default"), ("disabled by default", "off by default")),
    (("production-ready", "production ready"), ("experimental", "unstable", "not production")),
    (("increases", "higher"), ("decreases", "lower")),
    (("always",), ("never",)),
    (("durable", "persisted"), ("lossy", "ephemeral", "volatile")),
)
STOP_WORDS = tuple(
    "a an and are as at be been being but by for from has have how if in into is it its of on or over so than that "
    "the their then there these they this to under until was were what when where which while who why will with "
    "you your".split()
)

# Source tiers, with their priors, cache lives in hours, and hosts.
TIER_PRIORS = {"docs": 1.0, "repo": 0.85, "registry": 0.8, "qa": 0.8, "blog": 0.55, "unknown": 0.35}
TTL_HOURS = {"docs": 168, "repo": 24, "registry": 72, "qa": 24, "blog": 168, "unknown": 24}
OFF_DOMAIN, PER_HOST = 0.5, 2
HOSTS = {
    "docs.python.org": ("docs", "docs"),
    "developer.mozilla.org": ("docs", "docs"),
    "learn.microsoft.com": ("docs", "docs"),
    "docs.oracle.com": ("docs", "docs"),
    "docs.aws.amazon.com": ("docs", "docs"),
    "cloud.google.com": ("docs", "docs"),
    "kubernetes.io": ("docs", "docs"),
    "docs.docker.com": ("docs", "docs"),
    "developer.hashicorp.com": ("docs", "docs"),
    "postgresql.org": ("docs", "docs"),
    "dev.mysql.com": ("docs", "docs"),
    "mariadb.com": ("docs", "docs"),
    "sqlite.org": ("docs", "docs"),
    "redis.io": ("docs", "docs"),
    "mongodb.com": ("docs", "docs"),
    "docs.djangoproject.com": ("docs", "docs"),
    "fastapi.tiangolo.com": ("docs", "docs"),
    "flask.palletsprojects.com": ("docs", "docs"),
    "nodejs.org": ("docs", "docs"),
    "react.dev": ("docs", "docs"),
    "vuejs.org": ("docs", "docs"),
    "angular.dev": ("docs", "docs"),
    "go.dev": ("docs", "docs"),
    "pkg.go.dev": ("docs", "docs"),
    "doc.rust-lang.org": ("docs", "docs"),
    "docs.rs": ("docs", "docs"),
    "rust-lang.org": ("docs", "docs"),
    "cppreference.com": ("docs", "docs"),
    "man7.org": ("docs", "docs"),
    "git-scm.com": ("docs", "docs"),
    "docs.github.com": ("docs", "docs"),
    "docs.gitlab.com": ("docs", "docs"),
    "docs.astral.sh": ("docs", "docs"),
    "pip.pypa.io": ("docs", "docs"),
    "packaging.python.org": ("docs", "docs"),
    "readthedocs.io": ("docs", "docs"),
    "kernel.org": ("docs", "docs"),
    "wiki.postgresql.org": ("docs", "docs"),
    "nextjs.org": ("docs", "docs"),
    "vercel.com": ("docs", "docs"),
    "legacy.reactjs.org": ("docs", "docs"),
    "eslint.org": ("docs", "docs"),
    "typescriptlang.org": ("docs", "docs"),
    "nginx.org": ("docs", "docs"),
    "k8s.io": ("docs", "docs"),
    "helm.sh": ("docs", "docs"),
    "docs.npmjs.com": ("docs", "docs"),
    "vite.dev": ("docs", "docs"),
    "vitejs.dev": ("docs", "docs"),
    "webpack.js.org": ("docs", "docs"),
    "tailwindcss.com": ("docs", "docs"),
    "svelte.dev": ("docs", "docs"),
    "deno.com": ("docs", "docs"),
    "bun.sh": ("docs", "docs"),
    "pnpm.io": ("docs", "docs"),
    "yarnpkg.com": ("docs", "docs"),
    "jestjs.io": ("docs", "docs"),
    "vitest.dev": ("docs", "docs"),
    "playwright.dev": ("docs", "docs"),
    "prisma.io": ("docs", "docs"),
    "php.net": ("docs", "docs"),
    "ruby-lang.org": ("docs", "docs"),
    "kotlinlang.org": ("docs", "docs"),
    "swift.org": ("docs", "docs"),
    "dart.dev": ("docs", "docs"),
    "developer.apple.com": ("docs", "docs"),
    "developer.android.com": ("docs", "docs"),
    "developers.cloudflare.com": ("docs", "docs"),
    "docs.ansible.com": ("docs", "docs"),
    "nixos.org": ("docs", "docs"),
    "apache.org": ("docs", "docs"),
    "elastic.co": ("docs", "docs"),
    "prometheus.io": ("docs", "docs"),
    "grafana.com": ("docs", "docs"),
    "istio.io": ("docs", "docs"),
    "debian.org": ("docs", "docs"),
    "ubuntu.com": ("docs", "docs"),
    "archlinux.org": ("docs", "docs"),
    "pgxn.org": ("registry", "docs"),
    "discuss.python.org": ("qa", "blog"),
    "forums.docker.com": ("qa", "blog"),
    "freecodecamp.org": ("blog", "blog"),
    "percona.com": ("blog", "blog"),
    "github.com": ("repo", "docs"),
    "gitlab.com": ("repo", "docs"),
    "bitbucket.org": ("repo", "docs"),
    "pypi.org": ("registry", "docs"),
    "npmjs.com": ("registry", "docs"),
    "crates.io": ("registry", "docs"),
    "rubygems.org": ("registry", "docs"),
    "nuget.org": ("registry", "docs"),
    "hex.pm": ("registry", "docs"),
    "mvnrepository.com": ("registry", "docs"),
    "stackoverflow.com": ("qa", "so"),
    "stackexchange.com": ("qa", "so"),
    "serverfault.com": ("qa", "so"),
    "superuser.com": ("qa", "so"),
    "askubuntu.com": ("qa", "so"),
    "news.ycombinator.com": ("qa", "hn"),
    "reddit.com": ("qa", "reddit"),
    "dev.to": ("blog", "blog"),
    "medium.com": ("blog", "blog"),
    "hashnode.dev": ("blog", "blog"),
    "substack.com": ("blog", "blog"),
    "github.io": ("blog", "blog"),
    "martinfowler.com": ("blog", "blog"),
    "use-the-index-luke.com": ("blog", "blog"),
    "baeldung.com": ("blog", "blog"),
    "digitalocean.com": ("blog", "blog"),
    "geeksforgeeks.org": ("blog", "blog"),
    "w3schools.com": ("blog", "blog"),
    "realpython.com": ("blog", "blog"),
}
BLOCKED = (
    "youtube.com",
    "youtu.be",
    "vimeo.com",
    "facebook.com",
    "instagram.com",
    "tiktok.com",
    "pinterest.com",
    "x.com",
    "twitter.com",
    "linkedin.com",
)

# Classes that name the language of code.
CODE_CLASS = r'(?i)class="[^"]*(?:language|lang|highlight-source)-([a-z0-9+#]+)'

# Cues that say what happened to a product in a version, the strongest first. {names} stands for the product names.
VERSION_CUES = (
    ("removed", r"(?i)\b(?:removed|dropped|deleted)\s+(?:in|as\s+of|since|from)\s+({names})?\s*v?(\d+(?:\.\d+){0,3})(?:\+|\b)"),
    ("deprecated", r"(?i)\bdeprecated\s+(?:in|as\s+of|since|from)\s+({names})?\s*v?(\d+(?:\.\d+){0,3})(?:\+|\b)"),
    ("since", r"(?i)\b(?:introduced|added|available|new|supported)\s+(?:in|as\s+of|since|from)\s+({names})?\s*v?(\d+(?:\.\d+){0,3})(?:\+|\b)"),
    ("since", r"(?i)\bsince\s+({names})\s+v?(\d+(?:\.\d+){0,3})(?:\+|\b)"),
    ("mentions", r"(?i)\b({names})\s+v?(\d+(?:\.\d+){0,3})(?:\+|\b)"),
)

# Sub-questions of a research plan by intent. {core} is the question without its question words, {head} its first entity.
PLAN_QUESTIONS = {
    "comparison": ("How do {a} and {b} compare on {axis}?", "When should you choose {a} over {b}?"),
    "troubleshooting": ("What are the common causes of {core}?", "How do you diagnose {core}?", "How do you fix {core}?", "How do you prevent {core}?"),
    "definition": ("What is {head}?", "How does {head} work?", "What are the main use cases and tradeoffs of {head}?"),
    "how-to": ("What is the standard way to {core}?", "What are common pitfalls when you {core}?", "What are the best practices for {core}?"),
    "why": ("What causes {core}?", "Why does {core} happen?", "How do you address {core}?"),
}

#: Cues of reasons, of assertions and of changes in the life of a feature.
CAUSAL = r"(?i)\b(because|due to|since|reason|caused by|so that|as a result|explains?)\b"
ASSERTION_CUE = (
    r"(?i)\b(better|worse|faster|slower|more|less|should|must|because|due to|causes?|"
    r"prefer|avoid|recommend|instead|unlike|whereas|is the|are the|handles?|"
    r"outperforms?|scales?|supports?|lacks?|cannot|does not|doesn't)\b"
)
LIFECYCLE = (
    r"(?i)(deprecat\w*|removed in|was removed|been removed|no longer|superseded|obsolete|"
    r"replaced by|renamed|retired|retirement|end[- ]of[- ]life|legacy)"
)

#: Other wordings of a query by its intent; the blank is the query without its question words.
WORDINGS = {
    "troubleshooting": ("%s error", "fix %s"),
    "definition": ("%s explained", "how %s works"),
    "how-to": ("%s example", "%s best practices"),
    "why": ("%s reasons", "%s explained"),
}
#: Wordings of a comparison, with and without entities that it names.
COMPARED = {"both": " vs ", "not both": "%s comparison", "one": "when to use %s", "none": "%s tradeoffs"}

#: Similarities from which a chunk restates, explains or weakly restates a claim.
STRONG_SUPPORT_SIM, EXPLAIN_SIM, SUPPORT_SIM = 0.55, 0.40, 0.45

#: Fixed value: what is left of the trust of a suspicious document.
TRUST_PENALTY = 0.5
