"""Fixed values that results depend on: rates, names, limits, example questions."""

TIERS = ["simple", "medium", "complex"]

# Rate cards (USD per 1,000 tokens), output caps, model names.
# (tier, provider, model, input rate, output rate, max output tokens)
RATE_CARD = [
    ("simple", "primary", "groq/openai/gpt-oss-20b", 0.00025, 0.00125, 1024),
    ("medium", "primary", "groq/llama-3.3-70b-versatile", 0.00015, 0.0006, 2048),
    ("complex", "primary", "groq/openai/gpt-oss-120b", 0.005, 0.015, 4096),
    ("simple", "local", "ollama/qwen2.5:0.5b", 0.00025, 0.00125, 1024),
    ("medium", "local", "ollama/llama3.2:3b", 0.00015, 0.0006, 2048),
    ("complex", "local", "ollama/llama3.1:8b", 0.005, 0.015, 4096),
]

# Premium baseline (USD per 1,000 tokens).
BASELINE_INPUT_RATE = 0.005
BASELINE_OUTPUT_RATE = 0.015

# Provider quotas (model, requests/minute, tokens/minute, requests/day).
QUOTAS = [
    ("groq/openai/gpt-oss-20b", 1000, 250_000, 14_400),
    ("groq/llama-3.3-70b-versatile", 1000, 300_000, 14_400),
    ("groq/openai/gpt-oss-120b", 1000, 250_000, 14_400),
]

# Models every distribution report shows, in display order.
LOCAL_BUCKET = "ollama (fallback)"
KNOWN_MODELS = [
    "groq/openai/gpt-oss-20b",
    "groq/llama-3.3-70b-versatile",
    "groq/openai/gpt-oss-120b",
    LOCAL_BUCKET,
]

# Thresholds and limits.
CACHE_THRESHOLD = 0.92
CACHE_TTL_SECONDS = 3600
SWEEP_THRESHOLDS = [0.85, 0.90, 0.92, 0.95, 0.98]
SWEEP_TOP_K = [5, 15, 48]
ROUTE_TOP_K = 15
ROUTE_THRESHOLD = 0.5
ROUTE_CONFIDENCE_SCALE = 5.0
NO_ROUTE_CONFIDENCE = 0.85
DEFAULT_TIER = "medium"
ESCALATION_FACTOR = 0.75
ACCURACY_TARGET = 0.80
GUARD_CHARS = 2000
DEFAULT_TEMPERATURE = 0.7
MAX_TRIES_PER_TIER = 3
MAX_SERIES_POINTS = 200
RECENT_ROWS = 50
PAGE_SIZE = 5
SPARK_WIDTH = 200
SPARK_HEIGHT = 40

# Columns a history page may be sorted by, and the page's columns.
HISTORY_SORTS = ["created_at", "tier", "model_used", "latency_ms", "savings_usd"]
HISTORY_COLUMNS = [
    "created_at", "tier", "model_used", "query_id", "cache_hit", "fallback_used",
    "routing_reason", "latency_ms", "input_tokens", "output_tokens",
    "theoretical_cost_usd", "baseline_cost_usd", "savings_usd", "savings_source",
]
RECENT_COLUMNS = [
    "created_at", "tier", "model_used", "cache_hit", "fallback_used", "latency_ms",
    "input_tokens", "output_tokens", "theoretical_cost_usd", "baseline_cost_usd",
    "savings_usd", "savings_source",
]

# Report nodes in display order (node id, model bucket it shows).
ROUTE_NODES = [
    ("request", None),
    ("cache", None),
    ("classify", None),
    ("groq-oss-20b", "groq/openai/gpt-oss-20b"),
    ("groq-llama-70b", "groq/llama-3.3-70b-versatile"),
    ("groq-oss-120b", "groq/openai/gpt-oss-120b"),
    ("ollama", LOCAL_BUCKET),
]

# Provider error texts and the category each stands for, first match wins.
ERROR_PATTERNS = [
    ("rate_limit", ["rate limit", "429", "ratelimit"]),
    ("deprecated", ["decommissioned", "deprecated", "not supported"]),
    ("timeout", ["timeout"]),
    ("connection", ["connection", "connect"]),
]

# Example questions of each tier.
EXAMPLE_QUESTIONS = {
    "simple": [
        "What is Python?",
        "Who invented the telephone?",
        "What is the capital of France?",
        "When was the Eiffel Tower built?",
        "What does API stand for?",
        "Define machine learning",
        "What is a neural network?",
        "What does HTTP mean?",
        "What is recursion?",
        "What is 2 + 2?",
        "How do you spell necessary?",
        "What is the boiling point of water?",
        "How many days are in a leap year?",
        "Convert 100 Celsius to Fahrenheit",
        "Is Python object-oriented?",
        "What year did World War 2 end?",
    ],
    "medium": [
        "Explain how neural networks work",
        "How does the internet work?",
        "Explain the difference between RAM and ROM",
        "How does photosynthesis work?",
        "Explain TCP/IP in simple terms",
        "Compare Python and JavaScript",
        "What are the differences between SQL and NoSQL?",
        "Compare Docker and virtual machines",
        "What are the pros and cons of microservices?",
        "Summarize the French Revolution",
        "Translate this paragraph to French",
        "Give me an overview of machine learning",
        "How do I improve my writing skills?",
        "What is the best way to learn programming?",
        "How should I structure a REST API?",
    ],
    "complex": [
        "Write a Python function for binary search",
        "Implement a linked list in Python",
        "Write a REST API endpoint in FastAPI",
        "Create a sorting algorithm in JavaScript",
        "Write a SQL query to find duplicate records",
        "Debug this code and explain what is wrong",
        "Why is my code throwing a TypeError?",
        "Fix this Python function that has a bug",
        "Design a database schema for an e-commerce app",
        "Architect a microservices system for a social network",
        "How would you design a URL shortener like bit.ly?",
        "Write an essay about climate change and its economic impact",
        "Write a detailed analysis of the French Revolution",
        "Write a technical blog post about Docker",
        "Analyze the time complexity of quicksort",
        "Explain the CAP theorem with examples",
        "What are the trade-offs between consistency and availability?",
        "Explain step by step how a compiler performs register allocation",
        "Explain how a hash table resolves collisions internally",
        "Derive the closed-form solution for a linear recurrence relation",
        "Implement OAuth2 authentication in a web service",
        "Write a regular expression to parse structured log lines and explain it",
        "Architect a scalable video streaming platform for millions of viewers",
        "Explain how a memory allocator implements free-list coalescing",
        "Prove the correctness of Dijkstra's shortest path algorithm",
    ],
}
