"""Rule classifiers: ordered conditions over lower-case text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics that are no news, phrases of consent and pay walls, and limits of article content.
SKIPPED_TOPICS = ("opinion", "editorial", "column", "weather forecast", "horoscope", "gossip", "obituary", "live score", "live updates", "deal of the day")
WALL_PHRASES = (
    "continue without agreeing", "we and our partners", "cookies or similar technologies", "store and/or access information on a device", "manage your cookie",
    "accept all cookies", "your privacy choices", "legitimate business interest", "please enable javascript", "enable javascript to", "turn on javascript",
    "subscribe to continue reading", "sign in to continue", "create a free account to", "you have reached your article limit", "checking your browser",
    "verify you are a human", "are you a robot", "access to this page has been denied",
)
LEAST_CHARS, MOST_LINKS_PER_KCHAR, LEAST_SENTENCES_PER_KCHAR, HEAD_CHARS = 400, 12.0, 1.5, 1500

# Causes of failures by words of the message or of the error's type: (category, confidence, words, type words).
CAUSES = (
    ("LLM_RATE_LIMIT", 0.95, ("429", "rate limit", "quota exceeded", "ratelimiterror", "too many requests"), ("ratelimit",)),
    ("LLM_CONTEXT_WINDOW_EXCEEDED", 0.90, ("context length", "max tokens", "context window", "too long", "token limit"), ("contextlength",)),
    ("DATABASE_TIMEOUT", 0.85, ("timeout", "connection pool", "operationalerror", "interfaceerror", "too many connections"), ("operationalerror",)),
    ("VECTOR_DB_UNAVAILABLE", 0.95, ("qdrant", "connectionrefused", "vector db", "cannot connect to vector"), ("connectionrefused",)),
    ("OUT_OF_MEMORY", 0.90, ("memoryerror", "oom"), ("memoryerror",)),
    ("RSS_INGESTION_FAILURE", 0.80, ("feedparser", "xml parsing", "beautifulsoup", "newspaper4k", "crawling failed"), ()),
)
DEFAULT_CAUSE = ("UNKNOWN_PIPELINE_ERROR", 0.50)

# Fixed values: (category, subtype, code) by stage, by model words, by data words and by system words.
AGENT_STAGES = (
    (("summary_reflection", "reflection_agent"), ("agent_error", "REFLECTION_FAILURE", "REFLECTION_FAILED")),
    (("cluster_verification", "clustering_verification"), ("agent_error", "CLUSTER_VERIFICATION_FAILURE", "VERIFICATION_FAILED")),
    (("judge_arbitration", "judge_agent"), ("agent_error", "JUDGE_AGENT_FAILURE", "JUDGE_FAILED")),
    (("entity_disambiguation", "entity_disambiguation_agent"), ("agent_error", "ENTITY_DISAMBIGUATION_FAILURE", "DISAMBIGUATION_FAILED")),
)
MODEL_WORDS = ("quota", "rate limit", "rate_limit", "429", "resource_exhausted", "context length", "token limit", "invalid api key", "authentication", "unauthorized",
               "api_key", "model_not_found", "gemini", "openai", "groq", "cerebras", "nvidia", "providers failed")
MODEL_RULES = (
    (("quota", "resource_exhausted", "billing", "exhausted"), ("QUOTA_EXCEEDED", "RESOURCE_EXHAUSTED")),
    (("rate", "429", "too many requests", "cooling down"), ("RATE_LIMITED", "RATE_LIMIT_EXCEEDED")),
    (("timeout", "timed out"), ("TIMEOUT", "LLM_TIMEOUT")),
    (("context length", "token limit", "context window"), ("CONTEXT_LENGTH_EXCEEDED", "CONTEXT_LENGTH_EXCEEDED")),
    (("json", "parse", "decode"), ("MALFORMED_JSON", "MALFORMED_JSON")),
    (("safety", "block", "harmful"), ("SAFETY_FILTER_BLOCK", "SAFETY_FILTER_BLOCK")),
    (("503", "unavailable", "server error", "502"), ("PROVIDER_UNAVAILABLE", "PROVIDER_UNAVAILABLE")),
    (("auth", "api key", "unauthorized", "401"), ("AUTHENTICATION_ERROR", "AUTHENTICATION_ERROR")),
    (("model not found", "does not exist"), ("MODEL_UNAVAILABLE", "MODEL_UNAVAILABLE")),
)
DATA_RULES = (
    (("empty article",), ("EMPTY_ARTICLE", "EMPTY_ARTICLE")),
    (("html", "beautifulsoup"), ("INVALID_HTML", "INVALID_HTML")),
    (None, ("EXTRACTION_FAILURE", "EXTRACTION_FAILED")),  # the extraction stage, where the message names extraction or event
    (("fingerprint", "malformed event"), ("MALFORMED_EVENT", "MALFORMED_EVENT")),
    (("missing entities",), ("MISSING_ENTITIES", "MISSING_ENTITIES")),
    (("timeline", "corrupt timeline"), ("CORRUPT_TIMELINE", "CORRUPT_TIMELINE")),
)
SYSTEM_RULES = (
    (("database", "cursor"), ("DATABASE_ERROR", "DB_FAILURE")),
    (("redis", "aioredis"), ("REDIS_FAILURE", "REDIS_FAILURE")),
    (("qdrant", "vector"), ("QDRANT_FAILURE", "QDRANT_FAILURE")),
    (("celery", "kombu"), ("CELERY_FAILURE", "CELERY_FAILURE")),
    (("validation", "pydantic", "json"), ("SERIALIZATION_ERROR", "SERIALIZATION_ERROR")),
    (("timeout", "timeouterror"), ("TIMEOUT", "TIMEOUT")),
    (("http", "network", "connection", "socket"), ("NETWORK_ISSUE", "NETWORK_ISSUE")),
    (("memory", "oom"), ("MEMORY_ISSUE", "OOM")),
)

# Signals of bot walls, and those that tell on a short page only.
STRONG = ("just a moment", "checking your browser", "challenge-platform", "cf-browser-verification", "__cf_chl", "cf_clearance", "ddos protection", "bot detection", "robot check",
          "attention required", "verify you are human", "human verification", "press & hold", "are you a robot", "distil networks", "perimeter x", "px-captcha", "datadome", "incapsula",
          "kasada", "akamai bot")
WEAK = ("security check", "access denied", "enable javascript", "please enable js", "ray id", "subscribe to continue", "subscription required", "create a free account to continue",
        "sign in to read", "this article is for subscribers")


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Whether lower-case ``text`` holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def topic_skipped(title: Column) -> Column:
    return holds_any(F.lower(F.coalesce(title, F.lit(""))), SKIPPED_TOPICS)


def content_reason(text: Column) -> Column:
    """ok, empty, too_short, boilerplate_wall, link_farm or not_prose."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    n, low = F.length(body), F.lower(body)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in WALL_PHRASES), F.lit(0))
    links = F.regexp_count(body, F.lit(r"(?i)\]\(\s*(?:https?:|blob:|javascript:)")) + F.regexp_count(body, F.lit(r"https?://\S+"))
    ends = F.regexp_count(body, F.lit(r"""[.!?][\s"')\]]"""))
    return (F.when(n == 0, "empty").when(n < LEAST_CHARS, "too_short")
            .when(holds_any(F.substring(low, 1, HEAD_CHARS), WALL_PHRASES) | (hits >= 2), "boilerplate_wall")
            .when(links / (n / 1000.0) > MOST_LINKS_PER_KCHAR, "link_farm")
            .when(ends / (n / 1000.0) < LEAST_SENTENCES_PER_KCHAR, "not_prose").otherwise("ok"))


def bot_blocked(html: Column, strong: Sequence[str], weak: Sequence[str], least: int = 200, weak_most: int = 5000) -> Column:
    """A missing or very short page, one with a strong signal outside noscript, or a short one with a weak signal."""
    page = F.regexp_replace(F.coalesce(html, F.lit("")), r"^\s+|\s+$", "")
    low = F.lower(F.regexp_replace(page, r"(?is)<noscript.*?</noscript>", " "))
    return (F.length(page) < least) | holds_any(low, strong) | ((F.length(page) <= weak_most) & holds_any(low, weak))


def cause(message: Column, kind: Column) -> tuple[Column, Column]:
    """Root cause of a failure and its confidence; null where there is neither message nor type."""
    m, k = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    name, sure = F.lit(DEFAULT_CAUSE[0]), F.lit(DEFAULT_CAUSE[1])
    for category, confidence, words, kinds in reversed(CAUSES):
        hit = holds_any(m, words) | holds_any(k, kinds)
        name, sure = F.when(hit, category).otherwise(name), F.when(hit, confidence).otherwise(sure)
    some = (m != "") | (k != "")
    return F.when(some, name), F.when(some, sure)


def failure_class(message: Column, kind: Column, stage: Column) -> Column:
    """struct(category, subtype, code) of a failure: by stage, then model, data and system words."""
    m, k, s = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(kind, F.lit(""))), F.coalesce(stage, F.lit(""))
    as_struct = lambda c, x, y: F.struct(F.lit(c).alias("category"), F.lit(x).alias("subtype"), F.lit(y).alias("code"))
    system = as_struct("system_error", "SYSTEM_ERROR", "UNKNOWN_SYSTEM_ERROR")
    for i, (words, (a, b)) in reversed(list(enumerate(SYSTEM_RULES))):
        hit = holds_any(m, words)
        if i == 0:
            hit = hit | holds_any(k, ("sqlalchemy", "asyncpg", "psycopg"))
        system = F.when(hit, as_struct("system_error", a, b)).otherwise(system)
    data = system
    for words, (a, b) in reversed(DATA_RULES):
        hit = (s == "event_extraction") & holds_any(m, ("extraction", "event")) if words is None else holds_any(m, words)
        data = F.when(hit, as_struct("data_error", a, b)).otherwise(data)
    model = as_struct("llm_error", "UNKNOWN_LLM_ERROR", "UNKNOWN_PROVIDER_ERROR")
    for words, (a, b) in reversed(MODEL_RULES):
        model = F.when(holds_any(m, words), as_struct("llm_error", a, b)).otherwise(model)
    out = F.when(holds_any(m, MODEL_WORDS) | holds_any(k, ("llm", "openai")), model).otherwise(data)
    for stages, (c, a, b) in reversed(AGENT_STAGES):
        out = F.when(s.isin(*stages), as_struct(c, a, b)).otherwise(out)
    return out
