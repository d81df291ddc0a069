"""Closed vocabularies, limits and tables. Results depend on them."""

SOURCE_TYPES = ("api", "rss")
REJECT_REASONS = ("invalid-source", "invalid-article-shape", "missing-title", "missing-url", "invalid-url", "invalid-published-at")
MISSING_DATE_POLICIES = ("reject", "use-discovered-at")
FRESHNESS_CLASSES = ("fresh", "stale", "missing-published-at", "future-published-at")
DEDUP_KEY_TYPES = ("source-external-id", "canonical-url", "publisher-title")
CANDIDATE_REASONS = ("within-time-window", "time-overlap", "time-unknown", "outside-time-window")
NEW_STORY_REASONS = ("no-candidates", "no-matching-candidates", "ambiguous-matching-candidates")
CLUSTERING_VERSION = "story-clustering-v1"
MATCH_THRESHOLD = 0.7
MATCH_REASON, NO_MATCH_REASON = "semantic-similarity-at-or-above-v1-threshold", "semantic-similarity-below-v1-threshold"
SIGNAL = "semanticSimilarity"

TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")

TITLE_MAX, PUBLISHER_MAX, EXCERPT_MAX, GOAL_MAX, PAGE_TEXT_MAX = 500, 200, 1000, 1000, 16_000
SEARCH_DEFAULT, SEARCH_MAX = 5, 10
PROMPT_SOURCES, DEFAULT_GOAL = 25, "Improve source coverage for this story."
LIST_DEFAULT, LIST_MAX = 25, 100
PROVIDER_MAX = 100  # articles of a response of the JSON provider

BLOCKED_HOSTS = ("localhost", "localhost.localdomain")
BLOCKED_HOST_SUFFIXES = (".localhost", ".local", ".internal")
BLOCKED_IPV4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
BLOCKED_IPV6 = ("::/128", "::1/128", "::ffff:0:0/96", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32")

#: Tool error code -> whether a retry may help.
TOOL_ERRORS = {
    "unavailable": True,
    "rate-limited": True,
    "quota-exhausted": False,
    "timeout": True,
    "unknown-source": False,
    "blocked-url": False,
    "unsupported-content": False,
    "invalid-result": False,
    "tool-failed": False,
}

DURATION_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30)
LEASE_MARGIN_MS, RETRY_MARGIN_MS = 30_000, 1_000

#: Metric -> its labels. Counters end in _total, histograms in _seconds. Fixed values.
METRICS = {
    "discovery_jobs_total": ("source_id", "status"),
    "articles_fetched_total": ("source_id",),
    "articles_normalized_total": ("source_id",),
    "articles_normalization_rejected_total": ("source_id",),
    "articles_fresh_total": ("source_id",),
    "articles_freshness_rejected_total": ("source_id",),
    "articles_unique_total": ("source_id",),
    "articles_duplicates_total": ("source_id",),
    "articles_persisted_total": ("source_id",),
    "discovery_duration_seconds": ("source_id",),
    "discovery_enqueue_total": ("source_id", "status"),
    "discovery_enqueue_duration_seconds": ("source_id",),
    "source_fetch_duration_seconds": ("source_id",),
    "persistence_duration_seconds": ("source_id",),
    "research_executions_total": ("outcome", "stop_reason"),
    "research_execution_duration_seconds": ("outcome",),
    "research_model_calls_total": (),
    "research_tool_calls_total": (),
    "research_selected_sources_total": ("outcome",),
    "research_unresolved_questions_total": ("outcome",),
    "story_clustering_attempts_total": ("outcome",),
    "story_candidates_total": (),
    "story_semantic_comparisons_total": (),
    "story_clustering_duration_seconds": (),
    "story_candidate_generation_duration_seconds": (),
    "story_semantic_comparison_duration_seconds": (),
}
STORY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
RESEARCH_BUCKETS = (0.1, 0.25, 0.5, 1, 2.5, 5, 10, 15, 30, 60)
