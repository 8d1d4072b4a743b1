"""Fixed values.

Every literal below is part of the result contract: names that are recognised,
words that are counted, ranges that are removed, and default parameters. They are
kept as plain text in one place so they can be reviewed at a glance.
"""

# --- fixed values: canonical review schema -----------------------------------
REVIEW_COLUMNS = [
    "review_id", "user", "content", "score", "thumbs_up", "app_version", "created_at", "source",
]
CLEANED_COLUMNS = [
    "review_id", "user", "content", "score", "thumbs_up", "thumbs_up_capped", "app_version",
    "created_at", "source", "content_len", "is_very_long",
]
SCRAPE_COLUMNS = [
    "reviewId", "userName", "content", "score", "thumbsUpCount", "reviewCreatedVersion", "at",
    "appVersion",
]

# --- fixed values: accepted raw column names (lower case) --------------------
COLUMN_SYNONYMS = {
    "review_id": ["reviewid", "review_id", "id"],
    "user": ["username", "user", "author", "name"],
    "content": ["content", "text", "review", "comment"],
    "score": ["score", "rating", "stars"],
    "thumbs_up": ["thumbsupcount", "thumbs_up", "likes", "like_count"],
    "app_version": ["appversion", "app_version", "version"],
    "created_at": ["at", "created_at", "date", "timestamp"],
}
SCORE_CANDIDATES = [
    "score", "rating", "ratings", "rate", "rating_value", "score_value", "rating_score", "stars",
]
DATE_CANDIDATES = [
    "created_at", "created", "date", "timestamp", "time", "review_time", "created_time",
]
CONTENT_CANDIDATES = ["content", "review", "text", "comment", "body"]
VERSION_CANDIDATES = ["app_version", "version", "app_ver", "ver", "version_name"]
TARGET_FRAGMENTS = ["rating", "score", "target"]

# --- fixed values: tokens a CSV reader treats as missing (pandas' public list) -
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
PLACEHOLDER_USERS = ["google user", "nan", "none", ""]

# --- fixed values: code point ranges removed as emoji (inclusive) ------------
EMOJI_RANGES = [
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF),
    (0x02702, 0x027B0),
    (0x024C2, 0x1F251),
]
# The same list without the wide last range, which also covers CJK and Hangul.
EMOJI_ONLY_RANGES = EMOJI_RANGES[:5]

# --- fixed values: keyword lists ---------------------------------------------
EMOTIONAL_KEYWORDS = [
    "angry", "anger", "angri", "frustrat", "frustration", "annoy", "annoyed", "hate",
    "disappoint", "disappointed", "furious", "rage", "terrible", "awful", "worst", "sucks",
    "upset", "bug", "crash", "crashed", "lag", "laggy", "slow", "broken", "error", "fault",
    "issue", "problems", "problem", "refund", "scam", "fake", "spam",
]
FUNCTIONAL_KEYWORDS = [
    "entertain", "entertainment", "filter", "music", "audio", "video", "edit", "upload",
    "camera", "effect", "effects", "feature", "features", "trend", "duet", "sticker", "sound",
    "filtering", "recommend", "search", "profile", "notification", "comment", "share",
    "download", "stream", "layout", "ui", "ux", "bookmark",
]
TOP_KEYWORDS = 15
SUMMARY_KEYWORDS = 5

# --- fixed values: engineered features, in matrix order ----------------------
BASE_FEATURES = [
    "content_len_chars", "content_len_words", "avg_word_len", "punct_count", "upper_ratio",
    "thumbs_up_feat", "log_thumbs_up", "words_per_punct", "engagement_per_word",
]
TEMPORAL_FEATURES = ["year", "month", "day_of_week", "days_since_first"]
REQUIRED_FEATURES = 5

# --- fixed values: thresholds and model settings ------------------------------
CAP_QUANTILE = 0.99
VERY_LONG_QUANTILE = 0.999
VERY_SHORT_CHARS = 10
WORDS_PER_PUNCT_CAP = 100.0
ENGAGEMENT_CAP = 10.0
SKEW_SYMMETRIC = 0.5
SKEW_HIGH = 1.0
ONE_HOT_MAX_CATEGORIES = 20
MISSING_CATEGORY = "missing"
MINORITY_WARNING_PCT = 10.0
TEST_SHARE = 0.15
VALIDATION_SHARE = 0.176
REGRESSION_TEST_SHARE = 0.2
SEED = 42
PAGE_ROWS = 20_000
RELEASE_LABELS_MAX = 16
KMEANS_STARTS = 10  # per candidate k
KMEANS_FINAL_STARTS = 20  # of the chosen k
K_RANGE = (2, 6)
DBSCAN_EPS = 0.8
DBSCAN_MIN_POINTS = 10
VERDICT_MARGIN = 0.02
