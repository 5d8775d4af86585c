"""Results depend on these exact strings and numbers."""

# Month names of the Turkish date texts, January first.
TURKISH_MONTHS = [
    "Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran",
    "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık",
]

# Resolution states of a complaint.
RESOLVED = "Çözüldü"
UNRESOLVED = "Çözülmedi"
UNKNOWN = "Bilinmiyor"

# Column order of a complaint record.
COMPLAINT_COLUMNS = [
    "operator", "id", "date", "date_raw", "username", "title", "full_text",
    "company_reply", "is_resolved", "satisfaction", "description_preview",
    "keywords", "view_count", "upvote_count", "url",
]

# CSS classes of the list card and of the detail page.
CARD = "card-v2"
CARD_TITLE = "complaint-title"
CARD_USER = "username"
CARD_TIME = ("js-tooltip", "time")
CARD_VIEWS = "js-view-count"
CARD_KEYWORD = "sv-model-button"
CARD_PREVIEW = "complaint-description"
CARD_PREVIEW_NOISE = "ellipsis-text"
DETAIL_TEXT = "complaint-detail-description"
DETAIL_REPLY = "complaint-reply-container"
DETAIL_BADGE = "solved-badge"
DETAIL_RATING = "rate-num"

# Thresholds of the analysis.
NULL_BANDS = (5.0, 20.0)
SKEW_LIMIT = 1.0
VIEW_CLIP = 1000
ACCURACY_TARGET = 0.70
TEST_SHARE = 0.20
SEED = 42
FOLDS = 5
MIN_DOCS_TOPICS = 20
MIN_VOCABULARY = 10
MIN_DOCS_MODEL = 50
TOPIC_MIN_DF = 3
TOPIC_MAX_DF_SHARE = 0.85
TOPIC_MAX_TERMS = 4_000_000
TOPIC_RANGE = range(3, 11)
TFIDF_MIN_DF = 2
TFIDF_NGRAMS = (1, 2)
TFIDF_MAX_TERMS = 10_000
COHERENCE_WINDOW = 110
COHERENCE_TOP = 20
TOP_CATEGORIES = 15
TOP_FEATURES = 20
TOP_WORDS = 100

# What the numeric references 128 to 159 stand for (those without a character for themselves).
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"

# Entities that the SQL of the page queries decodes, "&amp;" last so nothing decodes twice.
HTML_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
