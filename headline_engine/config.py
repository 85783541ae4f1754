"""Engine configuration: every tunable of the headline pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference's for right results.
# Defaults: report mode, per-group cap, weight mix, message byte limits per
# channel, holiday push hours (UTC+8), hot threshold, hotness rank bound,
# near-duplicate threshold and blend, length guard, triage threshold and
# context cap, history window, retention periods.
DEFAULT_MODE = "incremental"
DEFAULT_CAP = 10
RANK_WEIGHT, FREQUENCY_WEIGHT, HOTNESS_WEIGHT = 0.6, 0.3, 0.1
HOTNESS_RANK = 10
HOT_APPEARANCES = 3
NEAR_DUP_THRESHOLD = 0.8
BLEND_JACCARD, BLEND_LEVENSHTEIN = 0.6, 0.4
LENGTH_GUARD = 0.6
TRIAGE_THRESHOLD = 0.1
TRIAGE_CONTEXT = 50
HISTORY_DAYS = 7
HOLIDAY_HOURS = (10, 12, 16, 20)
LOCAL_TZ = "Asia/Shanghai"  # UTC+8, no DST
# channel -> (byte limit, rule line above the part footer, markdown stripped)
CHANNELS = (
    ("feishu", 30000, True, False),
    ("dingtalk", 20000, False, False),
    ("wework", 4000, False, False),
    ("telegram", 4000, False, False),
)
# retention in days per stored table
RETENTION_DAYS = {
    "report": 7,
    "push_log": 7,
    "history_store": 30,
    "history_live": 7,
    "token_log": 30,
    "translations": 30,
    "calendar": 1,
}
# Mode display labels.
MODE_LABELS = {"daily": "当日汇总", "current": "当前榜单", "incremental": "增量监控"}
# Client filter word lists (access-log predicate P31).
UA_ALLOW = ("chrome", "firefox", "safari", "edge")
UA_DENY = (
    "bot", "spider", "crawl", "scrapy", "python", "python-requests",
    "curl", "wget", "httpclient", "java", "php", "go-http-client",
    "libwww", "aiohttp", "axios", "node-fetch", "okhttp",
)

# Calendar used by the driver-table schedule gate (day, status): '1' holiday, '2' workday.
DRIVER_CALENDAR = (("2024-01-01", "1"), ("2024-01-06", "2"), ("2024-01-08", "1"), ("2024-01-20", "2"), ("2024-01-22", "1"))

# Rule text used by the driver-table queries (own rules, reference syntax).
DRIVER_RULES = "tion\nough\n@15\n\n+ein\nsch\nheit\nkeit\n\n+the\nthrea\nsher\n!http\n@5\n\n+eau\nment\nqueau\n\n+ñ"


# Rules that apply when no rule text is stored (own text).
DEFAULT_RULES = "ai\nmodel\n@15\n\nmarket\nbank\n\nclimate\nenergy\n\n+space\nlaunch\norbit"


@dataclass(frozen=True)
class EngineConfig:
    mode: str = DEFAULT_MODE
    platforms: tuple = ()  # registry: (platform id, display name or None), in display order
    sort_by_weight_first: bool = False
    default_cap: int = DEFAULT_CAP
    rank_weight: float = RANK_WEIGHT
    frequency_weight: float = FREQUENCY_WEIGHT
    hotness_weight: float = HOTNESS_WEIGHT
    hotness_rank: int = HOTNESS_RANK
    hot_appearances: int = HOT_APPEARANCES
    near_dup_threshold: float = NEAR_DUP_THRESHOLD
    blend_jaccard: float = BLEND_JACCARD
    blend_levenshtein: float = BLEND_LEVENSHTEIN
    length_guard: float = LENGTH_GUARD
    triage_threshold: float = TRIAGE_THRESHOLD
    triage_context: int = TRIAGE_CONTEXT
    history_days: int = HISTORY_DAYS
    holiday_hours: tuple = HOLIDAY_HOURS
    local_tz: str = LOCAL_TZ
    channels: tuple = CHANNELS
    rules_text: str = DRIVER_RULES
    token_mode: str = "reference"  # 'reference' (key runs) or 'word' (title runs)
    notification: bool = True
    reviewer: bool = False
    retention_days: dict = field(default_factory=lambda: dict(RETENTION_DAYS))


DRIVER_CONFIG = EngineConfig(token_mode="word")
