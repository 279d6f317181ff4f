"""Default values of the library. Every operator takes them as parameters."""

from __future__ import annotations

# The reported numbers depend on them.
TIMEZONE = "Asia/Taipei"
PIPELINE_VERSION = "0.5.0"

MIN_GROUP_SIZE = 10
DOMINANT_THRESHOLD = 0.30
CONCENTRATION_DIMENSIONS = ("account_type", "degree", "entry_year", "dept_code", "client_type")
RATIO_SUFFIXES = ("_share", "_ratio", "_pct", "_rate")

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.99)

ERROR_STATUS_FLOOR = 400
WATCHED_STATUS = (429, 402, 403)

ANOMALY_ERROR_CODE = "context_length_exceeded"
ANOMALY_LEGACY_FAMILIES = ("gpt-4o-mini",)
ANOMALY_OFFPEAK_HOURS = (0, 1, 2, 3, 4, 5, 6, 7)
ANOMALY_DOMINANT = 0.80

LOG_LAG_EXPECTED_MS = -20_000
LOG_LAG_TOLERANCE_MS = 5_000

KNOWN_ENDPOINTS = (
    "/v1/responses",
    "/v1/chat/completions",
    "/v1/audio/speech",
    "/v1/audio/transcriptions",
    "/v1/images/generations",
    "/v1/images/edits",
)
KNOWN_PROVIDERS = ("openai", "ollama")
KNOWN_ORIGINATORS = (
    "",
    "Codex Desktop",
    "codex-tui",
    "codex_exec",
    "codex_vscode",
    "codex_work_desktop",
)
KNOWN_CLIENT_TYPES = ("codex", "direct")

REDACTED_PATHS = ("content", "response_summary.error.message", "request_options.text.format.schema")
SAMPLE_MAX_CHARS = 200
SAMPLE_TRUNCATE = 80
MAX_SAMPLES = 5

# Skew handling. A key with fewer rows than this is left to one task; above it the key is split.
HEAVY_ROWS = 2_000_000
# Pieces a heavy key is cut into along its ordering column.
HEAVY_SPLITS = 256
