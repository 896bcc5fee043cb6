"""Fixed values of the engine.  Every operator takes them as default arguments."""

# Calendar ranges, as days back from today.
DAYS_BACK = {"today": 0, "month": 29}
DAYS_BACK_DEFAULT = 6  # "week" and any unknown range name

# Usage report.
RECENT_SECS = 600
TOP_PROJECTS = 8
OTHER_PROJECT = "__other__"

# Quota status, history and projection.
NEAR_PCT = 75.0
LOCKED_PCT = 100.0
HISTORY_SECS = 900
HISTORY_ROWS = 60
RETAIN_SECS = 35 * 86_400
RETAIN_RESETS = 5
LANDING_SECS = 300
LANDING_DELTA = 0.5
MIN_SAMPLES = 3
IDLE_SLOPE = 1e-5
DEFICIT_EPS = 1.0
CYCLE_BUCKETS = 48
MIN_CYCLES = 2
CYCLE_COMPLETE = 0.8
CYCLE_HIGH = 20.0
CYCLE_LOW = 5.0
RUNWAY_STEPS = 240

# Worst-limit choice and alerts.
HYSTERESIS_PCT = 5.0
DWELL_SECS = 45
STALE_SECS = 900
WARN_PCT = 75.0
CRIT_PCT = 90.0
ALERT_SECS = 1_800
SOURCE_FAIL_SECS = 21_600

# Names.
AGENTS = {"claude": "Claude Code", "codex": "Codex CLI", "grok": "Grok CLI"}
PROVIDER_OF_SOURCE = {"claude": "anthropic", "codex": "codex", "grok": "grok"}
CODEX_MODEL = "gpt-5-codex"
DEFAULT_CLAUDE_MODEL = "claude"
DEFAULT_GROK_MODEL = "grok"

# Seconds of one chunk of a long ordered series.  A chunk is the unit one task works on.
CHUNK_SECS = 86_400
