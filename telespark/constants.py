"""The categories, thresholds and wording that results must agree on."""

# Category lists, in display order.
STATUS_CATEGORIES = ("ACTIVE", "LOW POWER", "OVERHEATING", "OFFLINE", "CHARGING", "DEAD")
ALERT_STATUSES = ("LOW POWER", "OVERHEATING", "OFFLINE", "CHARGING", "DEAD")
MISSION_TYPES = ("PATROL", "DELIVERY", "INSPECTION")
ORDERED_LIMIT = 5000
UNASSIGNABLE_STATUSES = ("DEAD", "CHARGING", "OVERHEATING", "STOPPED")

# Half-open buckets [low, high) with their labels.
BATTERY_BUCKETS = (
    (0, 20, "0-19%"),
    (20, 40, "20-39%"),
    (40, 60, "40-59%"),
    (60, 80, "60-79%"),
    (80, 101, "80-100%"),
)
TEMPERATURE_BUCKETS = (
    (0, 40, "0-39C"),
    (40, 55, "40-54C"),
    (55, 70, "55-69C"),
    (70, 85, "70-84C"),
    (85, 200, "85-95C+"),
)

# Freshness limits, in seconds.
STALE_STATUS_SECONDS = 60
STALE_ROBOT_SECONDS = 180

# Command lifecycle: allowed moves per state, and the states that end it.
COMMAND_MOVES = {
    "PENDING": ("DISPATCHED", "CANCELLED", "TIMEOUT"),
    "DISPATCHED": ("ACKNOWLEDGED", "FAILED", "CANCELLED", "TIMEOUT"),
    "ACKNOWLEDGED": ("EXECUTING", "FAILED", "TIMEOUT", "COMPLETED"),
    "EXECUTING": ("COMPLETED", "FAILED", "TIMEOUT"),
}
TERMINAL_STATES = ("COMPLETED", "FAILED", "TIMEOUT", "CANCELLED")

# Restricted circle: centre, radius that enters it, radius that leaves it, seconds between alerts.
FENCE_X, FENCE_Y = 15.0, 10.0
FENCE_ENTER, FENCE_EXIT = 5.0, 7.0
FENCE_COOLDOWN_SECONDS = 45
FENCE_MESSAGE = "Entered Restricted Zone!"

# Map projection: origin and degrees per metre.
MAP_LATITUDE, MAP_LONGITUDE, DEGREES_PER_METRE = 37.7749, -122.4194, 0.0001

# Charging is suspended at the first temperature and resumes at the second.
THERMAL_SUSPEND, THERMAL_RESUME = 80.0, 60.0

# Health score: weight of the mean component health, weight of the battery, degrees that cost nothing, cost per degree.
SCORE_HEALTH_WEIGHT, SCORE_BATTERY_WEIGHT, SCORE_FREE_DEGREES, SCORE_DEGREE_COST = 0.55, 0.30, 55.0, 1.1

# Health display: at most the first is bad, at most the second is a warning.
TONE_BAD, TONE_WARN = 60, 80

# Dead robots: battery at most, temperature at least, battery or motor health below.
DEAD_BATTERY, DEAD_TEMPERATURE, DEAD_HEALTH = 5.0, 95.0, 10.0

# Battery levels: low power, mission aborted, idle robot tops up, mission needs more than.
LOW_POWER_BATTERY, ABORT_BATTERY, TOP_UP_BATTERY, MISSION_BATTERY = 30.0, 25.0, 50.0, 20.0
NOT_LOW_POWER_STATUSES = ("CHARGING", "RETURNING_TO_CHARGE")

# Event wording: patterns of warnings and of good news, regardless of case.
WARN_PATTERN, GOOD_PATTERN = "(?i)restricted|zone", "(?i)completed"

# Test names left out of the throughput ranking.
UNRANKED_TESTS = ("WebSocket", "Verification")

# What a reading gets when it lacks the key altogether.
READING_DEFAULTS = {"robot_id": 0, "battery": 0.0, "temperature": 0.0, "speed": 0.0, "status": "UNKNOWN"}
