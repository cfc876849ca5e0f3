"""Parameters of the analytics. Everything here is a default argument somewhere."""

# --- fixed values: lattice ---------------------------------------------------
LAT_MIN, LAT_MAX = 11.50, 18.50
LON_MIN, LON_MAX = 74.00, 78.60
NODES_PER_DEG_LAT = 111
NODES_PER_DEG_LON = 107
N_LAT = 777
N_LON = 493
EARTH_RADIUS_KM = 6371.0
MIN_CASES_PER_CELL = 5

# --- fixed values: time and features ----------------------------------------
NEAR_RADII_KM = (0.5, 1.0, 2.0, 5.0)
NEAR_WINDOWS_DAYS = (1, 3, 7, 14, 30)
DECAY_HALFLIFE_DAYS = 14
NEGATIVE_SAMPLE_RATE = 0.1

# --- fixed values: series ----------------------------------------------------
ANOMALY_Z = 3.0
ROLLING_POINTS = 30
SEASON_DAYS = 7
FEED_BUCKET_DAYS = 3
FEED_SIZE = 20

# --- fixed values: graph -----------------------------------------------------
MAX_ENTITIES_PER_CASE = 10
TOP_REMOVALS = 50
REMOVAL_STEPS = (1, 5, 10, 20, 30, 40, 50)
MIN_COMMUNITY = 6
TOP_COMMUNITIES = 24
COMMUNITY_CORE = 22
EXPORT_NODES = 500

# --- fixed values: ranking and coverage -------------------------------------
AREA_PCTS = (1, 2, 5, 10, 20)
PATROL_RADIUS_KM = 2.0
DEFAULT_UNITS = 6
SCENARIOS = (4, 6, 8, 10)
CORE_GUARD_KM = 60.0
CORE_GUARD_MIN_CELLS = 20
RANDOM_TRIALS = 20
BRIEFING_DAYS = 30

# --- fixed values: units without a territory --------------------------------
NON_TERRITORIAL: tuple[str, ...] = ()

# --- fixed values: text shown for model features ----------------------------
FEATURE_TITLES = {
    "hist_total": "Historical crime volume",
    "day_of_year": "Seasonality (day of year)",
    "is_night_shift": "Night shift (22:00–06:00)",
    "is_morning_shift": "Morning shift (06:00–14:00)",
    "is_weekend": "Weekend",
    "hour_cos": "Time-of-day cycle",
    "hour_sin": "Time-of-day cycle",
    "hour_proxy": "Shift midpoint hour",
    "dow": "Day of week",
    "dow_sin": "Day-of-week cycle",
    "dow_cos": "Day-of-week cycle",
    "month_sin": "Seasonal cycle",
    "month_cos": "Seasonal cycle",
    "crime_entropy": "Crime-type diversity of area",
    "hist_heinous_pct": "Heinous-crime share of area",
    "hist_violent_pct": "Violent-crime share of area",
    "hist_property_pct": "Property-crime share of area",
    "n_crime_types": "Distinct crime types in area",
    "n_officers": "Officer deployment level",
}
NEAR_FEATURE_PATTERN = r"^nr_([\d.]+)km_(\d+)d$"
