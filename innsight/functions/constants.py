"""Fixed values of the pricing and signal formulas."""

# --- Fixed values: required for equal results -------------------------------

# Weather multiplier: 0.85 + 0.35 * weather
WEATHER_FLOOR = 0.85
WEATHER_SPAN = 0.35

# Demand multiplier: 0.75 + 0.65 * demand ^ 1.4
DEMAND_FLOOR = 0.75
DEMAND_SPAN = 0.65
DEMAND_EXPONENT = 1.4

# Demand multiplier of the price history: 0.75 + 0.6 * demand
HISTORY_DEMAND_SPAN = 0.6

# Scarcity multiplier: 1 + max(0, 1.8 * (0.3 - supply))
SCARCITY_START = 0.3
SCARCITY_SLOPE = 1.8

# Urgency bands, in days until check-in
LAST_MINUTE_DAYS = 2
WEEK_DAYS = 7
EARLY_BIRD_DAYS = 60
LAST_MINUTE_FACTOR = 1.25
WEEK_FACTOR = 1.10
EARLY_BIRD_FACTOR = 0.88

# Price tiers, on the base price
BUDGET_BELOW = 5000.0
MID_BELOW = 12000.0

# Great-circle distance
EARTH_RADIUS_KM = 6371.0

# Weather signal
SEASON_ZERO_MONTH = 3
TEMPERATURE_BASE = 20.0
TEMPERATURE_LATITUDE = 15.0
TEMPERATURE_SEASON = 10.0
TEMPERATURE_BEST = 30.0
RAIN_BASE = 0.4
RAIN_LATITUDE = 0.3
DRY_WEIGHT = 0.6
WARM_WEIGHT = 0.4
HUMIDITY_BASE = 40.0
HUMIDITY_RAIN = 40.0
CONDITIONS = ("Sunny", "Partly Cloudy", "Overcast", "Light Rain", "Clear Skies")
CONDITION_STEPS = 4

# Demand signal
DEMAND_BASE = 0.3
WEEKEND_UPLIFT = 0.3
WEEKEND_FROM = 4  # Friday, when Monday is 0
HIGH_SEASON_MONTHS = (6, 7, 8)
HIGH_SEASON_UPLIFT = 0.4
HOLIDAY_MONTHS = (12, 1)
HOLIDAY_UPLIFT = 0.35
LOW_SEASON_UPLIFT = 0.1

# Both signals are kept within these bounds
SIGNAL_MIN = 0.1
SIGNAL_MAX = 1.0

# Search defaults
SEARCH_LAT = 20.2961
SEARCH_LON = 85.8245
SEARCH_RADIUS_KM = 50.0
SEARCH_DAYS_AHEAD = 1
SEARCH_LIMIT = 20

# Other query defaults
FORECAST_DAYS = 30
DETAIL_REVIEWS = 5
MARKET_TOP = 5

# Price model
FEATURES = (
    "weather_score",
    "demand_score",
    "occupancy_normalized",
    "demand_weather_interaction",
    "star_rating",
)
LABEL = "price_ratio"
TREES = 50
TREE_DEPTH = 5
TRAIN_PERCENT = 80
SEED = 42
