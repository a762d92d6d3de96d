"""Lookup tables, thresholds and category lists that results depend on."""

from __future__ import annotations

# --- fixed values: classification -------------------------------------------------
NOT_CLASSIFIED = 999
STATUSES = ("finished", "dnf", "disqualified", "dns")
POINTS = {1: 25, 2: 18, 3: 15, 4: 12, 5: 10, 6: 8, 7: 6, 8: 4, 9: 2, 10: 1}

# --- fixed values: rolling statistics ----------------------------------------------
FORM_WINDOW = 5
FEATURE_WINDOWS = (3, 5, 10)
MIN_STARTS = 3

# --- fixed values: championship ladder (points at least, place) ---------------------
LADDER = ((300, 1), (250, 2), (200, 3), (150, 4), (100, 5), (80, 6), (60, 7), (40, 8), (20, 9), (10, 10))

# --- fixed values: weather ----------------------------------------------------------
DEFAULT_WEATHER = {
    "temperature": 25.0,
    "humidity": 60.0,
    "pressure": 1013.25,
    "wind_speed": 5.0,
    "wind_direction": 180,
    "rainfall": False,
    "track_temp": 30.0,
}

# --- fixed values: one-hot categories -----------------------------------------------
CATEGORIES = {
    "constructor_id": (
        "mercedes", "red_bull", "ferrari", "mclaren", "alpine",
        "aston_martin", "williams", "alphatauri", "alfa", "haas",
    ),
    "circuit_id": (
        "bahrain", "saudi_arabia", "australia", "imola", "miami", "spain", "monaco", "azerbaijan",
        "canada", "britain", "austria", "france", "hungary", "belgium", "netherlands", "italy",
        "singapore", "japan", "qatar", "usa", "mexico", "brazil", "abu_dhabi",
    ),
    "weather_condition": ("dry", "wet", "mixed", "unknown"),
}

# --- fixed values: value ranges for min-max scaling ---------------------------------
RANGES = {
    "avg_finish_position": (1, 20),
    "avg_grid_position": (1, 20),
    "points_per_race": (0, 25),
    "podium_rate": (0, 1),
    "finish_rate": (0, 1),
    "dnf_rate": (0, 1),
    "recent_form": (0, 1),
    "constructor_performance": (0, 1),
    "qualifying_delta": (-1, 1),
    "track_experience": (0, 50),
    "championship_position": (1, 20),
    "temperature": (-10, 50),
    "humidity": (0, 100),
    "wind_speed": (0, 50),
}

# --- fixed values: product features (left, right, result) ---------------------------
INTERACTIONS = (
    ("recent_form", "constructor_performance", "form_constructor_interaction"),
    ("qualifying_delta", "track_experience", "qualifying_experience_interaction"),
    ("temperature", "rainfall", "weather_interaction"),
    ("grid_position", "recent_form", "grid_form_interaction"),
    ("constructor_performance", "track_experience", "constructor_experience_interaction"),
)

# --- fixed values: features raised to powers ----------------------------------------
POLYNOMIAL = (
    "recent_form", "constructor_performance", "qualifying_delta",
    "track_experience", "temperature", "humidity",
)

# --- fixed values: bin edges --------------------------------------------------------
BINS = {
    "recent_form": (0, 0.3, 0.6, 1.0),
    "track_experience": (0, 5, 15, 50),
    "championship_position": (1, 3, 10, 20),
    "temperature": (0, 15, 25, 50),
}

# --- fixed values: feature category weights -----------------------------------------
CATEGORY_WEIGHTS = {
    "recent_form": 0.25,
    "rolling_stats": 0.20,
    "track_specific": 0.15,
    "constructor": 0.15,
    "qualifying": 0.10,
    "weather": 0.08,
    "comparative": 0.05,
    "interaction": 0.02,
}

# --- fixed values: track characteristics by circuit id ------------------------------
TRACK_COLUMNS = (
    "overtaking_difficulty", "street_circuit", "elevation_change", "corner_count",
    "straight_length", "weather_sensitivity", "tire_degradation", "safety_car_probability",
)
TRACKS = {
    "monaco": (0.9, 1.0, 0.3, 19, 0.2, 0.8, 0.4, 0.7),
    "monza": (0.2, 0.0, 0.1, 11, 0.9, 0.3, 0.6, 0.3),
    "silverstone": (0.4, 0.0, 0.2, 18, 0.6, 0.9, 0.7, 0.2),
    "spa": (0.3, 0.0, 0.8, 19, 0.8, 0.9, 0.8, 0.4),
    "suzuka": (0.6, 0.0, 0.5, 18, 0.4, 0.7, 0.6, 0.3),
}
DEFAULT_TRACK = (0.5, 0.0, 0.3, 16, 0.5, 0.5, 0.6, 0.4)

# --- fixed values: overtaking difficulty by last word of the circuit name -----------
OVERTAKING_DIFFICULTY = {"Monaco": 0.9, "Silverstone": 0.3, "Monza": 0.2, "Spa": 0.4, "Suzuka": 0.6}
DEFAULT_DIFFICULTY = 0.5

# --- fixed values: circuit factors, matched by substring in this order --------------
# (name, overtaking, qualifying importance, reliability factor)
CIRCUIT_FACTORS = (
    ("Monaco", 0.1, 0.9, 0.8),
    ("Silverstone", 0.7, 0.6, 0.9),
    ("Monza", 0.8, 0.5, 0.85),
    ("Spa", 0.75, 0.55, 0.82),
    ("Suzuka", 0.4, 0.75, 0.88),
    ("Interlagos", 0.6, 0.65, 0.75),
    ("Singapore", 0.2, 0.85, 0.7),
    ("Default", 0.6, 0.65, 0.85),
)

# --- fixed values: team ratings (car, reliability, strategy) ------------------------
TEAMS = {
    "McLaren": (0.94, 0.91, 0.88),
    "Ferrari": (0.91, 0.85, 0.82),
    "Red Bull Racing": (0.89, 0.93, 0.95),
    "Mercedes": (0.86, 0.89, 0.90),
    "Aston Martin": (0.72, 0.78, 0.75),
    "RB": (0.68, 0.82, 0.73),
    "Haas": (0.66, 0.76, 0.70),
    "Alpine": (0.65, 0.74, 0.68),
    "Williams": (0.58, 0.71, 0.65),
    "Kick Sauber": (0.52, 0.68, 0.60),
}
DEFAULT_TEAM = (0.60, 0.75, 0.70)

# --- fixed values: driver ratings (id, name, team, average finish, skill, consistency, wet skill);
# points and wins of the new season are zero for every driver ------------------------
DRIVERS = (
    ("VER", "Max Verstappen", "Red Bull Racing", 2.1, 0.98, 0.95, 0.96),
    ("LAW", "Liam Lawson", "Red Bull Racing", 12.0, 0.78, 0.75, 0.76),
    ("HAM", "Lewis Hamilton", "Ferrari", 4.5, 0.95, 0.88, 0.98),
    ("LEC", "Charles Leclerc", "Ferrari", 4.8, 0.94, 0.82, 0.90),
    ("RUS", "George Russell", "Mercedes", 7.2, 0.86, 0.81, 0.83),
    ("ANT", "Andrea Kimi Antonelli", "Mercedes", 10.0, 0.80, 0.72, 0.75),
    ("NOR", "Lando Norris", "McLaren", 4.2, 0.92, 0.88, 0.85),
    ("PIA", "Oscar Piastri", "McLaren", 5.6, 0.88, 0.86, 0.78),
    ("ALO", "Fernando Alonso", "Aston Martin", 10.2, 0.93, 0.89, 0.94),
    ("STR", "Lance Stroll", "Aston Martin", 12.8, 0.74, 0.71, 0.69),
    ("GAS", "Pierre Gasly", "Alpine", 12.4, 0.81, 0.78, 0.77),
    ("DOO", "Jack Doohan", "Alpine", 14.0, 0.76, 0.70, 0.72),
    ("TSU", "Yuki Tsunoda", "RB", 12.1, 0.79, 0.76, 0.74),
    ("HAD", "Isack Hadjar", "RB", 15.0, 0.75, 0.68, 0.70),
    ("HUL", "Nico Hülkenberg", "Haas", 11.8, 0.84, 0.86, 0.81),
    ("BEA", "Oliver Bearman", "Haas", 13.5, 0.76, 0.72, 0.70),
    ("ALB", "Alex Albon", "Williams", 16.8, 0.76, 0.72, 0.71),
    ("SAI", "Carlos Sainz", "Williams", 8.0, 0.89, 0.84, 0.87),
    ("BOT", "Valtteri Bottas", "Kick Sauber", 16.5, 0.82, 0.85, 0.80),
    ("ZHO", "Zhou Guanyu", "Kick Sauber", 17.9, 0.71, 0.66, 0.63),
)

# --- fixed values: confidence factors and their weights -----------------------------
CONFIDENCE_WEIGHTS = {
    "model_agreement": 0.3,
    "prediction_variance": 0.25,
    "historical_accuracy": 0.25,
    "data_quality": 0.2,
}

# Texts of insights, as printf patterns, messages of bad requests, and the reasons
# for which a driver is notable.
INSIGHT_TEXTS = {
    "winner": "%s has the highest probability of winning with a confidence score of %.3f. Expected to finish in position %d with %.1f championship points.",
    "surprise": "%s is predicted to %s their grid position significantly, moving from P%d to P%d.",
    "weather": "Wet conditions expected with %.1f%% humidity. This could significantly impact race dynamics and create opportunities for skilled wet-weather drivers.",
    "battle": "Extremely close battle predicted between %s (P%.1f) and %s (P%.1f). This could be decided by strategy or race incidents.",
    "championship": "This race could be crucial for the championship battle, with %s positioned to gain significant points.",
    "team_battle": "Close battle expected between teammates, with %s predicted P%d and %s predicted P%d.",
    "rookie_performance": "%s is predicted to deliver an outstanding performance, finishing P%d and potentially outperforming more experienced drivers.",
    "strategy": "Strategic pit timing could be crucial, with %s having a %.1f%% chance of overtaking %s.",
}
REQUEST_ERRORS = (
    "Race name is required", "Circuit selection is required", "At least one driver must be configured",
    "Duplicate grid positions detected", "Duplicate drivers detected", "Weather conditions must be specified",
)
NOTABLE_REASONS = ("High Confidence", "Podium Contender")
