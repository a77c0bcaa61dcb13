"""
Fixed values. Results depend on them, so they are stated here once, as plain
tables, patterns and thresholds, and passed around as default parameters.
"""

# --- listing table ----------------------------------------------------------

LISTING_COLUMNS = [
    "listing_id", "suburb", "postcode", "weekly_rent", "bond", "available_date",
    "date_listed", "days_listed", "bedrooms", "bathrooms", "carspaces",
    "property_type", "address", "lat", "lon", "primary_type",
    "structured_features", "url",
]
LISTING_NUMBERS = [
    "weekly_rent", "bond", "days_listed", "bedrooms", "bathrooms", "carspaces", "lat", "lon",
]
LISTING_DATES = ["date_listed"]

MASTER_CODES = [
    "listing_id", "postcode", "sa2_code_2021", "sa3_code_2021",
    "sa4_code_2021", "gccsa_code_2021", "sal_code_2021", "mb_code_2021",
]
MASTER_NUMBERS = [
    "weekly_rent", "bond", "bedrooms", "bathrooms", "carspaces",
    "days_listed", "lat", "lon", "land_m2",
]
MASTER_DATES = ["date_listed", "available_date"]

# Label text -> flag, matched on each lower-cased label.
LABEL_FLAGS = {
    "built_in_wardrobes": r"built.?in wardrobe",
    "heating": r"heating|fireplace|heater",
    "air_conditioning": r"air.?con|cooling",
    "dishwasher": r"dishwasher",
    "secure_parking": r"secure parking|garage|carport",
    "internal_laundry": r"internal laundry",
    "balcony": r"balcony|deck|terrace",
    "outdoor_space": r"garden|courtyard|outdoor entertain|fully fenced|backyard",
    "floorboards": r"floorboard|timber floor",
    "bath": r"^bath(?:tub)?$",
    "ensuite": r"ensuite",
    "study": r"study",
    "furnished": r"^(?:fully |partly |partially )?furnished",
    "pets_allowed": r"pets? allowed|pet friendly",
    "pool": r"swimming pool|^pool$|pool.?(?:in.?ground|above)",
    "gym": r"\bgym\b",
    "solar": r"solar",
    "security": r"intercom|alarm|security",
}

# --- weekly index -----------------------------------------------------------

INDEX_SERIES = ["houses_all", "houses_3", "units_all", "units_2", "combined"]
SERIES_BY_FINE_TYPE = {
    "House": "houses_all",
    "Acreage / Semi-Rural": "houses_all",
    "New House & Land": "houses_all",
    "Townhouse": "houses_all",
    "Semi-Detached": "houses_all",
    "Terrace": "houses_all",
    "Duplex": "houses_all",
    "Villa": "houses_all",
    "Farm": "houses_all",
    "Apartment / Unit / Flat": "units_all",
    "Studio": "units_all",
    "New Apartments / Off the Plan": "units_all",
    "Block of Units": "units_all",
}
SERIES_BY_COARSE_TYPE = {
    "House": "houses_all",
    "Townhouse/Villa": "houses_all",
    "Apartment": "units_all",
    "New Developments": "units_all",
}
INDEX_TOLERANCE_DAYS = 31
YEAR_LAG_DAYS = 364
YEAR_LAG_TOLERANCE_DAYS = 10

# --- incidents --------------------------------------------------------------

DIVISIONS = {
    "A": "person",
    "B": "property",
    "C": "drug",
    "D": "public_order",
    "E": "justice",
    "F": "other",
}
INCIDENT_TOLERANCE_DAYS = 370

# --- points, stops, lots ----------------------------------------------------

EARTH_RADIUS_KM = 6371.0088
CITY_CENTRE = (-37.8183, 144.9671)
COORDINATE_DECIMALS = 5
TRAIN_MODES = ["METRO TRAIN", "REGIONAL TRAIN"]
STOP_MODES = {"tram": ["METRO TRAM"], "bus": ["METRO BUS", "REGIONAL BUS"]}
STATION_NAME = r"^(.*?)\s+(?:Railway\s+)?Station(?:\s*\(.*\))?$"
SAME_STOP_KM = 0.25
SAME_LOT_TOLERANCE = 0.01
ROUTE_CANDIDATES = 3
EMBEDDED_SERIES = r'(?s)(\[\{"date":.*?\}\])'

# --- area sources -----------------------------------------------------------

INCOME_MEASURES = {
    "earners": "income_earners",
    "median age": "income_earners_median_age",
    "sum": "income_sum",
    "median": "income_median",
    "mean": "income_mean",
}
MATCH_RATE_GATE = 0.90

# --- target-derived columns -------------------------------------------------

TARGET = "weekly_rent"
BOND_WEEKS = (2, 8)
TARGET_DERIVED = [
    "bond", "rent_per_bedroom", "rent_vs_2021_census_median",
    "rent_vs_sqm_market", "rent_to_area_median_hh_income_pct",
]

# --- cleaning ---------------------------------------------------------------

RENT_SENTINELS = [0]
RENT_TOO_HIGH = 20000
RENT_TOO_LOW = 80.0
RENT_FLAG_HIGH = 3000.0
OTHER_CATEGORIES = ["Car Space", "Vacant land", "Block of Units"]
ROOM_RENT_MIN = 80.0
ROOM_BEDROOMS_MIN = 4
MAX_BEDROOMS = 12
MAX_BATHROOMS = 8
BATHROOM_EXCESS = 2
MAX_CARSPACES = 12
MAX_AGE_DAYS = 365
DUPLICATE_KEY = ["address_key", "postcode", "bedrooms", "bathrooms"]
LAT_RANGE = (-39.25, -33.95)
LON_RANGE = (140.90, 150.05)
FILL_ZERO = ["carspaces"]
MISSING_INDICATORS = ["carspaces", "land_m2", "bedrooms", "bathrooms"]
STREET_WORDS = {
    "AVE": "AVENUE", "ST": "STREET", "RD": "ROAD", "DR": "DRIVE", "CT": "COURT",
    "CRT": "COURT", "PL": "PLACE", "CRES": "CRESCENT", "PDE": "PARADE",
}
RENT_RANGE_MODELS = (100, 5000)

# --- column roles -----------------------------------------------------------

ROLES = {
    "computed from the target": [
        "bond", "rent_per_bedroom", "rent_vs_2021_census_median",
        "rent_vs_sqm_market", "rent_to_area_median_hh_income_pct", "rent_outlier_high",
    ],
    "names a row or a place": [
        "listing_id", "url", "address", "address_key", "sa2_code_2021", "sa3_code_2021",
        "sa4_code_2021", "gccsa_code_2021", "sal_code_2021", "mb_code_2021", "postcode",
    ],
    "place name; the area measures stand for it": [
        "sa2_name_2021", "sa3_name_2021", "sa4_name_2021", "gccsa_name_2021",
        "sal_name_2021", "suburb",
    ],
    "not known when the price is set": [
        "days_listed", "date_listed", "available_date",
    ],
    "label text; its flags are kept": ["structured_features"],
    "repeats property_type": ["secondary_type"],
}
CATEGORICAL = ["property_type", "primary_type"]
CORRELATION_LIMIT = 0.95
PREFERRED = [
    r"_aus_percentile$", r"erp_2025$", r"_2022_23$", r"^census_",
    r"^vif_population_growth", r"^population_growth",
]
REJECT_PATTERNS = {
    r"_aus_decile$": "the percentile says the same, finer",
    r"^(?:irsad|irsd|ier|ieo)_score$":
        "the percentile says the same on a known scale",
}
VINTAGE_STEMS = [
    "tax_income_earners", "tax_median_total_personal_income",
    "tax_mean_total_personal_income", "erp",
]
VINTAGE_SUFFIX = r"_(\d{4})(?:_(\d{2}))?$"

# --- growth forecast --------------------------------------------------------

TREND_YEARS = 3
TREND_MIN_MONTHS = 30
TREND_MIN_DISTINCT = 0.4
TREND_MAX_GROWTH = 20.0
YEARLY_TREND_YEARS = 5
YEARLY_TREND_MIN_POINTS = 3
MIN_TRAIN_COVERAGE = 0.5
RANKING_MIN_DWELLINGS = 200
AREA_FEATURES = [
    "irsad_score", "irsd_score", "ier_score", "ieo_score",
    "census_median_household_income_weekly", "census_median_rent_weekly",
    "population_density_2025", "erp_2025",
    "vif_population_growth_pct_2026_31",
    "age_25_44_pct", "born_overseas_pct",
    "school_count", "train_station_count", "tram_stop_count", "bus_stop_count",
]
HISTORY_FEATURES = ["erp_cagr_pct", "income_median_cagr_pct"]
INCIDENT_FEATURES = [
    "crime_suburb_rate_per_1k", "crime_suburb_rate_yoy_pct",
    "crime_suburb_rate_3yr_change_pct",
]

# --- models -----------------------------------------------------------------

# Feature sets of the model comparison; columns a table lacks are skipped.
PLACE_FEATURES = [
    "lat", "lon", "area_albers_sqkm", "nearest_school_km", "nearest_train_station_km",
    "nearest_bar_pub_km", "nearest_cafe_km", "nearest_childcare_km", "nearest_gp_clinic_km",
    "nearest_gym_km", "nearest_hospital_km", "nearest_library_km", "nearest_park_km",
    "nearest_restaurant_km", "nearest_shopping_centre_km", "nearest_supermarket_km", "bedrooms",
    "bathrooms", "carspaces", "school_count", "train_station_count", "osm_cafe_count",
    "osm_childcare_count", "osm_gp_clinic_count", "osm_gym_count", "osm_hospital_count",
    "osm_library_count", "osm_park_count", "osm_restaurant_count", "osm_shopping_centre_count",
    "osm_supermarket_count",
]
SOCIOECONOMIC_FEATURES = [
    "census_median_age", "census_population_2021", "census_median_personal_income_weekly",
    "census_median_household_income_weekly", "census_median_rent_weekly",
    "census_median_mortgage_monthly", "census_avg_household_size", "age_0_14_pct", "age_25_44_pct",
    "age_65_plus_pct", "born_overseas_pct", "non_english_home_pct", "irsad_score", "irsd_score",
    "ieo_score", "ier_score", "population_density_2025", "population_growth_pct_2024_25", "erp_2024",
    "erp_2025", "tax_income_earners_2022_23", "tax_median_total_personal_income_2022_23",
    "tax_mean_total_personal_income_2022_23", "vif_population_2021", "vif_population_2026",
    "vif_population_2031", "vif_population_2036", "vif_population_growth_pct_2021_26",
    "vif_population_growth_pct_2026_36",
]
OTHER_FEATURES = ["days_listed"]

BAD_LISTINGS = ["17727626", "17721987", "17722092", "17727546"]
RIDGE_ALPHAS = (-3.0, 4.0, 150)  # log10 of the ends, number of points

# --- stacked model ----------------------------------------------------------

STACK_INTERNAL = [
    "bedrooms", "bathrooms", "carspaces", "property_type", "carspaces_missing", "bedrooms_missing",
    "bathrooms_missing", "listed_month", "available_month",
]
STACK_CATEGORIES = [
    "suburb", "postcode", "property_type", "listed_month", "available_month", "sa2_name_2021",
    "sa3_name_2021", "sa4_name_2021", "gccsa_name_2021",
]
STACK_IDENTIFIERS = ["listing_id", "sa2_code_2021", "sa3_code_2021", "sa4_code_2021", "gccsa_code_2021"]
STACK_NOT_USED = [
    "address", "address_key", "lat", "lon", "primary_type", "secondary_type", "structured_features", "url",
    "irsad_score", "irsd_score", "ier_score", "ieo_score", "ieo_aus_decile", "irsd_aus_decile",
    "irsad_aus_decile", "ier_aus_decile", "rent_outlier_high",
]
