"""Variable lists and rule tables the results depend on."""

YEAR = "YEAR"
HOUSEHOLD_KEYS = ["YEAR", "SERIAL"]
PERSON_KEYS = ["YEAR", "SERIAL", "PERNUM"]
REQUIRED_COLUMNS = ["YEAR", "SERIAL", "PERNUM"]

# Category variables that get a harmonised twin named <VARIABLE>_H.
HARMONIZE_VARS = [
    "URBAN", "OWNERSHIP", "ELECTRIC", "WATSUP", "SEWAGE", "WALL", "ROOF",
    "SEX", "MARST", "EDATTAIN", "CLASSWK",
]

CONTINUOUS_VARS = [
    "HHWT", "PERWT", "AUTOS", "MOTORCYCLE", "ROOMS", "BEDROOMS", "LIVEAREA",
    "NCHILD", "AGE", "CHBORN", "HOUSEHOLD_SIZE", "AREA_PER_PERSON",
]

CATEGORICAL_VARS = [
    "URBAN", "URBAN_H", "OWNERSHIP", "OWNERSHIP_H", "ELECTRIC", "ELECTRIC_H",
    "WATSUP", "WATSUP_H", "SEWAGE", "SEWAGE_H", "WALL", "WALL_H", "ROOF",
    "ROOF_H", "SEX", "SEX_H", "MARST", "MARST_H", "EDATTAIN", "EDATTAIN_H",
    "CLASSWK", "CLASSWK_H", "GEO1_VN", "wealth_class",
]

NUMERIC_VARS = [
    "YEAR", "HHWT", "PERWT", "AUTOS", "MOTORCYCLE", "ROOMS", "BEDROOMS",
    "LIVEAREA", "NCHILD", "AGE", "CHBORN", "PERNUM",
]

# Columns a household takes from its members (first non-null value).
HOUSEHOLD_COLUMNS = [
    "HHWT", "URBAN", "URBAN_H", "GEO1_VN", "OWNERSHIP", "OWNERSHIP_H",
    "ELECTRIC", "ELECTRIC_H", "WATSUP", "WATSUP_H", "SEWAGE", "SEWAGE_H",
    "AUTOS", "MOTORCYCLE", "ROOMS", "BEDROOMS", "WALL", "WALL_H", "ROOF",
    "ROOF_H", "LIVEAREA",
]

PERSON_COLUMNS = [
    "YEAR", "SERIAL", "PERNUM", "PERWT", "AGE", "SEX", "SEX_H", "MARST",
    "MARST_H", "CHBORN", "NCHILD", "EDATTAIN", "EDATTAIN_H", "CLASSWK",
    "CLASSWK_H", "URBAN", "URBAN_H", "GEO1_VN",
]

ASSET_VARS_BY_YEAR = {
    1989: ["LIVEAREA", "ELECTRIC_H", "WATSUP_H", "SEWAGE_H", "OWNERSHIP_H"],
    1999: ["LIVEAREA", "ELECTRIC_H", "WATSUP_H", "SEWAGE_H", "OWNERSHIP_H"],
    2009: ["MOTORCYCLE", "LIVEAREA", "ELECTRIC_H", "WATSUP_H", "AUTOS", "OWNERSHIP_H"],
    2019: ["MOTORCYCLE", "LIVEAREA", "ELECTRIC_H", "WATSUP_H", "SEWAGE_H", "AUTOS", "OWNERSHIP_H"],
}

HOUSING_VARS_BY_YEAR = {
    1989: ["ELECTRIC_H", "WATSUP_H", "SEWAGE_H", "LIVEAREA"],
    1999: ["ELECTRIC_H", "WATSUP_H", "SEWAGE_H", "LIVEAREA"],
    2009: ["ELECTRIC_H", "WATSUP_H", "LIVEAREA"],
    2019: ["ELECTRIC_H", "WATSUP_H", "SEWAGE_H", "LIVEAREA"],
}

PROGRESS_VARS = ["ELECTRIC_H", "WATSUP_H", "URBAN_H"]
SUMMARY_VARS = [
    "YEAR", "HOUSEHOLD_SIZE", "LIVEAREA", "AREA_PER_PERSON", "ROOMS",
    "ROOMS_PER_PERSON", "wealth_index", "housing_quality_index",
]

MODEL_FEATURES = ["URBAN_H", "ELECTRIC_H", "WATSUP_H", "YEAR", "GEO1_VN"]
NETWORK_FEATURES = ["YEAR", "GEO1_VN", "URBAN_H", "ELECTRIC_H", "WATSUP_H", "wealth_class"]
NETWORK_TOP_REGIONS = 12
NETWORK_SCENARIOS = {
    "baseline": {},
    "urban_with_services": {"URBAN_H": "1", "ELECTRIC_H": "1", "WATSUP_H": "1"},
    "rural_without_services": {"URBAN_H": "0", "ELECTRIC_H": "0", "WATSUP_H": "0"},
}

ABLATION_SETS = {
    "assets_utilities_only": ["ELECTRIC_H", "WATSUP_H", "SEWAGE_H", "OWNERSHIP_H", "WALL_H", "ROOF_H"],
    "space_time_only": ["URBAN_H", "YEAR", "GEO1_VN"],
    "housing_density_only": ["HOUSEHOLD_SIZE", "AREA_PER_PERSON", "ROOMS_PER_PERSON"],
}

URBAN_LABELS = {"1": "Urban", "0": "Rural"}
SEED = 42

# (variable, year or ALL, missing codes)
MISSING_RULES = [
    ("ELECTRIC", "ALL", "99|999"),
    ("WATSUP", "ALL", "99|999"),
    ("SEWAGE", "ALL", "99|999"),
    ("EDATTAIN", "ALL", "99|999"),
    ("CLASSWK", "ALL", "99|999"),
    ("CHBORN", "ALL", "999|9999"),
    ("AUTOS", "ALL", "999"),
    ("MOTORCYCLE", "ALL", "999"),
    ("LIVEAREA", "ALL", "9999|99999"),
    ("ROOMS", "ALL", "999"),
    ("BEDROOMS", "ALL", "999"),
]

# (variable, year or ALL, original code, harmonised code, label)
HARMONIZATION_RULES = [
    ("URBAN", "ALL", "1", "1", "urban"),
    ("URBAN", "ALL", "2", "0", "rural"),
    ("ELECTRIC", "ALL", "1", "1", "yes"),
    ("ELECTRIC", "ALL", "2", "0", "no"),
    ("OWNERSHIP", "ALL", "1", "1", "owned"),
    ("OWNERSHIP", "ALL", "2", "2", "rented"),
    ("OWNERSHIP", "ALL", "3", "3", "other"),
]

# (variable, level, type, description, use in analysis)
VARIABLE_DICTIONARY = [
    ("YEAR", "both", "int", "survey year", 1),
    ("SERIAL", "household", "string", "household id", 1),
    ("PERNUM", "person", "int", "person number within household", 1),
    ("HHWT", "household", "float", "household weight", 1),
    ("PERWT", "person", "float", "person weight", 1),
    ("URBAN", "household", "category", "urban rural indicator", 1),
    ("GEO1_VN", "household", "category", "province or first admin division", 1),
    ("OWNERSHIP", "household", "category", "ownership", 1),
    ("OWNERSHIPD", "household", "category", "detailed ownership", 1),
    ("ELECTRIC", "household", "category", "electricity access", 1),
    ("WATSUP", "household", "category", "water supply", 1),
    ("SEWAGE", "household", "category", "sanitation", 1),
    ("FUELCOOK", "household", "category", "cooking fuel", 0),
    ("AUTOS", "household", "float", "number of cars", 1),
    ("MOTORCYCLE", "household", "float", "number of motorcycles", 1),
    ("ROOMS", "household", "float", "number of rooms", 1),
    ("BEDROOMS", "household", "float", "number of bedrooms", 1),
    ("WALL", "household", "category", "wall material", 1),
    ("ROOF", "household", "category", "roof material", 1),
    ("LIVEAREA", "household", "float", "living area", 1),
    ("NCHILD", "person", "float", "number of children in household", 0),
    ("AGE", "person", "float", "age", 1),
    ("SEX", "person", "category", "sex", 1),
    ("MARST", "person", "category", "marital status", 0),
    ("MARSTD", "person", "category", "detailed marital status", 0),
    ("CHBORN", "person", "float", "children ever born", 0),
    ("EDATTAIN", "person", "category", "education attainment", 1),
    ("EDATTAIND", "person", "category", "detailed education attainment", 0),
    ("CLASSWK", "person", "category", "class of worker", 1),
    ("CLASSWKD", "person", "category", "detailed class of worker", 0),
]
