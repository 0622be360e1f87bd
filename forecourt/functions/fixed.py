"""Word lists, patterns, ranges and key tables the results depend on.

Nothing here is logic. Every value must stay as it is for results to agree with the listings and
specification pages the engine is used on.
"""

from __future__ import annotations

# --- Listing text: patterns per field, tried in order; the longest valid match wins. Fixed values. ---
PRICE_PATTERNS = [
    r"(\d+(?:[\s,\.]\d+)*)\s*(лв|€|\$|USD|EUR|BGN|лева|евро|долара)",
    r"(\d+(?:[\s,\.]\d+)*)\s*(лв|€|\$)",
    r"(\d+(?:,\d+)?)\s*(лв|€|\$)",
    r"(\d+(?:\.\d+)?)\s*(лв|€|\$)",
]
YEAR_PATTERNS = [r"(20\d{2})", r"(19\d{2})", r"(\d{4})\s*г\.", r"(\d{4})\s*год"]
MILEAGE_PATTERNS = [
    r"(\d+(?:[\s,\.]\d+)*)\s*км",
    r"(\d+(?:[\s,\.]\d+)*)\s*mile",
    r"(\d+(?:[\s,\.]\d+)*)\s*km",
    r"(\d+(?:,\d+)?)\s*км",
    r"(\d+(?:\.\d+)?)\s*км",
]
ENGINE_POWER_PATTERNS = [
    r"(\d+)\s*к\.с\.",
    r"(\d+)\s*hp",
    r"(\d+)\s*PS",
    r"(\d+)\s*horsepower",
    r"(\d+)\s*к\.с",
]
ENGINE_DISPLACEMENT_PATTERNS = [
    r"(\d+)\s*куб\.см",
    r"(\d+(?:\.\d+)?)\s*L",
    r"(\d+(?:\.\d+)?)\s*л",
    r"(\d+(?:\.\d+)?)\s*liter",
]
FUEL_TYPE_PATTERNS = [
    r"(Бензинов|Дизел|Хибрид|Електрически)",
    r"(Gasoline|Diesel|Hybrid|Electric)",
    r"(Benzin|Diesel|Hybrid|Elektro)",
    r"(Essence|Diesel|Hybride|Électrique)",
]
TRANSMISSION_PATTERNS = [
    r"(Автоматична|Ръчна)",
    r"(Automatic|Manual)",
    r"(Automatik|Schaltgetriebe)",
    r"(Automatique|Manuelle)",
]
BODY_TYPE_PATTERNS = [
    r"(Седан|Купе|Кабрио|Хечбек|СУВ|Пикап)",
    r"(Sedan|Coupe|Convertible|Hatchback|SUV|Pickup)",
    r"(Limousine|Coupé|Cabrio|Kombi|SUV)",
]
COLOR_PATTERNS = [
    r"(Черен|Бял|Син|Червен|Сребърен|Сив|Зелен|Жълт)",
    r"(Black|White|Blue|Red|Silver|Gray|Green|Yellow)",
    r"(Schwarz|Weiß|Blau|Rot|Silber|Grau|Grün|Gelb)",
    r"(Noir|Blanc|Bleu|Rouge|Argent|Gris|Vert|Jaune)",
]
LOCATION_PATTERNS = [
    r"гр\.\s*([^,\n]+)",
    r"(София|Пловдив|Варна|Бургас|Русе|Стара Загора|Плевен)",
    r"(Sofia|Plovdiv|Varna|Burgas|Ruse)",
]
CURRENCY_PATTERN = r"(лв|€|\$|USD|EUR|BGN)"
DEFAULT_CURRENCY = "лв"

# Valid ranges, both ends included. Fixed values.
PRICE_RANGE = (1000, 1000000)
YEAR_RANGE = (1990, 2030)
MILEAGE_RANGE = (0, 1000000)
ENGINE_POWER_RANGE = (50, 2000)
ENGINE_DISPLACEMENT_RANGE = (0.5, 10.0)

# --- The older single-site profile: first valid match in order. Fixed values. ---
SITE_PRICE_PATTERNS = [
    r"(\d+(?:\s+\d+)*)\s*(лв|€|\$)",
    r"(\d+(?:\.\d+)?)\s*(лв|€|\$)",
    r"(\d+(?:,\d+)?)\s*(лв|€|\$)",
]
SITE_MILEAGE_PATTERNS = [r"(\d+(?:\s+\d+)*)\s*км", r"(\d+(?:\.\d+)?)\s*км", r"(\d+(?:,\d+)?)\s*км"]
SITE_PRICE_RANGE = (10000, 500000)
SITE_MILEAGE_RANGE = (0, 500000)
SITE_FIRST_YEAR = 2019
SITE_YEAR_PATTERN = r"(20\d{2})"
SITE_CITY_PATTERN = r"(София|Пловдив|Варна|Бургас|Русе|Стара Загора|Плевен)"
SITE_FUEL_WORDS = ["Бензинов", "Дизел", "Хибрид", "Електрически"]
SITE_TRANSMISSION_WORDS = ["Автоматична", "Ръчна"]
SITE_BODY_WORDS = ["Седан", "Купе", "Кабрио"]
SITE_COLOR_WORDS = ["Черен", "Бял", "Син", "Червен", "Сребърен", "Сив"]
SITE_POWER_PATTERN = r"(\d+)\s*к\.с\."
SITE_DISPLACEMENT_PATTERN = r"(\d+)\s*куб\.см"
SITE_DEALER_PATTERNS = [r"Дилър:\s*([^,\n]+)", r"Автокъща:\s*([^,\n]+)", r"Търговец:\s*([^,\n]+)"]
SITE_PRIVATE_PATTERN = r"частно лице|частен|собствен"
SITE_AD_NUMBER_PATTERN = r"(\d{8,})"
SITE_NAME = "mobile.bg"
SITE_BASE_URL = "https://www.mobile.bg"
SITE_ID_PREFIX = "mobile_bg"

# --- Image addresses. Fixed values. ---
NOT_CAR_IMAGE_WORDS = [
    "logo", "icon", "nophoto", "placeholder", "banner", "advertisement",
    "social", "facebook", "twitter", "instagram", "youtube", "google",
    "analytics", "tracking", "pixel", "beacon",
]
CAR_IMAGE_WORDS = [
    "photo", "image", "car", "auto", "vehicle", "mobile.bg",
    "focus.bg", "picturess", "photosorg",
]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp"]
DOWNLOAD_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]

# --- Anomaly rules. Fixed values. ---
SUSPICIOUS_DEALER_WORDS = ["test", "demo", "fake", "scam", "fraud"]
SUSPICIOUS_TEXT_WORDS = [
    "urgent", "quick sale", "must sell", "cash only",
    "no questions", "as is", "no warranty", "final price",
]
REFERENCE_YEAR = 2024
KM_PER_YEAR = 15000

# --- Market report labels and texts. Fixed values. ---
MILEAGE_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]
HIGH_MILEAGE_FACTOR = "High mileage reduces value"
ADVICE_VOLATILE = "High price volatility - good time for negotiations"
ADVICE_OLDER = "Consider older models for better value"
ADVICE_LOW_MILEAGE = "Low mileage cars offer good value"

# --- Specification keys -> column, for the older key table. Fixed values. ---
LEGACY_SPEC_KEYS = {
    "cylinders": "cylinders",
    "displacement": "displacement",
    "power": "horsepower",
    "torque": "torque",
    "fuel_system": "fuel_type",
    "fuel": "fuel_type",
    "fuel_type": "fuel_type",
    "fuel_tank_capacity": "fuel_capacity",
    "fuel_capacity": "fuel_capacity",
    "top_speed": "top_speed",
    "maximum_speed": "top_speed",
    "acceleration_0-62_mph_(0-100_km/h)": "acceleration_0_100",
    "acceleration_0-100_km/h_(0-62_mph)": "acceleration_0_100",
    "0-100_km/h": "acceleration_0_100",
    "drive_train": "drive_type",
    "drivetrain": "drive_type",
    "drive_type": "drive_type",
    "transmission": "transmission",
    "gearbox": "transmission",
    "front_brakes": "brake_type_front",
    "rear_brakes": "brake_type_rear",
    "brakes_front": "brake_type_front",
    "brakes_rear": "brake_type_rear",
    "tire_size_front": "tire_size_front",
    "tire_size_rear": "tire_size_rear",
    "front_tire": "tire_size_front",
    "rear_tire": "tire_size_rear",
    "length": "length_mm",
    "width": "width_mm",
    "height": "height_mm",
    "wheelbase": "wheelbase_mm",
    "ground_clearance": "ground_clearance_mm",
    "min._ground_clearance": "ground_clearance_mm",
    "unladen_weight": "unladen_weight_kg",
    "kerb_weight": "unladen_weight_kg",
    "curb_weight": "unladen_weight_kg",
    "weight": "unladen_weight_kg",
    "gross_weight": "gross_weight_kg",
    "max._weight": "gross_weight_kg",
    "cargo_volume": "cargo_volume_l",
    "trunk_volume": "cargo_volume_l",
    "boot_space": "cargo_volume_l",
    "drag_coefficient": "aerodynamics_cd",
    "cd": "aerodynamics_cd",
    "aerodynamic_drag_coefficient": "aerodynamics_cd",
    "turning_radius": "turning_circle_m",
    "turning_circle": "turning_circle_m",
    "turning_diameter": "turning_circle_m",
    "fuel_consumption_(economy)_-_urban": "fuel_economy_city",
    "fuel_consumption_-_city": "fuel_economy_city",
    "city_fuel_consumption": "fuel_economy_city",
    "fuel_consumption_(economy)_-_extra_urban": "fuel_economy_highway",
    "fuel_consumption_-_highway": "fuel_economy_highway",
    "highway_fuel_consumption": "fuel_economy_highway",
    "fuel_consumption_(economy)_-_combined": "fuel_economy_combined",
    "fuel_consumption_-_combined": "fuel_economy_combined",
    "combined_fuel_consumption": "fuel_economy_combined",
    "co2_emissions": "co2_emissions_g_km",
    "co2": "co2_emissions_g_km",
    "emissions": "co2_emissions_g_km",
}
LEGACY_INT_COLUMNS = [
    "displacement", "top_speed", "length_mm", "width_mm", "height_mm", "wheelbase_mm",
    "ground_clearance_mm", "unladen_weight_kg", "gross_weight_kg", "cargo_volume_l",
    "co2_emissions_g_km",
]
LEGACY_FLOAT_COLUMNS = [
    "acceleration_0_100", "fuel_capacity", "aerodynamics_cd", "turning_circle_m",
    "fuel_economy_city", "fuel_economy_highway", "fuel_economy_combined",
]
LEGACY_TEXT_COLUMNS = [
    "cylinders", "fuel_type", "drive_type", "transmission", "brake_type_front",
    "brake_type_rear", "tire_size_front", "tire_size_rear",
]

# --- Specification pages: which blocks and containers are read. Fixed values. ---
SPEC_TABLE_CLASSES = ["techdata", "specs"]
SPEC_BLOCK_CLASSES = ["specs-block", "engine-data", "car-specs", "performance-specs"]
SPEC_DIV_CLASSES = ["enginedata"]
FEATURE_CONTAINERS = [
    ("div", "infotainment"), ("ul", "features"), (None, "highlight-features"),
    (None, "key-features"), ("div", "features-list"), ("ul", "equipment"),
]
GALLERY_CONTAINERS = [
    (None, "spec-image"), (None, "car-gallery"), (None, "photo-gallery"), ("div", "images"),
]
GALLERY_ALT_WORD = "bmw"
INFOTAINMENT_ALT_WORDS = ["carplay", "android auto", "bluetooth"]
INFOTAINMENT_CLASS = "infotainment-icon"
INFOTAINMENT_DATA_WORDS = ["carplay", "android"]
CATALOG_BASE_URL = "https://www.autoevolution.com"
MPH_PER_KPH = 0.621371

# --- HSV ranges (H 0-179, S and V 0-255), both ends included, in tie-break order. Fixed values. ---
SCAN_COLOR_RANGES = [
    ("black", (0, 0, 0), (179, 60, 70)),
    ("white", (0, 0, 200), (179, 40, 255)),
    ("gray", (0, 0, 70), (179, 40, 200)),
    ("red", (0, 80, 80), (10, 255, 255)),
    ("red2", (170, 80, 80), (179, 255, 255)),
    ("blue", (100, 80, 80), (130, 255, 255)),
    ("green", (40, 80, 80), (80, 255, 255)),
    ("yellow", (20, 80, 80), (35, 255, 255)),
    ("brown", (10, 80, 40), (20, 255, 180)),
    ("silver", (0, 0, 140), (179, 30, 230)),
]
FEATURE_COLOR_RANGES = [
    ("black", (0, 0, 0), (180, 255, 50)),
    ("white", (0, 0, 200), (180, 30, 255)),
    ("red", (0, 50, 50), (10, 255, 255)),
    ("blue", (100, 50, 50), (130, 255, 255)),
    ("green", (40, 50, 50), (80, 255, 255)),
    ("yellow", (20, 50, 50), (40, 255, 255)),
    ("silver", (0, 0, 100), (180, 30, 200)),
]
RUST_RANGE = ((0, 50, 50), (20, 255, 255))

# --- Price model. Fixed values. ---
NUMERIC_FEATURES = ["year", "mileage", "engine_power", "engine_displacement"]
CATEGORY_FEATURES = ["fuel_type", "transmission", "body_type", "color", "dealer_type"]
NUMERIC_DEFAULTS = {"year": 2020.0, "mileage": 50000.0, "engine_power": 300.0, "engine_displacement": 3.0}
MISSING_CATEGORY = "unknown"
