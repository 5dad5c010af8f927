"""Reference data as plain values, and as small DataFrames for joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

# Regions with (short code, kind, latitude, longitude, theatre, baseline).
REGIONS = {
    "Gaza & Middle East": ("GZ", "conflict", 31.5, 34.5, "levant", 0.30),
    "Ukraine": ("UA", "conflict", 49.0, 32.0, "easteuro", 0.28),
    "Sudan": ("SD", "conflict", 15.0, 30.0, "hornafrica", 0.26),
    "South China Sea": ("SCS", "tension", 13.0, 114.0, "indo", 0.08),
    "Taiwan Strait": ("TW", "tension", 24.0, 121.0, "indo", 0.08),
    "Yemen": ("YE", "conflict", 15.5, 48.0, "levant", 0.22),
    "Sahel": ("SH", "conflict", 15.0, 0.0, "westafrica", 0.20),
    "Korean Peninsula": ("KR", "tension", 38.0, 127.0, "indo", 0.06),
    "Myanmar": ("MM", "conflict", 21.0, 96.0, "indo", 0.18),
    "DRC": ("CD", "conflict", -2.0, 23.0, "centafrica", 0.18),
    "Syria": ("SY", "conflict", 35.0, 38.0, "levant", 0.16),
    "Somalia": ("SO", "conflict", 6.0, 46.0, "hornafrica", 0.16),
    "Baltic": ("BLT", "tension", 58.0, 24.0, "easteuro", 0.06),
    "Haiti": ("HT", "conflict", 19.0, -72.0, "caribbean", 0.14),
    "Ethiopia": ("ET", "conflict", 9.0, 40.0, "hornafrica", 0.14),
    "South Caucasus": ("SC", "tension", 41.0, 45.0, "easteuro", 0.05),
    "Libya": ("LY", "conflict", 27.0, 17.0, "levant", 0.10),
    "Kosovo": ("KS", "tension", 42.5, 21.0, "easteuro", 0.04),
    "Arctic": ("AR", "tension", 78.0, 20.0, "arctic", 0.03),
    "Mozambique": ("MZ", "conflict", -15.0, 39.0, "centafrica", 0.12),
}
DEFAULT_BASELINE = 0.05

# Terms that name a region, in their order.
TERMS = {
    "palestine": "Gaza & Middle East",
    "palestinian": "Gaza & Middle East",
    "gaza": "Gaza & Middle East",
    "israel": "Gaza & Middle East",
    "israeli": "Gaza & Middle East",
    "west bank": "Gaza & Middle East",
    "jerusalem": "Gaza & Middle East",
    "idf": "Gaza & Middle East",
    "hamas": "Gaza & Middle East",
    "rafah": "Gaza & Middle East",
    "lebanon": "Gaza & Middle East",
    "lebanese": "Gaza & Middle East",
    "hezbollah": "Gaza & Middle East",
    "hizbollah": "Gaza & Middle East",
    "beirut": "Gaza & Middle East",
    "nabatieh": "Gaza & Middle East",
    "tyre": "Gaza & Middle East",
    "litani": "Gaza & Middle East",
    "iran": "Gaza & Middle East",
    "iranian": "Gaza & Middle East",
    "tehran": "Gaza & Middle East",
    "irgc": "Gaza & Middle East",
    "ukraine": "Ukraine",
    "ukrainian": "Ukraine",
    "kyiv": "Ukraine",
    "kiev": "Ukraine",
    "donetsk": "Ukraine",
    "kharkiv": "Ukraine",
    "zaporizhzhia": "Ukraine",
    "crimea": "Ukraine",
    "kherson": "Ukraine",
    "odesa": "Ukraine",
    "odessa": "Ukraine",
    "mykolaiv": "Ukraine",
    "sumy": "Ukraine",
    "lviv": "Ukraine",
    "dnipro": "Ukraine",
    "sudan": "Sudan",
    "sudanese": "Sudan",
    "khartoum": "Sudan",
    "darfur": "Sudan",
    "rsf": "Sudan",
    "el fasher": "Sudan",
    "south china sea": "South China Sea",
    "spratly": "South China Sea",
    "scarborough": "South China Sea",
    "philippine": "South China Sea",
    "philippines": "South China Sea",
    "manila": "South China Sea",
    "second thomas shoal": "South China Sea",
    "taiwan": "Taiwan Strait",
    "taipei": "Taiwan Strait",
    "taiwanese": "Taiwan Strait",
    "taiwan strait": "Taiwan Strait",
    "yemen": "Yemen",
    "yemeni": "Yemen",
    "houthi": "Yemen",
    "sanaa": "Yemen",
    "red sea": "Yemen",
    "hodeidah": "Yemen",
    "mali": "Sahel",
    "malian": "Sahel",
    "burkina faso": "Sahel",
    "niger": "Sahel",
    "sahel": "Sahel",
    "wagner": "Sahel",
    "bamako": "Sahel",
    "jnim": "Sahel",
    "north korea": "Korean Peninsula",
    "dprk": "Korean Peninsula",
    "pyongyang": "Korean Peninsula",
    "south korea": "Korean Peninsula",
    "seoul": "Korean Peninsula",
    "korean peninsula": "Korean Peninsula",
    "myanmar": "Myanmar",
    "burma": "Myanmar",
    "burmese": "Myanmar",
    "naypyidaw": "Myanmar",
    "rohingya": "Myanmar",
    "rakhine": "Myanmar",
    "democratic republic of congo": "DRC",
    "dr congo": "DRC",
    "drc": "DRC",
    "kivu": "DRC",
    "goma": "DRC",
    "m23": "DRC",
    "kinshasa": "DRC",
    "syria": "Syria",
    "syrian": "Syria",
    "damascus": "Syria",
    "aleppo": "Syria",
    "idlib": "Syria",
    "somalia": "Somalia",
    "somali": "Somalia",
    "mogadishu": "Somalia",
    "al-shabaab": "Somalia",
    "al shabaab": "Somalia",
    "haiti": "Haiti",
    "haitian": "Haiti",
    "port-au-prince": "Haiti",
    "ethiopia": "Ethiopia",
    "ethiopian": "Ethiopia",
    "addis ababa": "Ethiopia",
    "tigray": "Ethiopia",
    "amhara": "Ethiopia",
    "armenia": "South Caucasus",
    "armenian": "South Caucasus",
    "azerbaijan": "South Caucasus",
    "azerbaijani": "South Caucasus",
    "nagorno": "South Caucasus",
    "karabakh": "South Caucasus",
    "yerevan": "South Caucasus",
    "baku": "South Caucasus",
    "georgia": "South Caucasus",
    "libya": "Libya",
    "libyan": "Libya",
    "tripoli": "Libya",
    "benghazi": "Libya",
    "haftar": "Libya",
    "kosovo": "Kosovo",
    "pristina": "Kosovo",
    "kosovan": "Kosovo",
    "estonia": "Baltic",
    "latvia": "Baltic",
    "lithuania": "Baltic",
    "estonian": "Baltic",
    "latvian": "Baltic",
    "lithuanian": "Baltic",
    "kaliningrad": "Baltic",
    "suwalki": "Baltic",
    "baltic": "Baltic",
    "svalbard": "Arctic",
    "greenland": "Arctic",
    "arctic": "Arctic",
    "barents": "Arctic",
    "murmansk": "Arctic",
    "mozambique": "Mozambique",
    "cabo delgado": "Mozambique",
    "maputo": "Mozambique",
    "middle east": "Gaza & Middle East",
    "south caucasus": "South Caucasus",
}

# Aliases that the scraper's detector tests first, in their order.
ALIASES = {
    "palestine": "Gaza & Middle East",
    "gaza": "Gaza & Middle East",
    "israel": "Gaza & Middle East",
    "west bank": "Gaza & Middle East",
    "hezbollah": "Gaza & Middle East",
    "hamas": "Gaza & Middle East",
    "ukraine": "Ukraine",
    "kyiv": "Ukraine",
    "donbas": "Ukraine",
    "zelenskyy": "Ukraine",
    "sudan": "Sudan",
    "khartoum": "Sudan",
    "darfur": "Sudan",
    "taiwan": "Taiwan Strait",
    "yemen": "Yemen",
    "houthi": "Yemen",
    "mali": "Sahel",
    "burkina faso": "Sahel",
    "niger": "Sahel",
    "north korea": "Korean Peninsula",
    "dprk": "Korean Peninsula",
    "myanmar": "Myanmar",
    "burma": "Myanmar",
    "democratic republic of congo": "DRC",
    "dr congo": "DRC",
    "kivu": "DRC",
    "goma": "DRC",
    "syria": "Syria",
    "damascus": "Syria",
    "aleppo": "Syria",
    "somalia": "Somalia",
    "mogadishu": "Somalia",
    "al-shabaab": "Somalia",
    "haiti": "Haiti",
    "ethiopia": "Ethiopia",
    "tigray": "Ethiopia",
    "addis ababa": "Ethiopia",
    "armenia": "South Caucasus",
    "azerbaijan": "South Caucasus",
    "nagorno": "South Caucasus",
    "karabakh": "South Caucasus",
    "libya": "Libya",
    "tripoli": "Libya",
    "benghazi": "Libya",
    "kosovo": "Kosovo",
    "pristina": "Kosovo",
    "mozambique": "Mozambique",
    "cabo delgado": "Mozambique",
}

# Aliases that the detector with a country hint tests first, in their order.
STRICT_ALIASES = {
    "palestine": "Gaza & Middle East",
    "gaza": "Gaza & Middle East",
    "israel": "Gaza & Middle East",
    "west bank": "Gaza & Middle East",
    "ukraine": "Ukraine",
    "kyiv": "Ukraine",
    "sudan": "Sudan",
    "khartoum": "Sudan",
    "darfur": "Sudan",
    "taiwan": "Taiwan Strait",
    "yemen": "Yemen",
    "houthi": "Yemen",
    "mali": "Sahel",
    "burkina faso": "Sahel",
    "niger": "Sahel",
    "north korea": "Korean Peninsula",
    "dprk": "Korean Peninsula",
    "myanmar": "Myanmar",
    "burma": "Myanmar",
    "democratic republic of congo": "DRC",
    "drc": "DRC",
    "dr congo": "DRC",
    "kivu": "DRC",
    "goma": "DRC",
    "syria": "Syria",
    "damascus": "Syria",
    "aleppo": "Syria",
    "somalia": "Somalia",
    "mogadishu": "Somalia",
    "haiti": "Haiti",
    "ethiopia": "Ethiopia",
    "addis ababa": "Ethiopia",
    "armenia": "South Caucasus",
    "azerbaijan": "South Caucasus",
    "nagorno": "South Caucasus",
    "karabakh": "South Caucasus",
    "libya": "Libya",
    "tripoli": "Libya",
    "benghazi": "Libya",
    "kosovo": "Kosovo",
    "pristina": "Kosovo",
    "svalbard": "Arctic",
    "greenland": "Arctic",
    "mozambique": "Mozambique",
    "cabo delgado": "Mozambique",
}

# Keywords that count towards a region.
KEYWORDS = {
    "Gaza & Middle East": ["gaza", "hamas", "west bank", "idf", "rafah", "hezbollah", "israel", "ceasefire", "golan", "intifada", "occupied"],
    "Ukraine": ["ukraine", "zelenskyy", "kyiv", "donbas", "kharkiv", "zaporizhzhia", "bakhmut", "mariupol", "russian forces", "ukrainian army", "frontline"],
    "Sudan": ["sudan", "khartoum", "rsf", "rapid support forces", "darfur", "al-burhan", "hemedti"],
    "South China Sea": ["south china sea", "spratly", "paracel", "fiery cross", "nine-dash", "scarborough"],
    "Taiwan Strait": ["taiwan", "taipei", "pla navy", "taiwan strait"],
    "Yemen": ["yemen", "houthi", "ansar allah", "hodeidah", "red sea attack"],
    "Sahel": ["sahel", "mali", "burkina faso", "niger", "jnim", "aqim", "bamako", "ouagadougou", "niamey"],
    "Korean Peninsula": ["north korea", "dprk", "kim jong", "pyongyang", "icbm"],
    "Myanmar": ["myanmar", "burma", "tatmadaw", "junta", "arakan army", "shan state", "kachin", "naypyidaw", "rakhine", "sagaing"],
    "DRC": ["drc", "congo", "m23", "monusco", "goma", "kivu", "kinshasa"],
    "Syria": ["syria", "idlib", "sdf", "hts", "damascus", "aleppo"],
    "Somalia": ["somalia", "al-shabaab", "mogadishu", "atmis", "puntland"],
    "Baltic": ["estonia", "latvia", "lithuania", "nato eastern", "kaliningrad", "suwalki", "finland border", "tallinn", "riga", "vilnius", "gotland", "gulf of finland", "baltic sea"],
    "Haiti": ["haiti", "gang", "port-au-prince", "mss", "viv ansanm"],
    "Ethiopia": ["ethiopia", "tigray", "amhara", "tplf", "oromo", "addis ababa"],
    "South Caucasus": ["nagorno", "karabakh", "armenia", "azerbaijan", "south caucasus", "yerevan", "baku", "tbilisi", "abkhazia", "south ossetia", "zangezur"],
    "Libya": ["libya", "tripoli", "gna", "lna", "haftar", "benghazi"],
    "Kosovo": ["kosovo", "pristina", "kfor", "northern kosovo", "kurti"],
    "Arctic": ["arctic", "svalbard", "spitsbergen", "greenland military", "high north", "northern sea route"],
    "Mozambique": ["mozambique", "cabo delgado", "ansar al-sunna", "isis mozambique", "pemba"],
}

# Keywords of the loose detector and of the one with a country hint.
LOOSE_KEYWORDS = {
    "Gaza & Middle East": ["gaza", "hamas", "west bank", "idf", "rafah", "hezbollah", "israel", "occupied territory", "golan", "intifada"],
    "Ukraine": ["ukraine", "zelenskyy", "kyiv", "donbas", "kharkiv", "zaporizhzhia", "bakhmut", "mariupol", "russian forces", "ukrainian army"],
    "Sudan": ["sudan", "khartoum", "rsf", "rapid support forces", "darfur", "al-burhan", "hemedti"],
    "South China Sea": ["south china sea", "spratly", "paracel", "fiery cross", "nine-dash", "scarborough"],
    "Taiwan Strait": ["taiwan", "taipei", "pla navy", "taiwan strait"],
    "Yemen": ["yemen", "houthi", "ansar allah", "hodeidah", "red sea attack"],
    "Sahel": ["sahel", "mali", "burkina faso", "niger", "jnim", "aqim", "bamako", "ouagadougou", "niamey", "wagner africa"],
    "Korean Peninsula": ["north korea", "dprk", "kim jong", "pyongyang", "icbm"],
    "Myanmar": ["myanmar", "burma", "tatmadaw", "junta", "arakan army", "shan state", "kachin"],
    "DRC": ["drc", "congo", "m23", "monusco", "goma", "kivu", "kinshasa"],
    "Syria": ["syria", "idlib", "sdf", "hts", "damascus", "aleppo"],
    "Somalia": ["somalia", "al-shabaab", "mogadishu", "atmis", "puntland"],
    "Baltic": ["estonia", "latvia", "lithuania", "nato eastern", "kaliningrad", "suwalki", "finland border"],
    "Haiti": ["haiti", "gang", "port-au-prince", "mss", "viv ansanm"],
    "Ethiopia": ["ethiopia", "tigray", "amhara", "tplf", "oromo", "addis ababa"],
    "South Caucasus": ["nagorno", "karabakh", "armenia", "azerbaijan", "south caucasus", "yerevan", "baku"],
    "Libya": ["libya", "tripoli", "gna", "lna", "haftar", "benghazi"],
    "Kosovo": ["kosovo", "pristina", "kfor", "northern kosovo", "kurti"],
    "Arctic": ["arctic", "svalbard", "spitsbergen", "greenland military", "high north", "northern sea route"],
    "Mozambique": ["mozambique", "cabo delgado", "ansar al-sunna", "isis mozambique", "pemba"],
}

# Keywords of an exercise's region, the first region with any.
EXERCISE_KEYWORDS = {
    "Baltic": ["baltic", "estonia", "latvia", "lithuania", "norway", "finland", "sweden", "high north"],
    "Ukraine": ["ukraine", "eastern europe", "poland", "romania", "defender"],
    "South China Sea": ["pacific", "philippine", "indo-pacific", "south china"],
    "Taiwan Strait": ["taiwan", "east china"],
    "Korean Peninsula": ["korea", "korean"],
    "Arctic": ["arctic", "barents", "svalbard"],
    "Gaza & Middle East": ["middle east", "centcom", "red sea", "israel"],
    "Mediterranean": ["mediterranean", "nato south"],
}

# Stems of which one must occur in a security report.
SECURITY_STEMS = (
    "attack", "strike", "airstrike", "missile", "drone", "shell", "bomb", "explos", "troop", "militar", "soldier", "army", "navy", "naval",
    "air force", "weapon", "clash", "fight", "combat", "offensive", "invasion", "incursion", "infiltrat", "cyberattack", "hack", "sabotage", "kill",
    "casualt", "wounded", "dead", "ceasefire", "border", "frontline", "artillery", "rocket", "siege", "ambush", "insurgen", "militia", "rebel",
    "jihadi", "terror", "hostage", "abduct", "warship", "fighter jet", "air defense", "air defence", "mobiliz", "mobilis", "exercise", "drill",
    "deployment", "escalat", "occupation", "annex", "coup", "paramilitary", "mercenar", "wagner", "spec ops", "special forces", "gunmen", "shooting",
    "shot down", "intercept", "violation", "airspace", "blockade", "sanction", "nuclear", "icbm", "ballistic", "warhead", "detonat", "ied",
    "checkpoint", "evacuat", "martial law", "curfew", "armed",
)

# Countries of each region in the humanitarian reports, the older list, and the conflict event list.
REPORT_COUNTRIES = {
    "Gaza & Middle East": ["Palestine", "Israel", "Lebanon", "Iraq"],
    "Ukraine": ["Ukraine"],
    "Sudan": ["Sudan", "South Sudan"],
    "Yemen": ["Yemen"],
    "Sahel": ["Mali", "Burkina Faso", "Niger", "Chad"],
    "Myanmar": ["Myanmar"],
    "DRC": ["Democratic Republic of the Congo"],
    "Syria": ["Syria"],
    "Somalia": ["Somalia"],
    "Haiti": ["Haiti"],
    "Ethiopia": ["Ethiopia"],
    "South Caucasus": ["Armenia", "Azerbaijan"],
    "Libya": ["Libya"],
    "Mozambique": ["Mozambique"],
    "Kosovo": ["Kosovo"],
}
EVENT_COUNTRIES = {
    "Gaza & Middle East": ["Israel", "Palestine", "Lebanon", "Syria", "Yemen", "Iran", "Iraq"],
    "Ukraine": ["Ukraine", "Russia"],
    "Sudan": ["Sudan", "South Sudan"],
    "South China Sea": ["Philippines", "Vietnam", "China", "Malaysia"],
    "Taiwan Strait": ["Taiwan"],
    "Yemen": ["Yemen"],
    "Sahel": ["Mali", "Burkina Faso", "Niger", "Chad", "Nigeria"],
    "Korean Peninsula": ["South Korea", "North Korea"],
    "Myanmar": ["Myanmar"],
    "DRC": ["Democratic Republic of Congo"],
    "Syria": ["Syria"],
    "Somalia": ["Somalia", "Ethiopia", "Kenya"],
    "Baltic": ["Estonia", "Latvia", "Lithuania", "Finland"],
    "Haiti": ["Haiti"],
    "Ethiopia": ["Ethiopia"],
    "South Caucasus": ["Armenia", "Azerbaijan", "Georgia"],
    "Libya": ["Libya"],
    "Kosovo": ["Kosovo", "Serbia"],
    "Arctic": ["Norway", "Russia"],
    "Mozambique": ["Mozambique"],
}

# Categories, event types, sources by trust, exercise words, taxonomy, places of exercises.
CATEGORIES = ("cyber", "airspace", "maritime", "disinfo", "proxy", "economic", "military", "diplomatic", "civilian", "unknown", "unclassifiable", "none")
EVENT_CATEGORIES = {
    "Battles": "proxy",
    "Explosions/Remote violence": "proxy",
    "Violence against civilians": "proxy",
    "Protests": "disinfo",
    "Riots": "proxy",
    "Strategic developments": "proxy",
}
TRUSTED_SOURCES = [
    ("CIT (Leviev)", "neutral", "high"),
    ("DeepState", "pro_ukraine", "high"),
    ("DeepState API", "pro_ukraine", "high"),
    ("Mash/OperMap", "pro_kremlin", "low"),
]
ANNOUNCEMENT_WORDS = ("exercise", "steadfast", "defender", "mongoose", "aurora", "trident", "neptune", "dynamic", "iron", "talisman", "rimpac")
HEADING_WORDS = ("exercise", "drill", "maneuver", "operations")
FEED_WORDS = ("exercise", "drill", "maneuver", "training", "operation")
EXERCISE_TYPES = ("LIVEX", "CPX", "CAX", "MAREX", "ADEX", "FTX", "TTX", "CX", "NATO", "bilateral", "national", "SCO", "CSTO", "unknown")
DOMAINS = ("Air", "Maritime", "Land", "Cyber", "Space", "Multi-domain", "Joint")
SCALES = ("Small", "Medium", "Large", "Strategic")
SIGNALS = ("Reassurance", "Deterrence", "Coercion", "Compellence", "Ambiguous")
CLASSES = ("Routine", "Elevated", "Crisis", "Declaratory")
PLACES = {
    "STEADFAST DETERRENCE": (59, 20),
    "DYNAMIC MONGOOSE": (63, -8),
    "AURORA": (60, 18),
    "NEPTUNE STRIKE": (37, 13),
    "IRON UNION": (32, 35),
    "TALISMAN SABRE": (-22, 148),
    "RIMPAC": (21, -157),
    "STEADFAST DEFENDER": (55, 24),
    "CYBER COALITION": (59.5, 24.7),
    "STEADFAST DART": (44, 26),
}
PLACE_WORDS = [("PACIFIC", (-10, 140)), ("INDO", (-10, 140)), ("ARCTIC", (70, 15)), ("BALTIC", (58, 20)), ("NORDIC", (58, 20)), ("MED", (36, 14))]
DEFAULT_PLACE = (30, 15)

# Severity weights, source confidence classes, regions under recalibration, calibration.
SEVERITY = {1: 0.10, 2: 0.30, 3: 0.80, 4: 2.00, 5: 4.00}
SOURCE_CONFIDENCE = {"UN": "Inst", "OCHA": "Inst", "ReliefWeb": "Inst", "UCDP": "Acad", "SIPRI": "Acad", "Bellingcat": "OSINT", "DeepState": "OSINT", "CIT": "OSINT", "Reuters": "Media", "Guardian": "Media", "Kyiv Independent": "Media", "MEE": "Media", "Atlantic Council": "Anal", "Carnegie": "Anal", "CSIS": "Anal", "Crisis Group": "Anal", "Wikipedia": "Disc"}
RECALIBRATING = ("Baltic", "Taiwan Strait", "Haiti", "Libya")
RECENT_DAYS, RECENT_BOOST, WINDOW_DAYS, ANCHORS = 7, 1.6, 30, 90
NORM, KAPPA_FLOOR, KAPPA_COLD, COLD_DAYS = 1.0 / -math.log(1.0 - 0.35), 3.0, 15.0, 15
WEIGHT_EVENTS, WEIGHT_EXERCISES, WEIGHT_BASE = 0.45, 0.35, 0.20
DEFAULT_SCALE, FULL_SCALE, AHEAD_DAYS = 5000, 80000, 14


def terms() -> list[tuple[str, str]]:
    """(term, region): longest first, in the order given on ties."""
    return sorted(TERMS.items(), key=lambda p: -len(p[0]))


def region_dim(spark: SparkSession) -> DataFrame:
    """20 rows: region, short, kind, lat, lng, theatre, baseline."""
    return spark.createDataFrame([(r, *v) for r, v in REGIONS.items()], "region string, short string, kind string, lat double, lng double, theatre string, baseline double")
