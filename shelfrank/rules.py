"""Every score, weight, threshold and word list in this file is part
of the specification and must be kept as it is for results to be right.

Order matters wherever a list or dict is read as "first match wins".
"""

# --- cleaning -----------------------------------------------------------------

PRICE_MIN, PRICE_MAX = 1000, 500_000
PRICE_FLOOR = 5000  # listings at or below this are dropped after cleaning

RAM_SIZES = [4, 8, 12, 16, 24, 32, 48, 64, 128]
SSD_SIZES = [128, 256, 512, 1024, 2048]
RAM_DEFAULT, SSD_DEFAULT, SCREEN_DEFAULT = 8, 256, 15.6
CPU_SCORE_DEFAULT, GPU_SCORE_DEFAULT = 5.0, 3.0

BRAND_KEYWORDS = {
    "apple": ["apple", "macbook", "mac "],
    "lenovo": ["lenovo", "thinkpad", "ideapad", "yoga", "legion"],
    "asus": ["asus", "rog", "zenbook", "vivobook", "tuf"],
    "dell": ["dell", "alienware", "xps", "inspiron", "latitude"],
    "hp": ["hp ", "hewlett", "omen", "pavilion", "elitebook", "victus", "omnibook"],
    "msi": ["msi ", "msi-", "msi_"],
    "acer": ["acer", "predator", "aspire", "nitro"],
    "microsoft": ["microsoft", "surface"],
    "huawei": ["huawei", "matebook"],
    "samsung": ["samsung", "galaxy book"],
    "monster": ["monster", "tulpar", "abra"],
    "casper": ["casper", "excalibur", "nirvana"],
}

OS_TEXT_KEYWORDS = {
    "windows": ["windows", "win11", "win10", "w11", "w10"],
    "macos": ["mac", "macos", "os x"],
    "linux": ["ubuntu", "linux", "debian"],
    "freedos": ["dos", "free", "yok", "none"],
}
OS_NAME_KEYWORDS = {
    "windows": ["windows 11", "win11", "w11", "windows 10", "win10"],
    "macos": ["macbook", "mac "],
    "freedos": ["freedos", "free dos", "fdos", "dos", "/dos"],
}
OS_FACETS = ["windows", "macos", "linux", "freedos"]

# Cells pandas reads as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- hardware -----------------------------------------------------------------

CPU_SCORES = {
    "i9-14": 9.5, "i7-14": 8.5, "i5-14": 7.0, "i3-14": 5.0,
    "i9-13": 9.0, "i7-13": 8.0, "i5-13": 6.5, "i3-13": 4.5,
    "i9-12": 8.5, "i7-12": 7.5, "i5-12": 6.0, "i3-12": 4.0,
    "ryzen 9 7": 9.2, "ryzen 7 7": 8.2, "ryzen 5 7": 6.8,
    "ryzen 9 8": 9.5, "ryzen 7 8": 8.5, "ryzen 5 8": 7.0,
    "ultra 9": 9.0, "ultra 7": 8.0, "ultra 5": 7.0,
    "m4": 9.5, "m3": 9.0, "m2": 8.5, "m1": 8.0,
}
CPU_FAMILY_SCORES = [
    (["i9", "ryzen 9"], 9.0),
    (["i7", "ryzen 7"], 7.5),
    (["i5", "ryzen 5"], 6.0),
    (["i3", "ryzen 3"], 4.0),
]

IGPU_KEYWORDS = [
    "iris xe", "iris plus", "uhd graphics", "hd graphics", "radeon graphics",
    "radeon 780m", "radeon 760m", "radeon 680m", "vega 8", "vega 7", "vega 6", "vega 3",
    "integrated", "igpu", "apu graphics",
]
ARC_SCORES = [(["A770", "A750"], 7.5), (["A570", "A550"], 6.5), (["A370", "A350"], 5.5)]
RTX_SCORES = {
    "5090": 10.0, "5080": 9.5, "5070": 9.0, "5060": 8.5, "5050": 8.0,
    "4090": 9.8, "4080": 9.3, "4070": 8.8, "4060": 8.0, "4050": 7.2,
    "3090": 8.9, "3080": 8.5, "3070": 7.8, "3060": 7.0, "3050": 6.0, "3500": 8.0,
}
RTX_SERIES_SCORES = {"50": 8.3, "40": 8.0, "30": 7.0}
GTX_SCORES = {"1660": 5.5, "1650": 5.0, "1050": 4.2}
MX_SCORES = {"570": 4.2, "550": 4.0, "450": 3.6, "350": 3.2, "330": 3.0}
RX_SCORES = {
    "7900": 8.8, "7800": 8.3, "7700": 7.8, "7600": 7.2, "7600M": 7.0,
    "6800": 7.5, "6700": 7.0, "6600": 6.6,
}
RX_SERIES_SCORES = {"79": 8.6, "78": 8.2, "77": 7.7, "76": 7.1, "67": 6.9, "66": 6.5}
APPLE_GPU_SCORES = {"m4": 8.5, "m3": 8.0, "m2": 7.5, "m1": 7.0}

NOT_DISCRETE = ["(igpu)", "integrated", "intel uhd", "iris"]

# --- profiles and scoring -------------------------------------------------------

USAGES = ["gaming", "portability", "productivity", "design", "dev"]
PARTS = ["price", "performance", "ram", "storage", "brand", "brand_purpose", "battery", "portability"]

# Weights per usage, in the order of PARTS; each row adds up to 100.
WEIGHTS = {
    "gaming": [15, 40, 15, 10, 7, 8, 3, 2],
    "portability": [15, 10, 10, 8, 6, 6, 20, 25],
    "productivity": [15, 25, 20, 12, 6, 6, 8, 8],
    "design": [12, 22, 18, 15, 7, 6, 10, 10],
    "dev": [12, 28, 22, 15, 4, 4, 8, 7],
}
BASE_WEIGHTS = [25, 20, 15, 10, 10, 10, 5, 5]

# (cpu share, gpu share) of the performance part.
PERFORMANCE_MIX = {"gaming": (0.3, 0.7), "design": (0.5, 0.5), "portability": (0.8, 0.2)}
PERFORMANCE_MIX_MULTITASK = (0.85, 0.15)
PERFORMANCE_MIX_DEFAULT = (0.7, 0.3)

RAM_STEPS = [(64, 100), (32, 90), (24, 80), (16, 70), (12, 55), (8, 40)]
RAM_STEP_DEFAULT = 20
SSD_STEPS = [(2048, 100), (1024, 85), (512, 70), (256, 50)]
SSD_STEP_DEFAULT = 30

BRAND_SCORES = {
    "apple": 9.5, "lenovo": 9.0, "dell": 8.8, "asus": 8.5, "hp": 8.3, "microsoft": 8.5,
    "huawei": 8.0, "samsung": 8.0, "msi": 8.0, "acer": 7.5, "monster": 7.0, "casper": 6.8,
    "other": 5.0,
}
BRAND_SCORE_DEFAULT = 5.0

# Brand fit per usage, in the order of USAGES.
BRAND_PURPOSE = {
    "apple": [65, 95, 90, 98, 92],
    "lenovo": [85, 82, 95, 85, 93],
    "asus": [92, 75, 85, 88, 85],
    "dell": [80, 83, 92, 87, 90],
    "hp": [78, 82, 88, 90, 84],
    "huawei": [60, 90, 82, 92, 80],
    "samsung": [65, 92, 80, 91, 78],
    "msi": [95, 60, 75, 78, 80],
    "acer": [80, 78, 78, 75, 78],
    "microsoft": [55, 88, 86, 90, 85],
    "monster": [90, 55, 70, 70, 75],
    "casper": [75, 70, 72, 70, 73],
}
BRAND_PURPOSE_DEFAULT = 70

OS_FACTOR = {
    "design": {"macos": 1.05, "windows": 1.03, "linux": 1.02, "freedos": 0.95},
    "dev": {"macos": 1.05, "windows": 1.03, "linux": 1.02, "freedos": 0.95},
    "productivity": {"windows": 1.02, "macos": 1.02, "freedos": 0.97},
}

# Developer presets. port_bonus is indexed by screen bucket:
# [<=13.6, <=14.5, <=15.6, >16, 15.6-16].
DEV_PRESETS = {
    "web": dict(
        min_ram=16, min_ssd=512, screen_max=15.6, need_dgpu=False, need_cuda=False,
        os_factor={"windows": 1.0, "macos": 1.0, "linux": 1.05},
        cpu_bias={"hx": 1.0, "h": 0.5, "u": -0.2, "p": 0.2},
        port_bonus=[0.0, 0.3, 0.2, -0.4, 0.0],
    ),
    "ml": dict(
        min_ram=32, min_ssd=1024, screen_max=16.0, need_dgpu=True, need_cuda=True,
        os_factor={"windows": 1.04, "macos": 0.98, "linux": 1.03},
        cpu_bias={"hx": 0.8, "h": 0.5, "u": -0.6, "p": -0.2},
        port_bonus=[0.0, -0.2, 0.2, -0.1, 0.0],
    ),
    "mobile": dict(
        min_ram=16, min_ssd=512, screen_max=14.5, need_dgpu=False, need_cuda=False,
        os_factor={"macos": 1.06, "windows": 1.0, "linux": 0.98},
        cpu_bias={"u": 0.6, "p": 0.3, "h": -0.2, "hx": -0.5},
        port_bonus=[0.8, 0.5, 0.0, -0.2, -0.2],
    ),
    "gamedev": dict(
        min_ram=32, min_ssd=1024, screen_max=16.0, need_dgpu=True, need_cuda=True,
        os_factor={"windows": 1.04, "macos": 0.97, "linux": 1.0},
        cpu_bias={"hx": 1.0, "h": 0.6, "u": -0.8, "p": -0.3},
        port_bonus=[0.0, -0.2, 0.2, 0.1, 0.0],
    ),
    "general": dict(
        min_ram=16, min_ssd=512, screen_max=15.6, need_dgpu=False, need_cuda=False,
        os_factor={"windows": 1.02, "macos": 1.02, "linux": 1.02},
        cpu_bias={"h": 0.3, "p": 0.2, "u": 0.0, "hx": -0.1},
        port_bonus=[0.0, 0.3, 0.2, -0.2, 0.0],
    ),
}
DEV_MODE_DEFAULT = "general"
DEV_OS_FACTOR_DEFAULT = 0.98
# Extra graphics points: (lowest RTX tier, points); the last entry of "ml" is for any discrete GPU.
DEV_TIER_POINTS = {"ml": [(4060, 5.0), (4050, 3.0)], "gamedev": [(4070, 6.0), (4060, 4.0), (4050, 2.0)]}
DEV_ML_ANY_DGPU = 1.0
DEV_DGPU_PENALTY = {"web": -1.5, "general": -1.5, "mobile": -2.5}
DEV_APPLE_BONUS_MODES = ["mobile", "general", "web"]

GAMING_TITLE_SCORES = {
    "Starfield": 7.5,
    "Call of Duty: Black Ops 6": 7.0,
    "Forza Horizon 5": 6.5,
    "Baldur's Gate 3": 6.6,
    "Helldivers 2": 6.5,
    "Cyberpunk 2077 (2.0)": 6.8,
    "Assassin's Creed Mirage": 5.5,
    "Forza Motorsport (2023)": 7.5,
    "Lies of P": 5.5,
    "Apex/Fortnite (yüksek ayar)": 5.0,
}
GAMING_MIN_GPU = 6.0
