"""Check SQL for every query: DuckDB text written from the rules, not from the Spark plans."""

from __future__ import annotations

from shelfrank import rules
from shelfrank.sources.driver_tables import LISTINGS, PROFILES, TITLES


def num(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)" if x != float("inf") else "CAST('inf' AS DOUBLE)"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(e: str, words) -> str:
    return "(" + " OR ".join(f"contains({e}, {text(w)})" for w in words) + ")"


def case(pairs, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def ex(e: str, pattern: str, g: int = 1, i: bool = False) -> str:
    flag = "(?i)" if i else ""
    return f"NULLIF(regexp_extract({e}, {text(flag + pattern)}, {g}), '')"


def has(e: str, pattern: str, i: bool = False) -> str:
    flag = "(?i)" if i else ""
    return f"regexp_matches({e}, {text(flag + pattern)})"


def big(e: str) -> str:
    return f"TRY_CAST({e} AS BIGINT)"


def dbl(e: str) -> str:
    return f"TRY_CAST({e} AS DOUBLE)"


def r6(e: str) -> str:
    return f"round({e}, 6)"


# --- cleaning --------------------------------------------------------------------

PRICE = (
    "CASE WHEN TRY_CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) BETWEEN 1000 AND 500000 "
    "THEN TRY_CAST(regexp_replace(price, '[^0-9]', '', 'g') AS BIGINT) END"
)
_RAM1 = big(ex("upper(ram)", r"(\d+)"))
RAM = f"""COALESCE({big(ex("upper(ram)", r"[(](\d+)\s*GB[)]"))},
  list_max(list_transform(regexp_extract_all(upper(ram), '(\\d+)\\s*GB', 1), lambda x: TRY_CAST(x AS BIGINT))),
  CASE WHEN {_RAM1} IN (4, 8, 12, 16, 24, 32, 48, 64, 128) THEN {_RAM1} END, 8)"""
_TB, _GB, _N = big(ex("upper(ssd)", r"(\d+)\s*TB")), big(ex("upper(ssd)", r"(\d+)\s*GB")), big(ex("upper(ssd)", r"(\d+)"))
SSD = f"""CAST(COALESCE({_TB} * 1024,
  CASE WHEN {_GB} IN (128, 256, 512, 1024, 2048) THEN {_GB} WHEN {_GB} = 1000 THEN 1024 WHEN {_GB} = 500 THEN 512 END,
  CASE WHEN {_N} IN (128, 256, 512, 1024, 2048) THEN {_N} WHEN {_N} = 1 THEN 1024 END, 256) AS BIGINT)"""
SCREEN = r"""list_filter(list_transform(regexp_extract_all(
  regexp_replace(replace(lower(screen_size), ',', '.'), '(\d{2})\s*\.\s*(\d)', '\1.\2', 'g'), '(\d{2}(?:\.\d)?)', 1),
  lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x BETWEEN 10.0 AND 19.9)[1]"""
BRAND = case([(any_of("lower(name)", w), text(b)) for b, w in rules.BRAND_KEYWORDS.items()], "'other'")
OS = (
    "COALESCE("
    + case([(any_of("lower(os)", w), text(o)) for o, w in rules.OS_TEXT_KEYWORDS.items()])
    + ", "
    + case([(any_of("lower(name)", w), text(o)) for o, w in rules.OS_NAME_KEYWORDS.items()])
    + f", CASE WHEN ({BRAND}) = 'apple' THEN 'macos' END, 'freedos')"
)

# --- hardware ---------------------------------------------------------------------

_CPU_BASE = case([(f"contains(lower(cpu), {text(k)})", num(v)) for k, v in rules.CPU_SCORES.items()])
_CPU_FAMILY = case([(any_of("lower(cpu)", w), num(v)) for w, v in rules.CPU_FAMILY_SCORES])
CPU_SCORE = f"""CASE WHEN cpu IS NULL THEN {num(5)} WHEN ({_CPU_BASE}) IS NOT NULL THEN
  CASE WHEN contains(lower(cpu), 'hx') THEN least({num(10)}, ({_CPU_BASE}) + {num(.5)})
    WHEN {any_of("lower(cpu)", [" u", "-u"])} THEN greatest({num(1)}, ({_CPU_BASE}) - {num(1)})
    WHEN {any_of("lower(cpu)", [" p", "-p"])} THEN ({_CPU_BASE}) - {num(.3)} ELSE ({_CPU_BASE}) END
  ELSE COALESCE(({_CPU_FAMILY}), {num(5)}) END"""


def gpu_label(g: str) -> str:
    s, packed = f"lower({g})", f"replace(lower({g}), ' ', '')"
    rtx = r"\brtx[\s\-]?(\d{3,4})(?:\s*(ti|super|max\-q|laptop)?)?\b"
    gtx = r"\bgtx[\s\-]?(\d{3,4})(?:\s*(ti|super))?\b"
    mx, rx = r"\bmx[\s\-]?(\d{2,3})\b", r"\brx[\s\-]?(\d{3,4})(?:\s*([ms]|xt|xtx))?\b"
    arc, m = r"\barc[\s\-]?([a-z]?\d{3,4}m?)\b", r"\bm([1-4])\b"
    return case(
        [
            (f"{g} IS NULL OR trim({g}) = ''", "'Integrated (generic)'"),
            (has(s, rtx), f"concat('GeForce RTX ', {ex(s, rtx)})"),
            (has(s, gtx), f"concat('GeForce GTX ', {ex(s, gtx)}, CASE WHEN {ex(s, gtx, 2)} IS NOT NULL THEN concat(' ', upper({ex(s, gtx, 2)})) ELSE '' END)"),
            (has(s, mx), f"concat('NVIDIA MX ', {ex(s, mx)})"),
            (has(packed, rx), f"concat('Radeon RX ', {ex(packed, rx)}, COALESCE(upper({ex(packed, rx, 2)}), ''))"),
            (has(s, arc), f"concat('Intel Arc ', upper({ex(s, arc)}))"),
            (has(s, m), f"concat('Apple M', {ex(s, m)}, ' GPU')"),
            (f"contains({s}, 'iris xe')", "'Intel Iris Xe (iGPU)'"),
            (f"contains({s}, 'iris plus')", "'Intel Iris Plus (iGPU)'"),
            (any_of(s, ["uhd graphics", "hd graphics"]) + " OR " + has(s, r"\buhd\b"), "'Intel UHD (iGPU)'"),
            (has(s, r"radeon\s*(\d{3})m\b"), f"concat('Radeon ', {ex(s, r'radeon\s*(\d{3})m\b')}, 'M (iGPU)')"),
            (has(s, r"\bvega\s*(8|7|6|3)\b"), f"concat('Radeon Vega ', {ex(s, r'\bvega\s*(8|7|6|3)\b')}, ' (iGPU)')"),
            (any_of(s, ["integrated", "igpu", "apu graphics"]), "'Integrated (generic)'"),
            (any_of(s, ["geforce", "nvidia", "radeon"]), "'Discrete GPU (Unknown)'"),
        ],
        "'GPU (Unlabeled)'",
    )


def _table(e: str, table: dict, default) -> str:
    return f"CASE {e} " + " ".join(f"WHEN {text(k)} THEN {num(v)}" for k, v in table.items()) + f" ELSE {default} END"


def gpu_score(g: str) -> str:
    s, packed = f"lower({g})", f"replace(lower({g}), ' ', '')"
    arc = f"upper({ex(s, r'\barc\s*([a-z]?\d{3,4}m?)\b')})"
    rtx = f"COALESCE({ex(s, r'rtx\s*([345]\d{3,4})')}, {ex(s, r'rtx(\d{4})')})"
    gtx = ex(s, r"gtx\s*(\d{3,4})")
    mx = f"COALESCE({ex(s, r'\bmx\s*(\d{2,3})\b')}, {ex(s, r'mx(\d{2,3})')})"
    rx = f"upper({ex(packed, r'\brx\s*(\d{3,4}m?)\b')})"
    base = f"replace({rx}, 'M', '')"
    series = lambda e, t, dflt: case([(f"starts_with({e}, {text(k)})", num(v)) for k, v in t.items()], dflt)
    return case(
        [
            (f"{g} IS NULL", num(2)),
            (
                any_of(s, rules.IGPU_KEYWORDS),
                case([(any_of(s, ["780m", "680m"]), num(3.5)), (any_of(s, ["760m", "660m"]), num(3))], num(2.5)),
            ),
            (f"{arc} IS NOT NULL", case([(any_of(arc, w), num(v)) for w, v in rules.ARC_SCORES], num(3))),
            (f"{rtx} IS NOT NULL", _table(rtx, rules.RTX_SCORES, series(rtx, rules.RTX_SERIES_SCORES, num(6.5)))),
            (f"{gtx} IS NOT NULL", _table(gtx, rules.GTX_SCORES, num(4.5))),
            (f"{mx} IS NOT NULL", _table(mx, rules.MX_SCORES, num(3.5))),
            (
                f"{rx} IS NOT NULL",
                _table(rx, rules.RX_SCORES, _table(base, rules.RX_SCORES, series(base, rules.RX_SERIES_SCORES, num(5.5)))),
            ),
            *[(has(s, rf"\b{m}\b"), num(v)) for m, v in rules.APPLE_GPU_SCORES.items()],
            (any_of(s, ["geforce", "nvidia", "radeon", "discrete"]), num(4)),
        ],
        num(2),
    )


def cpu_suffix(c: str) -> str:
    s = f"lower(COALESCE({c}, ''))"
    return case(
        [
            (f"contains({s}, 'hx')", "'hx'"),
            (has(s, "(^|[^h])h($|[^x])"), "'h'"),
            (any_of(s, ["-p", " p"]), "'p'"),
            (any_of(s, ["-u", " u"]), "'u'"),
            (f"contains({s}, 'ultra') AND {has(s, r'\b2\d{2}v\b')}", "'p'"),
        ],
        "''",
    )


def dgpu(l: str) -> str:
    return f"NOT {any_of(f'lower({l})', rules.NOT_DISCRETE)}"


def cuda(l: str) -> str:
    return any_of(f"lower({l})", ["rtx", "geforce"])


def tier(l: str) -> str:
    return f"CAST(COALESCE({big(ex(f'lower({l})', r'rtx\s*(\d{4})'))}, 0) AS INT)"


CLEANED = f"""
SELECT seq, source, scraped_at, url, name, ({PRICE}) AS price, {RAM} AS ram_gb, {SSD} AS ssd_gb,
  COALESCE({SCREEN}, {num(15.6)}) AS screen_size, {BRAND} AS brand, {OS} AS os, cpu, gpu
FROM ({LISTINGS}) AS l WHERE ({PRICE}) > 5000 AND name IS NOT NULL
"""
PREPARED = f"""
SELECT *, {gpu_score('gpu_norm')} AS gpu_score FROM (
  SELECT *, {CPU_SCORE} AS cpu_score, {gpu_label('gpu')} AS gpu_norm FROM ({CLEANED}) AS c) AS d
"""

# --- scoring ------------------------------------------------------------------------


def weight(part: str) -> str:
    i = rules.PARTS.index(part)
    return "CASE usage_key " + " ".join(f"WHEN '{u}' THEN {num(w[i])}" for u, w in rules.WEIGHTS.items()) + f" ELSE {num(rules.BASE_WEIGHTS[i])} END"


def mix(i: int) -> str:
    pairs = [(f"usage_key = '{u}'", num(m[i])) for u, m in rules.PERFORMANCE_MIX.items()]
    pairs.append(("usage_key = 'productivity' AND productivity_profile = 'multitask'", num(rules.PERFORMANCE_MIX_MULTITASK[i])))
    return case(pairs, num(rules.PERFORMANCE_MIX_DEFAULT[i]))


def _price_points() -> str:
    p, lo, hi = "CAST(price AS DOUBLE)", "min_budget", "max_budget"
    base = f"CASE WHEN {hi} - {lo} > 0 THEN 100 * (1 - ({p} - {lo}) / ({hi} - {lo})) ELSE 100 END"
    off = f"CASE WHEN {hi} - {lo} > 0 THEN abs({p} - ({lo} + {hi}) / 2) / (({hi} - {lo}) / 2) ELSE 0 END"
    inside = f"least({num(100)}, ({base}) * {num(.95)} + greatest({num(0)}, (1 - ({off})) * 4))"
    penalty = f"CASE WHEN {p} < {lo} THEN ({lo} - {p}) / {lo} ELSE ({p} - {hi}) / {hi} END"
    return f"CASE WHEN {p} BETWEEN {lo} AND {hi} THEN {inside} ELSE greatest({num(0)}, 50 * (1 - ({penalty}))) END"


def _steps(e, table, default) -> str:
    return case([(f"{e} >= {b}", num(v)) for b, v in table], num(default))


def _battery() -> str:
    s = "lower(COALESCE(cpu, ''))"
    ry = f"contains({s}, 'ryzen')"
    by_cpu = case(
        [
            (any_of(s, ["m1", "m2", "m3", "m4"]), 30),
            (has(s, r"i[3579]-\d+u") + f" OR ends_with({s}, '-u')", 20),
            (has(s, r"i[3579]-\d+p") + f" OR contains({s}, '-p')", 10),
            (f"contains({s}, 'hx')", -20),
            (has(s, r"i[3579]-\d+h($|[^x])") + f" OR ends_with({s}, '-h') OR contains({s}, ' h ')", -10),
            (f"{ry} AND (contains({s}, ' u') OR ends_with({s}, 'u'))", 20),
            (f"{ry} AND contains({s}, 'hs')", 5),
            (f"{ry} AND (contains({s}, 'hx') OR ((contains({s}, ' h') OR ends_with({s}, 'h')) AND NOT contains({s}, 'hs')))", -15),
            (f"contains({s}, 'ultra')", 15),
        ],
        0,
    )
    by_gpu = case([("gpu_score < 3", 15), ("gpu_score > 7", -20), ("gpu_score > 5", -10)], 0)
    return f"CAST(greatest(0, least(100, 50 + ({by_cpu}) + ({by_gpu}))) AS DOUBLE)"


def _portability() -> str:
    by_screen = case([("screen_size <= 13", 40), ("screen_size <= 14", 30), ("screen_size <= 15", 10), ("screen_size >= 17", -30)], -10)
    by_gpu = case([("gpu_score < 3", 10), ("gpu_score > 7", -15)], 0)
    return f"CAST(greatest(0, least(100, 50 + ({by_screen}) + ({by_gpu}))) AS DOUBLE)"


def _brand_purpose() -> str:
    pairs = [
        (f"brand = '{b}' AND usage_key = '{u}'", num(row[i]))
        for b, row in rules.BRAND_PURPOSE.items() for i, u in enumerate(rules.USAGES)
    ]
    return case(pairs, num(rules.BRAND_PURPOSE_DEFAULT))


POINTS = {
    "price": _price_points(),
    "performance": f"(cpu_score * {mix(0)} + gpu_score * {mix(1)}) * 10",
    "ram": _steps("ram_gb", rules.RAM_STEPS, rules.RAM_STEP_DEFAULT),
    "storage": _steps("ssd_gb", rules.SSD_STEPS, rules.SSD_STEP_DEFAULT),
    "brand": f"({_table('brand', rules.BRAND_SCORES, num(5))}) * 10",
    "brand_purpose": _brand_purpose(),
    "battery": _battery(),
    "portability": _portability(),
}
OS_FACTOR = case(
    [(f"usage_key = '{u}' AND os = '{o}'", num(f)) for u, t in rules.OS_FACTOR.items() for o, f in t.items()], num(1)
)


def _preset(field, render=num) -> str:
    return case([(f"dev_mode = '{m}'", render(p[field])) for m, p in rules.DEV_PRESETS.items()], render(rules.DEV_PRESETS["general"][field]))


def _bool(b) -> str:
    return "TRUE" if b else "FALSE"


def _dev_fit() -> str:
    g = "gpu_norm"
    presets = rules.DEV_PRESETS
    bias = case([(f"dev_mode = '{m}' AND ({cpu_suffix('cpu')}) = '{s}'", num(v)) for m, p in presets.items() for s, v in p["cpu_bias"].items()], num(0))
    factor = case([(f"dev_mode = '{m}' AND os = '{o}'", num(v)) for m, p in presets.items() for o, v in p["os_factor"].items()], num(.98))
    ml = case([(f"{tier(g)} >= 4060", num(5)), (f"{tier(g)} >= 4050", num(3)), (dgpu(g), num(1))], num(0))
    gd = case([(f"{tier(g)} >= 4070", num(6)), (f"{tier(g)} >= 4060", num(4)), (f"{tier(g)} >= 4050", num(2))], num(0))
    extra = case(
        [("dev_mode = 'ml'", ml), ("dev_mode = 'gamedev'", gd), (f"dev_mode IN ('web', 'general') AND {dgpu(g)}", num(-1.5)),
         (f"dev_mode = 'mobile' AND {dgpu(g)}", num(-2.5))], num(0))
    gpu = f"greatest({num(0)}, least({num(25)}, least({num(1)}, gpu_score / {num(8)}) * 20 + ({extra})))"
    bucket = case([("screen_size <= 13.6", 0), ("screen_size <= 14.5", 1), ("screen_size <= 15.6", 2), ("screen_size > 16", 3)], 4)
    bonus = case([(f"dev_mode = '{m}' AND ({bucket}) = {i}", num(b)) for m, p in presets.items() for i, b in enumerate(p["port_bonus"])], num(0))
    size = f"(CASE WHEN screen_size <= {_preset('screen_max')} THEN {num(1)} ELSE {num(.7)} END * 10 + ({bonus}) * 10)"
    total = f"""(least({num(1)}, ram_gb / {_preset('min_ram')}) * 20 + least({num(1)}, ssd_gb / {_preset('min_ssd')}) * 15
      + greatest({num(0)}, {bias}) * 4 + {gpu} + {size}) * ({factor})
      + CASE WHEN {any_of(f'lower({g})', ['apple m1', 'apple m2', 'apple m3', 'apple m4'])} AND dev_mode IN ('mobile', 'general', 'web')
        THEN {num(3)} ELSE {num(0)} END"""
    missing = f"({_preset('need_dgpu', _bool)} AND NOT ({dgpu(g)})) OR ({_preset('need_cuda', _bool)} AND NOT ({cuda(g)}))"
    return f"CASE WHEN {missing} THEN {num(0)} ELSE greatest({num(0)}, least({num(100)}, ({total}) / 84 * 100)) END"


DEV_FIT = _dev_fit()


def scored(rows: str) -> str:
    """Adds part_* columns, dev_fit and score to rows of (listing, profile)."""
    parts = ", ".join(f"({e}) * ({weight(p)}) / 100 AS part_{p}" for p, e in POINTS.items())
    total = " + ".join(f"part_{p}" for p in POINTS)
    return f"""
SELECT *, CASE WHEN usage_key = 'dev' THEN greatest({num(0)}, least({num(100)}, {num(.7)} * base_score + {num(.3)} * dev_fit))
  ELSE base_score END AS score FROM (
  SELECT *, greatest({num(0)}, least({num(100)}, ({total}) * ({OS_FACTOR}))) AS base_score, {DEV_FIT} AS dev_fit FROM (
    SELECT *, {parts} FROM ({rows}) AS s0) AS s1) AS s2
"""


OWN = f"""
SELECT l.*, p.* FROM ({PREPARED}) AS l
JOIN orders AS o ON o.o_orderkey = l.seq JOIN customer AS c ON c.c_custkey = o.o_custkey
JOIN ({PROFILES}) AS p ON p.profile_id = concat(CAST(c.c_nationkey AS STRING), '-', c.c_mktsegment)
"""
OWN_SCORED = scored(OWN)

# --- filters and recommendation --------------------------------------------------------

FACETS = """(allowed_brands IS NULL OR len(allowed_brands) = 0 OR list_contains(allowed_brands, brand))
  AND (allowed_oses IS NULL OR len(allowed_oses) = 0 OR list_contains(allowed_oses, os))
  AND (min_ram IS NULL OR ram_gb >= min_ram) AND (min_ssd IS NULL OR ssd_gb >= min_ssd)
  AND NOT (usage_key = 'gaming' AND exclude_apple_in_gaming AND brand = 'apple')"""
STRICT = case(
    [
        ("usage_key = 'gaming'", "gpu_score >= min_gpu_score_required AND ram_gb >= 8"),
        ("usage_key = 'portability'", "screen_size <= 14.5"),
        ("usage_key = 'productivity'", "ram_gb >= 8 AND cpu_score >= 5"),
        ("usage_key = 'design'", "ram_gb >= 16 AND gpu_score >= 4 AND screen_size >= 14"),
        (
            "usage_key = 'dev'",
            f"ram_gb >= 16 AND cpu_score >= 6 AND ssd_gb >= 256 AND ram_gb >= {_preset('min_ram')} AND ssd_gb >= {_preset('min_ssd')} "
            f"AND screen_size <= {_preset('screen_max')} AND (NOT ({_preset('need_dgpu', _bool)} OR {_preset('need_cuda', _bool)}) OR {dgpu('gpu_norm')}) "
            f"AND (NOT {_preset('need_cuda', _bool)} OR {cuda('gpu_norm')})",
        ),
    ],
    "TRUE",
)
RELAXED = case(
    [
        ("usage_key = 'gaming'", "gpu_score >= 5"),
        ("usage_key = 'portability'", "screen_size <= 15.6"),
        ("usage_key IN ('design', 'dev')", "ram_gb >= 12"),
    ],
    "TRUE",
)


def rec_ctes(profiles: str = PROFILES) -> str:
    """CTEs up to ``kept``: rows that pass each profile's filters, before duplicate removal."""
    return f"""
WITH prep AS MATERIALIZED ({PREPARED}), prof AS MATERIALIZED ({profiles}),
pairs AS MATERIALIZED (SELECT l.*, p.* FROM prep AS l JOIN prof AS p ON l.price >= p.min_budget AND l.price <= p.max_budget WHERE {FACETS}),
counts AS (
  SELECT profile_id, count(*) AS n_in, count(*) FILTER (screen_size <= 14.5) AS n_thin,
    count(*) FILTER (screen_size <= 14.5 AND gpu_score <= 5) AS n_cap5,
    count(*) FILTER (screen_size <= 14.5 AND gpu_score <= 6) AS n_cap6, count(*) FILTER ({STRICT}) AS n_strict
  FROM pairs GROUP BY profile_id
), decided AS (
  SELECT *, n_pass < 5 AND n_in > 5 AS relaxed FROM (
    SELECT c.*, CASE WHEN usage_key = 'portability' AND n_thin > 50 THEN 5 WHEN usage_key = 'portability' AND n_thin > 30 THEN 6 ELSE 1000 END AS gpu_cap,
      CASE WHEN usage_key = 'portability' AND n_thin > 50 THEN n_cap5 WHEN usage_key = 'portability' AND n_thin > 30 THEN n_cap6 ELSE n_strict END AS n_pass
    FROM counts AS c JOIN (SELECT profile_id, usage_key FROM prof) AS u USING (profile_id)) AS x
), strict_rows AS (
  SELECT a.*, d.relaxed FROM pairs AS a JOIN decided AS d USING (profile_id) WHERE ({STRICT}) AND gpu_score <= gpu_cap
), kept AS (
  SELECT a.*, d.relaxed FROM pairs AS a JOIN decided AS d USING (profile_id)
  WHERE CASE WHEN d.relaxed THEN ({RELAXED}) ELSE ({STRICT}) AND gpu_score <= d.gpu_cap END
    AND (usage_key <> 'gaming' OR gpu_score >= min_gpu_score_required)
), w1 AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY profile_id, url ORDER BY seq) = 1
), w2 AS (SELECT * FROM w1 QUALIFY row_number() OVER (PARTITION BY profile_id, name, price ORDER BY seq) = 1)
"""


def diverse(rows: str) -> str:
    """Brand-diverse top of scored rows."""
    return f"""
SELECT * EXCLUDE (rn, two, third), CAST(row_number() OVER (PARTITION BY profile_id ORDER BY rn) AS INT) AS rank FROM (
  SELECT *, min(CASE WHEN NOT list_contains(two, brand) THEN rn END) OVER (PARTITION BY profile_id) AS third FROM (
    SELECT *, list(brand) FILTER (rn <= 2) OVER (PARTITION BY profile_id) AS two FROM (
      SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, price, seq) AS rn FROM ({rows}) AS v0) AS v1) AS v2) AS v3
WHERE rn <= 2 OR rn >= third
QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY rn) <= greatest(top_n, 1)
"""


def recommend(profiles: str = PROFILES) -> str:
    return f"""{rec_ctes(profiles)}, scored AS ({scored('SELECT * FROM w2')}), top AS ({diverse('SELECT * FROM scored')})
SELECT profile_id, rank, seq, url, name, price, brand, os, {r6('score')} AS score FROM top"""
