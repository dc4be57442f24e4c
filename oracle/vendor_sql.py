"""Check SQL of the vendor attribute functions, over TITLES (seq, source, price_text, title, specs)."""

from __future__ import annotations

from oracle.sql import any_of, big, case, dbl, ex, has, num, text
from shelfrank.functions import amazon, incehesap, mediamarkt

T, LT = "title", "lower(title)"
V, LV = "concat(title, ' ', specs)", "lower(concat(title, ' ', specs))"  # vatan and mediamarkt text
B = "concat(title, ' | ', specs)"  # incehesap text


def _lira(t: str) -> str:
    n = f"regexp_replace({t}, '[^0-9.,]', '', 'g')"
    dec = f"replace(replace({n}, '.', ''), ',', '.')"
    return dbl(case(
        [
            (f"contains({n}, '.') AND contains({n}, ',')", dec),
            (f"contains({n}, ',') AND length(string_split({n}, ',')[-1]) = 2", dec),
            (f"contains({n}, ',')", f"replace({n}, ',', '')"),
        ],
        f"replace({n}, '.', '')",
    ))


def _inche_price() -> str:
    t = "trim(replace(replace(price_text, 'TL', ''), '₺', ''))"
    plain = case(
        [
            (f"contains({t}, '.') AND contains({t}, ',')", f"replace(replace({t}, '.', ''), ',', '.')"),
            (f"contains({t}, ',') AND len(string_split({t}, ',')) = 2 AND length(string_split({t}, ',')[2]) = 2", f"replace({t}, ',', '.')"),
            (f"contains({t}, ',')", f"replace({t}, ',', '')"),
        ],
        f"replace({t}, '.', '')",
    )
    n = dbl(ex(f"({plain})", r"(\d+(?:\.\d{1,2})?)"))
    return case([(f"{n} BETWEEN 5000 AND 500000", n), (f"{n} >= 10 AND {n} < 1000 AND {n} * 1000 BETWEEN 5000 AND 500000", f"{n} * 1000")])


def _media_price() -> str:
    n = dbl("regexp_replace(replace(replace(replace(price_text, 'TL', ''), '.', ''), ',', '.'), '[^0-9.]', '', 'g')")
    return case([(f"{n} BETWEEN 10000 AND 500000", n)])


PRICE = {
    "amazon": f"CAST(round_even({_lira('price_text')}, 0) AS BIGINT)",
    "incehesap": _inche_price(),
    "mediamarkt": _media_price(),
    "vatan": case([(f"{_lira('price_text')} BETWEEN 5000 AND 500000", _lira("price_text"))]),
}


def _amazon_screen() -> str:
    sizes = [f"replace({ex(T, p, 1, True)}, ',', '.')" for p in amazon.SCREEN_PATTERNS]
    tries = ", ".join(f"CASE WHEN {dbl(s)} BETWEEN 10 AND 20 THEN concat({s}, '\"') END" for s in sizes)
    return f"COALESCE({tries}, CASE WHEN {any_of(LT, ['ultrabook', 'air'])} THEN '13.3\"' ELSE '15.6\"' END)"


def _inche_screen() -> str:
    s = f"COALESCE({ex(B, r'''(\d{2}(?:[.,]\d)?)\s*(?:\"|''|inç|inch)''', 1, True)}, {ex(B, r'(\d{2}[.,]\d)')})"
    n = dbl(f"replace({s}, ',', '.')")
    return case([(f"{n} BETWEEN 10 AND 19.5", n)])


def _media_screen() -> str:
    sizes = [ex(LT, p) for p in mediamarkt.SCREEN_PATTERNS]
    return case([(f"{s} IS NOT NULL", f"concat(replace({s}, ',', '.'), '\"')") for s in sizes], "'15.6\"'")


def _vatan_screen() -> str:
    unit = dbl(f"replace({ex(V, r'''(\d{2}[\.,]?\d?)\s*(?:inç|inc|inch|\"|'')''', 1, True)}, ',', '.')")
    pattern = r"'\d{2}[\.,]?\d?'"
    hits, gaps = f"regexp_extract_all({V}, {pattern})", f"regexp_split_to_array({V}, {pattern})"
    before = f"lower(right(array_to_string(list_transform(range(1, i + 1), lambda j: concat(({gaps})[j], CASE WHEN j < i THEN ({hits})[j] ELSE '' END)), ''), 10))"
    fit = f"""list_filter(list_transform(list_filter(range(1, len({hits}) + 1),
        lambda i: NOT contains({before}, 'nesil') AND NOT contains({before}, 'gen')),
        lambda i: TRY_CAST(replace(({hits})[i], ',', '.') AS DOUBLE)), lambda x: x BETWEEN 13 AND 19.5)"""
    return f"concat(CAST(COALESCE(CASE WHEN {unit} BETWEEN 10 AND 19.5 THEN {unit} END, ({fit})[1], {num(15.6)}) AS STRING), '\"')"


SCREEN = {"amazon": _amazon_screen(), "incehesap": _inche_screen(), "mediamarkt": _media_screen(), "vatan": _vatan_screen()}


def _amazon_storage() -> str:
    patterns = [
        r"(\d+)\s*(gb|tb)\s*(ssd|m\.2|nvme|pcie)", r"(\d+)\s*(gb|tb)\s*ssd", r"ssd\s*(\d+)\s*(gb|tb)", r"(\d+)(gb|tb)ssd",
        r"(\d+)\s*(gb|tb)\s*(?:depolama|storage)",
    ]
    pairs = [(has(T, p, True), f"concat({ex(T, p, 1, True)}, upper({ex(T, p, 2, True)}))") for p in patterns]
    last = r"(\d+)\s*(?:gb|tb)"
    pairs.append((has(T, last, True), f"concat({ex(T, last, 1, True)}, 'GB')"))
    return case(pairs, "'512GB'")


_TB = lambda e: f"{big(ex(e, r'(\d+)\s*TB', 1, True))} * 1024"
_GB = lambda e: big(ex(e, r"(\d+)\s*GB", 1, True))
_inche_size = f"COALESCE({_TB(B)}, {big(ex(B, r'(\d{3,4})\s*GB', 1, True))})"
_media_gb = big(ex(LT, r"(\d{3,4})\s*gb"))
_vatan_ssd = big(ex(V, r"(\d+)\s*GB\s*(?:SSD|NVMe)", 1, True))
STORAGE = {
    "amazon": _amazon_storage(),
    "incehesap": case([(f"{_inche_size} BETWEEN 64 AND 12288", _inche_size)]),
    "mediamarkt": f"concat(CAST(COALESCE({_TB(LT)}, CASE WHEN {_media_gb} >= 128 THEN {_media_gb} END, 512) AS STRING), 'GB')",
    "vatan": case(
        [
            (f"{_TB(V)} IN (1024, 2048, 4096)", f"concat(CAST({_TB(V)} AS STRING), 'GB')"),
            (f"{_vatan_ssd} IN (128, 256, 512, 1024, 2048, 4096)", f"concat(CAST({_vatan_ssd} AS STRING), 'GB')"),
            (f"{_GB(V)} = 1000", "'1024GB'"), (f"{_GB(V)} = 500", "'512GB'"),
            (f"{_GB(V)} IN (128, 256, 512, 1024, 2048, 4096)", f"concat(CAST({_GB(V)} AS STRING), 'GB')"),
        ],
        "'512GB'",
    ),
}


def _amazon_cpu() -> str:
    pairs = []
    for i in ("i9", "i7", "i5", "i3"):
        pairs += [(has(LT, rf"{i}[\s-]?(\d+)"), f"concat('{i}-', {ex(LT, rf'{i}[\s-]?(\d+)')})"), (has(LT, rf"core {i}"), f"'{i}'")]
    for n in (9, 7, 5, 3):
        p = rf"ryzen {n}[\s-]?(\d+)?"
        pairs.append((has(LT, p), f"CASE WHEN {ex(LT, p)} IS NULL THEN 'Ryzen {n}' ELSE concat('Ryzen {n} ', {ex(LT, p)}) END"))
    pairs += [(f"contains({LT}, '{m}')", f"'{m.upper()}'") for m in ("m4", "m3", "m2", "m1")]
    pairs += [(f"contains({LT}, '{n}')", f"'Celeron {n.upper()}'") for n in ("n100", "n4500", "n4020")]
    for f in ("celeron", "pentium"):
        p = rf"{f}[\s-]?(\w+)?"
        pairs.append((has(LT, p), f"CASE WHEN {ex(LT, p)} IS NULL THEN '{f.title()}' ELSE concat('{f.title()} ', {ex(LT, p)}) END"))
    pairs += [
        (has(LT, r"ultra[\s-]?([579])"), f"concat('Ultra ', {ex(LT, r'ultra[\s-]?([579])')})"),
        (any_of(LT, ["apple", "macbook"]), "'M2'"), (f"contains({LT}, 'amd')", "'Ryzen 5'"),
    ]
    return case(pairs, "'i5'")


AMAZON_CPU = _amazon_cpu()


def _amazon_memory() -> str:
    def tried(p):
        n = ex(T, p, 1, True)
        stored = f"regexp_matches({LT}, concat('(?i)', {n}, '\\s*(?:gb|tb)\\s*(?:ssd|storage|depolama)'))"
        return f"CASE WHEN {n} IS NOT NULL AND NOT {stored} THEN concat({n}, 'GB') END"

    large = any_of(f"lower({AMAZON_CPU})", amazon.LARGE_MEMORY_CPUS)
    return "COALESCE(" + ", ".join(tried(p) for p in amazon.MEMORY_PATTERNS) + f", CASE WHEN {large} THEN '16GB' ELSE '8GB' END)"


def _vatan_memory() -> str:
    t = LV
    for p in (r"(?:rtx|gtx|rx|arc|mx)[\w\s\-]*?\b\d+\s*gb", r"gddr\d?\s*\d+\s*gb", r"\b\d+\s*gb\s*vram\b"):
        t = f"regexp_replace({t}, {text(p)}, ' ', 'g')"
    hits, gaps = "regexp_extract_all(cleaned, '(\\d+)\\s*gb', 1)", "regexp_split_to_array(cleaned, '\\d+\\s*gb')"
    word = "ssd|emmc|ufs|nvme|hdd|storage"
    good = f"""list_filter(range(1, len({hits}) + 1), lambda i: TRY_CAST(({hits})[i] AS BIGINT) BETWEEN 4 AND 192
        AND NOT regexp_matches(({gaps})[i + 1], '^\\s*(?:{word})') AND NOT regexp_matches(right(({gaps})[i], 10), '(?:{word})\\s*$'))"""
    size = f"list_max(list_transform({good}, lambda i: TRY_CAST(({hits})[i] AS BIGINT)))"
    return f"(SELECT concat(CAST(COALESCE({size}, 8) AS STRING), 'GB') FROM (SELECT {t} AS cleaned) AS z)"


MEMORY = {
    "amazon": _amazon_memory(),
    "incehesap": big(ex(B, r"(\d+)\s*GB", 1, True)),
    "mediamarkt": f"concat(COALESCE({ex(LT, r'(\d+)\s*gb\s*(?:ram|ddr)')}, {ex(LT, r'(\d+)gb')}, '8'), 'GB')",
    "vatan": _vatan_memory(),
}


def _inche_cpu_text() -> str:
    patterns = [
        r"(i[3579]-?\s?\d{3,5}\w*)", r"(Ryzen\s?\d(?:\s?\d)?)\s?[\w\-]*", r"(Apple\s?M[1-5]\w*)", r"(Core\s?Ultra\s?\d+\w*)",
        r"(Core\s?[357]\s?\d{3}\w*)",
    ]
    return "COALESCE(" + ", ".join(f"trim(regexp_replace({ex(B, p, 0, True)}, '\\s+', ' ', 'g'))" for p in patterns) + ", '')"


def _inche_cpu() -> str:
    s = f"lower({_inche_cpu_text()})"
    return case(
        [
            (has(s, r"\bm([1-5])\b"), f"concat('m', {ex(s, r'\bm([1-5])\b')})"),
            (has(s, r"\bi([3579])\b"), f"concat('i', {ex(s, r'\bi([3579])\b')})"),
            (has(s, r"core\s*ultra\s*(\d+)"), f"concat('ultra', {ex(s, r'core\s*ultra\s*(\d+)')})"),
            (has(s, r"core\s*([357])\s"), f"concat('core', {ex(s, r'core\s*([357])\s')})"),
            (has(s, r"ryzen\s*(3|5|7|9)"), f"concat('ryzen', {ex(s, r'ryzen\s*(3|5|7|9)')})"),
        ],
        f"trim({s})",
    )


def _media_cpu() -> str:
    b = LV
    two = lambda pre, p, j=" ": f"trim(concat('{pre}', {ex(b, p)}, '{j}', COALESCE({ex(b, p, 2)}, '')))"
    m, ai, ry = r"m(\d)(?:\s*(pro|max|ultra))?", r"ryzen\s*ai\s*(\d)\s*([\d]{2,4}[a-z]*)?", r"ryzen\s*([3579])\s*([\d]{3,5}[a-z]*)?"
    ul, co = r"ultra\s*(\d)\s*([\d]{3}[a-z]*)?", r"(i[3579])[-\s]*([\d]{4,5}[a-z]*)"
    x, s = r"snapdragon\s*x\s*(elite|plus|1e[\w\-]*)", r"snapdragon\s*([\w\-]+)"
    amd = any_of(b, ["amd", "ryzen"])
    return case(
        [
            (f"(contains({b}, 'macbook') OR {has(b, r'\bapple m\d')}) AND {has(b, m)}", two("m", m)),
            (any_of(b, ["snapdragon", "x elite", "x plus", "x1e"]), case(
                [(has(b, x), f"concat('snapdragon x ', {ex(b, x)})"), (has(b, s), f"concat('snapdragon ', {ex(b, s)})")], "'snapdragon'")),
            (amd, case([(has(b, ai), two("ryzen ai ", ai)), (has(b, ry), two("ryzen ", ry))], "'ryzen'")),
            (has(b, ul), two("ultra ", ul)), (has(b, co), two("", co, "-")), (any_of(b, ["intel", "core"]), "'intel'"),
        ]
    )


def _vatan_cpu() -> str:
    core = r"(?:Intel\s+)?Core\s+(i[3579])[-\s]?(\d{4,5})([A-Z]{0,2})\b"
    new, ul = r"Core\s+([579])\s+(\d{3})([A-Z]{0,2})\b", r"(?:Core\s+)?Ultra\s+([579])\s+(\d{3})([A-Z]{0,2})\b"
    ry, ai = r"(?:AMD\s+)?Ryzen\s+([3579])\s+(\d{4})([A-Z]{0,3})\b", r"Ryzen\s+AI\s+([379])\s+(\d{3})\b"
    m = r"\b(M[1-4])(?:\s+(Pro|Max|Ultra))?\b"
    e = lambda p, g=1: ex(V, p, g, True)
    h = lambda p: has(V, p, True)
    three = lambda pre, p: f"concat('{pre}', {e(p)}, ' ', {e(p, 2)}, COALESCE(upper({e(p, 3)}), ''))"
    title = f"concat(' ', upper(left({e(m, 2)}, 1)), lower(substr({e(m, 2)}, 2)))"
    return case(
        [
            (h(core), f"concat(upper({e(core)}), '-', {e(core, 2)}, COALESCE(upper({e(core, 3)}), ''))"),
            (h(new), three("Intel Core ", new)), (h(ul), three("Intel Ultra ", ul)), (h(ry), three("Ryzen ", ry)),
            (h(ai), f"concat('Ryzen AI ', {e(ai)}, ' ', {e(ai, 2)})"),
            (h(m), f"concat(upper({e(m)}), CASE WHEN {e(m, 2)} IS NULL THEN '' ELSE {title} END)"),
            (h(r"Celeron\s+([A-Z]?\d{4})\b"), f"concat('Celeron ', {e(r'Celeron\s+([A-Z]?\d{4})\b')})"),
            (h(r"Pentium\s+([A-Z]?\d+)\b"), f"concat('Pentium ', {e(r'Pentium\s+([A-Z]?\d+)\b')})"),
            (h(r"Snapdragon\s+X\s+([\w\d\-]+)"), f"concat('Snapdragon X ', {e(r'Snapdragon\s+X\s+([\w\d\-]+)')})"),
            (h(r"\b(N\d{3,4})\b"), f"concat('Intel ', {e(r'\b(N\d{3,4})\b')})"),
        ],
        "'Intel Core i5'",
    )


CPU = {"amazon": AMAZON_CPU, "incehesap": _inche_cpu(), "mediamarkt": _media_cpu(), "vatan": _vatan_cpu()}

_words = lambda e, table: [(f"contains({e}, {text(k)})", text(v)) for k, v in table]


def _media_os_name(e) -> str:
    return case(
        [
            (any_of(e, ["windows 11", "win11", "w11"]), "'Windows 11'"), (any_of(e, ["windows 10", "win10", "w10"]), "'Windows 10'"),
            (any_of(e, ["freedos", "free dos"]), "'FreeDOS'"), (f"contains({e}, 'chrome')", "'ChromeOS'"),
            (any_of(e, ["linux", "ubuntu"]), "'Linux'"), (any_of(e, ["macos", "mac os", "macbook"]) + " OR " + has(e, r"m\d"), "'macOS'"),
        ]
    )


OS = {
    "amazon": case(
        _words(LT, amazon.OS_WORDS)
        + [(any_of(AMAZON_CPU, ["M1", "M2", "M3", "M4"]), "'macOS'"), (f"contains({LT}, 'chromebook')", "'ChromeOS'")],
        "'FreeDOS'",
    ),
    "incehesap": case([(has(B, p, True), text(v)) for p, v in incehesap.OS_PATTERNS], "''"),
    "mediamarkt": _media_os_name(LT),
    "vatan": case(
        [
            (any_of(LV, ["windows 11", "win11", "w11"]), "'Windows 11'"), (any_of(LV, ["windows 10", "win10", "w10"]), "'Windows 10'"),
            (f"contains({LV}, 'windows')", "'windows'"), (any_of(LV, ["freedos", "free dos", "dos", "fdos"]), "'FreeDOS'"),
            (any_of(LV, ["macbook", "macos", "mac os"]), "'macOS'"), (any_of(LV, ["linux", "ubuntu"]), "'linux'"),
            (any_of(LV, ["apple", "macbook", "mac pro"]), "'macOS'"),
        ],
        "'FreeDOS'",
    ),
}


def _amazon_gpu() -> str:
    pairs = [(any_of(LT, k if isinstance(k, list) else [k]), text(v)) for k, v in amazon.GPU_WORDS]
    pairs += [(any_of(LT, amazon.GAMING_WORDS), "'rtx 3050'"), (any_of(LT, amazon.APPLE_WORDS), "'apple integrated'")]
    return case(pairs, "'integrated'")


def _inche_gpu_text() -> str:
    found = "COALESCE(" + ", ".join(f"NULLIF(trim(regexp_replace({ex(B, p, 0, True)}, '\\s+', ' ', 'g')), '')" for p in incehesap.GPU_PATTERNS) + ")"
    return case(
        [
            (f"{has(B, r'\b(Apple|MacBook|M[1-5])\b', True)} AND {any_of(found, ['Integrated', 'GPU'])}", "'Apple Integrated'"),
            (f"{found} IS NOT NULL", found), (has(B, r"\b(Apple|MacBook|Mac)\b", True), "'Apple Integrated'"),
        ],
        "''",
    )


def _inche_gpu() -> str:
    g = f"lower({_inche_gpu_text()})"
    return case(
        [
            (f"{g} IN ('', 'nan', 'none')", case([(has(B, r"\b(apple|macbook|mac\s|m[1-5])\b", True), "'apple integrated'")], "'integrated'")),
            (has(B, r"\b(apple|macbook|m[1-5])\b", True) + f" OR contains({g}, 'apple')", "'apple integrated'"),
            (has(g, r"rtx\s*([0-9]{4})"), f"concat('rtx', {ex(g, r'rtx\s*([0-9]{4})')})"),
            (has(g, r"gtx\s*([0-9]{4})"), f"concat('gtx', {ex(g, r'gtx\s*([0-9]{4})')})"),
            (has(g, r"rx\s*([0-9]{4}\w*)"), f"concat('rx', {ex(g, r'rx\s*([0-9]{4}\w*)')})"),
            (f"contains({g}, 'radeon') AND {has(g, r'radeon\s*([0-9]{3,4}\w*)')}", f"concat('rx', {ex(g, r'radeon\s*([0-9]{3,4}\w*)')})"),
            (f"contains({g}, 'radeon')", "'integrated'"), (f"contains({g}, 'arc')", "'intel arc'"),
        ],
        "'integrated'",
    )


def _media_gpu() -> str:
    rtx, gtx = ex(LT, r"rtx\s*(\d{4})"), ex(LT, r"gtx\s*(\d{4})")
    raw = case(
        [
            (f"contains({LT}, 'rtx')", f"concat('rtx', COALESCE({rtx}, '3050'))"),
            (f"contains({LT}, 'gtx')", f"CASE WHEN {gtx} IS NULL THEN 'integrated' ELSE concat('gtx', {gtx}) END"),
            (f"contains({LT}, 'iris xe')", "'iris xe'"), (f"contains({LT}, 'uhd')", "'intel uhd'"),
            (f"contains({LT}, 'radeon')", "'amd radeon'"),
        ],
        "'integrated'",
    )
    return f"CASE WHEN contains({LT}, 'macbook') OR {has(LT, 'm[12345]')} THEN 'apple integrated' ELSE {raw} END"


def _vatan_gpu() -> str:
    h = lambda p: has(V, p, True)
    e = lambda p, g=1: ex(V, p, g, True)
    fixed = [("RTX 50", r"rtx\s*50(90|80|70|60|50)"), ("RTX 40", r"rtx\s*40(90|80|70|60|50)"), ("RTX 30", r"rtx\s*30(90|80|70|60|50)"),
             ("GTX 16", r"gtx\s*16(60|50)"), ("GTX 10", r"gtx\s*10(80|70|60|50)"), ("MX ", r"mx\s*(570|550|450|350|330|250)")]
    rx = r"(?:rx|radeon)\s*([67])([0-9]00)([M]?)"
    return case(
        [(h(p), f"concat('{pre}', {e(p)})") for pre, p in fixed]
        + [
            (h(rx), f"concat('RX ', {e(rx)}, {e(rx, 2)}, COALESCE(upper({e(rx, 3)}), ''))"),
            (h(r"radeon\s*(\d{3})m"), f"concat('Radeon ', {e(r'radeon\s*(\d{3})m')}, 'M')"),
            (h(r"vega\s*(\d{1,2})"), f"concat('Radeon Vega ', {e(r'vega\s*(\d{1,2})')})"),
            (h(r"arc\s*([a-z]?\d{3,4}m?)"), f"concat('Intel Arc ', upper({e(r'arc\s*([a-z]?\d{3,4}m?)')}))"),
            (f"contains({LV}, 'iris xe')", "'Intel Iris Xe'"), (f"contains({LV}, 'iris plus')", "'Intel Iris Plus'"),
            (f"contains({LV}, 'iris')", "'Intel Iris'"), (any_of(LV, ["uhd", "hd graphics"]), "'Intel UHD'"),
            (f"{any_of(LV, ['macbook', 'mac '])} AND {h('m([1-4])')}", f"concat('Apple M', {e('m([1-4])')}, ' GPU')"),
        ],
        "'Integrated'",
    )


GPU = {"amazon": _amazon_gpu(), "incehesap": _inche_gpu(), "mediamarkt": _media_gpu(), "vatan": _vatan_gpu()}
