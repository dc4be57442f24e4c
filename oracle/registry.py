"""Check SQL by query name."""

from __future__ import annotations

from oracle import vendor_sql as V
from oracle.sql import (
    BRAND, CLEANED, CPU_SCORE, DEV_FIT, OS, OWN, OWN_SCORED, POINTS, PREPARED, PRICE, RAM, SCREEN, SSD, case, cpu_suffix, cuda,
    dbl, dgpu, diverse, any_of, ex, gpu_label, gpu_score, has, mix, num, r6, rec_ctes, recommend, scored, text, tier, weight,
)
from shelfrank import rules
from shelfrank.functions import amazon, incehesap
from shelfrank.sources import driver_tables as D


def over(select: str, rows: str = D.LISTINGS, where: str = "") -> str:
    return f"SELECT {select} FROM ({rows}) AS q {where}"


def _tag(gpu: str, cpu: str, os: str) -> tuple[str, str, str]:
    card = r"((?:rtx|gtx|mx)\s*\d{3,4})"
    g, o = f"lower({gpu})", f"lower({os})"
    gpu_tag = case(
        [(f"{gpu} IS NULL", "'integrated'")] + [(f"contains({g}, {text(k)})", text(v)) for k, v in amazon.GPU_TAGS]
        + [(has(g, card), f"replace({ex(g, card)}, ' ', '')")],
        "'integrated'",
    )
    os_tag = case(
        [(any_of(o, ["windows 11", "win11", "w11"]), "'Windows 11'"), (any_of(o, ["windows 10", "win10", "w10"]), "'Windows 10'"),
         (f"contains({o}, 'mac')", "'macOS'"), (any_of(o, ["linux", "ubuntu", "debian"]), "'Linux'"),
         (f"contains({o}, 'chrome')", "'ChromeOS'")], "'FreeDOS'")
    return gpu_tag, f"COALESCE(replace(trim(upper({cpu})), 'CORE ', ''), 'i5')", os_tag


def _tags() -> str:
    gpu, cpu, os = _tag("gpu", "cpu", "os")
    return over(f"seq, {gpu} AS gpu_tag, {cpu} AS cpu_tag, {os} AS os_tag")


def _attributes(shop: str) -> str:
    """The six hardware columns of a shop, from title and specs."""
    return f"""{V.SCREEN[shop]} AS screen_size, {V.STORAGE[shop]} AS ssd, {V.CPU[shop]} AS cpu, {V.MEMORY[shop]} AS ram, {V.OS[shop]} AS os, {V.GPU[shop]} AS gpu"""


def _brand_and_model(name: str) -> tuple[str, str]:
    t = f"trim(regexp_replace({name}, '\\s+', ' ', 'g'))"
    w = f"upper(string_split({t}, ' ')[1])"
    brand = case([(f"{w} = '{k}'", f"'{v}'") for k, v in incehesap.BRAND_NAMES.items()], f"concat(upper(left({w}, 1)), lower(substr({w}, 2)))")
    return brand, f"trim(substr({t}, length(string_split({t}, ' ')[1]) + 1))"


def _brand_model() -> str:
    brand, model = _brand_and_model("name")
    return over(f"seq, {brand} AS brand, {model} AS model")


def _page_links() -> str:
    link = """CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
      WHEN starts_with(href, '//') THEN concat(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1), href)
      WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), href)
      WHEN starts_with(href, '#') THEN concat(regexp_replace(url, '#.*$', ''), href)
      ELSE concat(regexp_extract(url, '^([a-z]+://[^?#]*/)', 1), href) END"""
    body = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
    return f"""SELECT page_id, CAST(pos - 1 AS INT) AS pos, {link} AS link, regexp_matches(href, '/urun/|/notebook-|/laptop-') AS is_product
      FROM (SELECT page_id, url, replace(unnest(hrefs), '&amp;', '&') AS href, generate_subscripts(hrefs, 1) AS pos
            FROM (SELECT page_id, url, regexp_extract_all({body}, '(?i)<a\\b[^>]*\\shref="([^"]*)"', 1) AS hrefs FROM pages) AS a) AS b"""


def _page_titles() -> str:
    t = "regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')"
    for e, c in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
        t = f"replace({t}, '{e}', '{c}')"
    return f"SELECT page_id, NULLIF(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '') AS title FROM pages"


TIDY_NAME = "trim(regexp_replace(name, '\\s+', ' ', 'g'))"
PRICE_TEXT = f"SELECT *, price AS price_text FROM ({D.LISTINGS}) AS pt"


def _details(columns: str) -> str:
    """Product pages of all listings, with their own price unless it is held back."""
    title = f"concat(CASE WHEN seq % 13 = 4 THEN 'ÜRÜN SİLİNECEK ' ELSE '' END, {TIDY_NAME})"
    return f"""SELECT {columns} FROM (
      SELECT *, trim({title}) AS title, CASE WHEN seq % 5 <> 1 THEN {V.PRICE['incehesap']} END AS own_price,
        concat('RAM ', COALESCE(ram, '-'), ' | ', 'Ekran ', COALESCE(screen_size, '-')) AS specs
      FROM ({PRICE_TEXT}) AS d0) AS d1"""


def _incehesap_listings() -> str:
    """Two of three cards find a product page, from which the hardware comes; the others have none."""
    page = lambda e, other="NULL": f"CASE WHEN paged THEN {e} ELSE {other} END"
    apple = has("title", r"\b(apple|macbook|mac\s|m[1-5])\b", True)
    return f"""SELECT concat('https://shop.example/urun/', CAST(seq AS STRING)) AS url, title AS name, {V.PRICE['incehesap']} AS price,
        {page(f"CAST({V.SCREEN['incehesap']} AS DOUBLE)")} AS screen_size, {page(f"CAST({V.STORAGE['incehesap']} AS DOUBLE)")} AS ssd,
        {page(V.CPU['incehesap'], "''")} AS cpu, {page(f"CAST({V.MEMORY['incehesap']} AS DOUBLE)")} AS ram, {page(V.OS['incehesap'], "''")} AS os,
        {page(V.GPU['incehesap'], f"CASE WHEN {apple} THEN 'apple integrated' ELSE 'integrated' END")} AS gpu
      FROM (SELECT *, {TIDY_NAME} AS title, seq % 3 <> 2 AS paged, concat('RAM ', COALESCE(ram, '-'), ' | ', 'Ekran ', COALESCE(screen_size, '-')) AS specs
        FROM ({PRICE_TEXT}) AS p0) AS p1 WHERE NOT (paged AND seq % 13 = 4)"""


def _of_usage(usage: str) -> str:
    return f"SELECT * FROM ({D.PROFILES}) AS pu WHERE usage_key = '{usage}'"


def _filtered(usage: str, fallback: bool) -> str:
    return f"""{rec_ctes(_of_usage(usage))} SELECT profile_id, count(*) AS n_rows, CAST(sum(seq) AS BIGINT) AS seq_sum, min(price) AS min_price
      FROM {'kept' if fallback else 'strict_rows'} GROUP BY profile_id"""


def all_sql() -> dict[str, str]:
    label = f"({gpu_label('gpu')})"
    with_label = f"SELECT *, {gpu_label('gpu')} AS gpu_norm FROM ({D.LISTINGS}) AS g0"
    q = {
        "clean_price": over(f"seq, {PRICE} AS price"),
        "clean_ram": over(f"seq, {RAM} AS ram_gb"),
        "clean_ssd": over(f"seq, {SSD} AS ssd_gb"),
        "parse_screen": over(f"seq, {SCREEN} AS screen"),
        "extract_brand": over(f"seq, {BRAND} AS brand"),
        "detect_os": over(f"seq, {OS} AS os"),
        "cpu_score": over(f"seq, {CPU_SCORE} AS cpu_score"),
        "gpu_label": over(f"seq, {label} AS gpu_norm"),
        "gpu_score_from_label": over(f"seq, {gpu_score('gpu_norm')} AS gpu_score", with_label),
        "gpu_score_raw": over(f"seq, {gpu_score('gpu')} AS gpu_score"),
        "cpu_suffix": over(f"seq, {cpu_suffix('cpu')} AS suffix"),
        "gpu_flags": over(f"seq, {dgpu('gpu_norm')} AS dgpu, {cuda('gpu_norm')} AS cuda, {tier('gpu_norm')} AS tier", with_label),
        "vendor_tags": _tags(),
        "brand_model": _brand_model(),
        "title_blob": over("seq, concat_ws(' | ', COALESCE(name, ''), NULLIF(cpu, ''), NULLIF(gpu, ''), NULLIF(os, '')) AS blob"),
        "safe_numeric": over(f"seq, {dbl('ram')} AS ram, {dbl('ssd')} AS ssd"),
        "clean_data": over(f"seq, url, name, price, ram_gb, ssd_gb, screen_size, brand, os, {num(5)} AS cpu_score, {num(3)} AS gpu_score", CLEANED),
        "prepare": over("seq, price, cpu_score, gpu_norm, gpu_score", PREPARED),
        "stock_status": "SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'out_of_stock' WHEN 'O' THEN 'in_stock' ELSE 'unknown' END AS status FROM orders",
        "noise_titles": over("seq, title", D.NOISE, "WHERE title IS NULL OR NOT contains(title, 'ÜRÜN SİLİNECEK')"),
        "labelled_value": over(
            "seq, NULLIF(CASE WHEN seq % 3 < 2 THEN COALESCE(NULLIF(os, ''), concat('Bellek: ', COALESCE(ram, ''), ' GB')) END, '') AS value"),
        "union_by_name": over(
            """seq, source, CASE WHEN source <> 'mediamarkt' THEN url END AS url, name, price,
            CASE WHEN source <> 'amazon' THEN screen_size END AS screen_size, CASE WHEN source <> 'incehesap' THEN os END AS os,
            CASE WHEN source <> 'incehesap' THEN gpu END AS gpu"""),
        "listing_schema": over(
            """CASE WHEN source <> 'mediamarkt' THEN url END AS url, name, price, CASE WHEN source <> 'amazon' THEN screen_size END AS screen_size,
            ssd, CAST(NULL AS STRING) AS cpu, ram, CAST(NULL AS STRING) AS os, CASE WHEN source <> 'incehesap' THEN gpu END AS gpu"""),
        "inventory": over("source AS shop, CAST(count(*) AS BIGINT) AS n_rows", where="GROUP BY source") + " UNION ALL SELECT 'empty', CAST(0 AS BIGINT)",
        "csv_round_trip": over("seq, price, ram_gb, ssd_gb, screen_size, brand, os", CLEANED),
        "dataset_cache": over("seq, price, ram_gb, ssd_gb, screen_size, brand, os", CLEANED),
        "history_append": over("source, count(*) AS n_rows, CAST(sum(seq) AS BIGINT) AS seq_sum", where="GROUP BY source"),
        "new_listings_anti": f"""SELECT seq, url FROM ({D.LISTINGS}) AS n WHERE scraped_at >= TIMESTAMP '1998-01-01' AND NOT EXISTS (
            SELECT 1 FROM ({D.LISTINGS}) AS h WHERE h.scraped_at < TIMESTAMP '1998-01-01' AND h.url = n.url)""",
        "vendor_dedup": over("seq, name", where="WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1"),
        "budget_filter": f"{rec_ctes()} SELECT profile_id, n_in, n_thin, n_cap5, n_cap6, n_strict, n_pass, relaxed FROM decided",
        "weights": over(f"profile_id, {', '.join(f'{weight(p)} AS {p}' for p in rules.PARTS)}, {mix(0)} AS cpu, {mix(1)} AS gpu", D.PROFILES),
        "score_parts": over(f"seq, {', '.join(f'round(part_{p}, 6) AS {p}' for p in rules.PARTS)}", OWN_SCORED),
        "score_breakdown": over(
            "seq, concat_ws(' | ', " + ", ".join(f"concat('{p}:', printf('%.1f', part_{p}))" for p in rules.PARTS) + ") AS score_breakdown", OWN_SCORED),
        "dedup_url": over("seq, url, price", PREPARED, "QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1"),
        "dedup_name_price": over(
            "seq, name, price", over("*", PREPARED, "QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1"),
            "QUALIFY row_number() OVER (PARTITION BY name, price ORDER BY seq) = 1"),
        "rank": f"""SELECT profile_id, CAST(rank AS INT) AS rank, seq, price FROM (
            SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, price, seq) AS rank FROM ({OWN_SCORED}) AS r0) AS r1""",
        "gaming_top5_plain": f"""{rec_ctes(_of_usage('gaming'))}
            SELECT profile_id, CAST(row_number() OVER w AS INT) AS rank, seq, price, {r6('score')} AS score FROM ({scored('SELECT * FROM w2')}) AS s
            WINDOW w AS (PARTITION BY profile_id ORDER BY score DESC, price, seq) QUALIFY row_number() OVER w <= 5""",
        "diverse_topn": over(f"profile_id, rank, seq, brand, {r6('score')} AS score", diverse(OWN_SCORED)),
        "recommend_batch": recommend(),
        "rec_summary": f"""SELECT profile_id, {r6('avg(score)')} AS avg_score, min(price) AS min_price, max(price) AS max_price, count(*) AS n FROM (
            {rec_ctes()}, sc AS ({scored('SELECT * FROM w2')}) {diverse('SELECT * FROM sc')}) AS t GROUP BY profile_id""",
        "title_requirement": over(
            f"""profile_id, greatest({num(6)}, {case([("substr(profile_id, 1, 1) = '1'", num(7.5)), ("substr(profile_id, 1, 1) = '2'", num(6.5)),
            ("substr(profile_id, 1, 1) = '3'", num(5)), ("substr(profile_id, 1, 1) = '4'", num(6.8))], num(6))}) AS min_gpu_score_required""", D.PROFILES),
        "design_hints": over(
            """profile_id, CASE substr(profile_id, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'mid' WHEN '3' THEN 'mid' ELSE 'low' END AS design_gpu_hint,
            CASE WHEN substr(profile_id, 1, 1) IN ('1', '2', '3') THEN 32 ELSE 16 END AS design_min_ram_hint""", D.PROFILES),
        "dataset_size": over("count(*) AS n_rows", PREPARED),
        "first_rows": over("seq, name, price", PREPARED, "ORDER BY seq LIMIT 5"),
        "facet_brands": over("DISTINCT lower(brand) AS brand", PREPARED),
        "facet_os": over("DISTINCT os, CAST(list_position(['windows', 'macos', 'linux', 'freedos'], os) AS INT) AS position", PREPARED),
        "budget_slider": over(
            """min(price) AS min_price, max(price) AS max_price, count(price) AS n_priced,
            greatest(min(price), min(price) + (max(price) - min(price)) // 3) AS default_upper""", PREPARED),
        "ram_distribution": over("ram, count(*) AS n", over(f"{V.MEMORY['vatan']} AS ram", D.TITLES), "GROUP BY ram"),
        "gpu_top10": over("gpu, count(*) AS n, min(seq) AS first_seq", over(f"seq, {V.GPU['vatan']} AS gpu", D.TITLES), "GROUP BY gpu ORDER BY n DESC, first_seq LIMIT 10"),
        "price_stats": over(f"min(v) AS min_price, max(v) AS max_price, {r6('avg(v)')} AS avg_price", over(f"{V.PRICE['vatan']} AS v", D.TITLES)),
        "page_titles": _page_titles(),
        "page_links": _page_links(),
        "bad_pages": "SELECT page_id, html IS NULL OR html = '' OR " + any_of("lower(html)", [
            "captcha", "bot check", "automated access", "unusual traffic", "verify you are a human", "güvenlik kontrolü", "doğrulama",
            "/errors/validatecaptcha", "enter the characters you see below"]) + " AS blocked FROM pages",
        "page_prices": _details("seq AS page_id, own_price AS price"),
        "page_specs": _details(
            f"""seq AS page_id, concat('https://shop.example/urun/', CAST(seq AS STRING)) AS product_url, title, own_price AS price_try,
            CASE seq % 3 WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'in_stock' ELSE 'unknown' END AS stock_status,
            {_brand_and_model('title')[0]} AS brand, {_brand_and_model('title')[1]} AS model, {V._inche_cpu_text()} AS cpu, {V._inche_gpu_text()} AS gpu,
            {V.MEMORY['incehesap']} AS ram_gb, {V.STORAGE['incehesap']} AS storage_gb, {V.SCREEN['incehesap']} AS screen_inch, {V.OS['incehesap']} AS os"""),
        "card_lines": over(
            f"""seq, CASE WHEN length(trim(name)) > 20 AND {any_of('lower(name)', ['asus', 'lenovo', 'hp', 'dell', 'acer', 'msi', 'apple', 'macbook',
            'monster', 'casper', 'huawei', 'samsung', 'laptop', 'notebook'])} THEN trim(name) END AS name,
            CASE WHEN contains(price, 'TL') OR regexp_matches(price, '\\d{{2}}\\.\\d{{3}}') THEN {V.PRICE['mediamarkt']} END AS price""", PRICE_TEXT),
        "stream_append": over("source, count(*) AS n_rows, CAST(sum(seq) AS BIGINT) AS seq_sum", where="GROUP BY source"),
        "stream_dedup": over("DISTINCT url"),
        "stream_files": over("source, count(*) AS n_rows, count(url) AS n_url, count(name) AS n_name, count(price) AS n_price, count(cpu) AS n_cpu", where="GROUP BY source"),
        "page_listings_amazon": f"""SELECT concat('https://shop.example/dp/', CAST(seq AS STRING)) AS url, title AS name, CAST({V.PRICE['amazon']} AS STRING) AS price,
            screen_size, ssd, {_tag('gpu', 'cpu', 'os')[1]} AS cpu, ram, {_tag('gpu', 'cpu', 'os')[2]} AS os, {_tag('gpu', 'cpu', 'os')[0]} AS gpu
            FROM (SELECT seq, title, price_text, {_attributes('amazon')} FROM (SELECT seq, trim(name) AS title, price_text FROM ({PRICE_TEXT}) AS p0 WHERE seq % 7 <> 2) AS p1) AS p2""",
        "page_listings_vatan": f"""SELECT concat('https://shop.example/urun/', CAST(seq AS STRING)) AS url, title AS name, {V.PRICE['vatan']} AS price, {_attributes('vatan')}
            FROM (SELECT seq, trim(name) AS title, concat(trim(name), ' 12.345 TL ', price_text) AS specs, price_text FROM ({PRICE_TEXT}) AS p0) AS p1
            WHERE {V.PRICE['vatan']} IS NOT NULL""",
        "page_listings_mediamarkt": f"""SELECT concat('https://shop.example/tr/product/', CAST(seq AS STRING)) AS url, title AS name, price, {_attributes('mediamarkt')} FROM (
            SELECT seq, trim(name) AS title, concat('Yeni', chr(10), trim(name), chr(10), COALESCE(price, 'fiyat yok')) AS specs,
              CASE WHEN contains(price, 'TL') OR regexp_matches(price, '\\d{{2}}\\.\\d{{3}}') THEN {V.PRICE['mediamarkt']} END AS price
            FROM ({PRICE_TEXT}) AS p0 WHERE length(trim(name)) > 20 AND {any_of('lower(name)', ['asus', 'lenovo', 'hp', 'dell', 'acer', 'msi', 'apple',
            'macbook', 'monster', 'casper', 'huawei', 'samsung', 'laptop', 'notebook'])}) AS p1
            WHERE price > 10000 QUALIFY row_number() OVER (PARTITION BY title ORDER BY seq) = 1""",
        "page_listings_incehesap": _incehesap_listings(),
    }
    for table, name in [(V.PRICE, "price"), (V.SCREEN, "screen"), (V.STORAGE, "ssd"), (V.MEMORY, "ram"), (V.CPU, "cpu"), (V.OS, "os"), (V.GPU, "gpu")]:
        q.update({f"vendor_{name}_{shop}": over(f"seq, {e} AS value", D.TITLES) for shop, e in table.items()})
    for usage in rules.USAGES:
        q[f"usage_filter_{usage}"] = _filtered(usage, False)
        q[f"usage_fallback_{usage}"] = _filtered(usage, True)
        q[f"score_total_{usage}"] = over(f"seq, profile_id, {r6('score')} AS score", OWN_SCORED, f"WHERE usage_key = '{usage}'")
        q[f"recommend_{usage}"] = recommend(_of_usage(usage))
    q.update({f"dev_fit_{m}": over(f"seq, profile_id, {r6(DEV_FIT)} AS fit", OWN, f"WHERE dev_mode = '{m}'") for m in rules.DEV_PRESETS})
    return q
