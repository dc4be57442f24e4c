"""Listings, titles and profiles made from the given star-schema tables.

The SQL runs in Spark and in DuckDB alike, so queries and their checks start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from shelfrank.sources.snapshot import input_state

LISTINGS = """
WITH k AS (
  SELECT o_orderkey AS seq, o_custkey AS pid, o_orderdate AS scraped_at,
         CAST(o_orderkey % 4 AS INT) AS v,
         CAST(4000 + CAST(floor(o_totalprice) AS BIGINT) % 120000 AS STRING) AS p
  FROM orders
), a AS (
  SELECT seq, pid, scraped_at, v, p,
    CASE v WHEN 0 THEN 'amazon' WHEN 1 THEN 'mediamarkt' WHEN 2 THEN 'incehesap' ELSE 'vatan' END AS source,
    CASE pid % 13 WHEN 0 THEN 'Apple MacBook Air' WHEN 1 THEN 'Lenovo Legion' WHEN 2 THEN 'ASUS TUF Gaming'
      WHEN 3 THEN 'Dell Inspiron' WHEN 4 THEN 'HP Victus' WHEN 5 THEN 'MSI Katana' WHEN 6 THEN 'Acer Nitro'
      WHEN 7 THEN 'Microsoft Surface' WHEN 8 THEN 'Huawei MateBook' WHEN 9 THEN 'Samsung Galaxy Book'
      WHEN 10 THEN 'Monster Tulpar' WHEN 11 THEN 'Casper Excalibur' ELSE 'Honor X14' END AS brand_txt,
    CASE (pid * 7) % 17 WHEN 0 THEN 'i9-14900HX' WHEN 1 THEN 'i7-13620H' WHEN 2 THEN 'i5-1340P' WHEN 3 THEN 'i5-1235U'
      WHEN 4 THEN 'Ryzen 7 7840HS' WHEN 5 THEN 'Ryzen 5 7535U' WHEN 6 THEN 'Ryzen AI 7 350' WHEN 7 THEN 'Core Ultra 7 155H'
      WHEN 8 THEN 'Intel Ultra 7 258V' WHEN 9 THEN 'M3' WHEN 10 THEN 'M2 Pro' WHEN 11 THEN 'Celeron N4500'
      WHEN 12 THEN 'ryzen7' WHEN 13 THEN 'i7' WHEN 14 THEN 'Snapdragon X Elite' WHEN 15 THEN 'Ryzen 9 8945HX' ELSE NULL END AS cpu,
    CASE (pid * 11) % 19 WHEN 0 THEN 'rtx4060' WHEN 1 THEN 'RTX 4050' WHEN 2 THEN 'RTX 4070 Ti' WHEN 3 THEN 'rtx 2060'
      WHEN 4 THEN 'GTX 1660 Ti' WHEN 5 THEN 'MX 450' WHEN 6 THEN 'rx7600m' WHEN 7 THEN 'AMD Radeon RX 7600' WHEN 8 THEN 'Intel Arc A770M'
      WHEN 9 THEN 'Iris Xe' WHEN 10 THEN 'intel uhd' WHEN 11 THEN 'Radeon 780M' WHEN 12 THEN 'Radeon Vega 8' WHEN 13 THEN 'Apple M3 GPU'
      WHEN 14 THEN 'apple integrated' WHEN 15 THEN 'amd radeon' WHEN 16 THEN 'integrated' WHEN 17 THEN '' ELSE NULL END AS gpu,
    CASE (pid * 3) % 8 WHEN 0 THEN '8GB' WHEN 1 THEN '16 GB' WHEN 2 THEN '8GB + 8GB (16 GB)' WHEN 3 THEN '32GB DDR5'
      WHEN 4 THEN '64' WHEN 5 THEN '16.0' WHEN 6 THEN 'belirsiz' ELSE NULL END AS ram,
    CASE (pid * 5) % 9 WHEN 0 THEN '512GB' WHEN 1 THEN '1TB SSD' WHEN 2 THEN '256 GB' WHEN 3 THEN '1000GB' WHEN 4 THEN '500 GB'
      WHEN 5 THEN '2 TB' WHEN 6 THEN '1024.0' WHEN 7 THEN '1GB' ELSE NULL END AS ssd,
    CASE (pid * 2) % 7 WHEN 0 THEN '15.6"' WHEN 1 THEN '14,0 inc' WHEN 2 THEN '13.3"' WHEN 3 THEN '16 . 1"' WHEN 4 THEN '17.3"'
      WHEN 5 THEN '144Hz 16.0' ELSE NULL END AS screen_size,
    CASE (pid * 4) % 9 WHEN 0 THEN 'Windows 11' WHEN 1 THEN 'W11P' WHEN 2 THEN 'macOS' WHEN 3 THEN 'Ubuntu' WHEN 4 THEN 'FreeDOS'
      WHEN 5 THEN 'Yok' WHEN 6 THEN 'ChromeOS' ELSE NULL END AS os
  FROM k
)
SELECT seq, source, scraped_at,
  CASE WHEN pid % 29 = 0 THEN NULL ELSE concat('https://shop.example/', source, '/p/', CAST(pid AS STRING)) END AS url,
  concat(brand_txt, ' ', coalesce(cpu, ''), ' ', coalesce(ram, ''), ' RAM ', coalesce(ssd, ''), ' SSD ', coalesce(gpu, ''), ' ', coalesce(os, '')) AS name,
  CASE WHEN seq % 31 = 0 THEN NULL
       WHEN v = 0 THEN concat(substr(p, 1, length(p) - 3), '.', right(p, 3), ',00 TL')
       WHEN v = 1 THEN concat(substr(p, 1, length(p) - 3), '.', right(p, 3), ' TL')
       WHEN v = 2 THEN p
       ELSE concat(substr(p, 1, length(p) - 3), '.', right(p, 3)) END AS price,
  screen_size, ssd, cpu, ram, os, gpu
FROM a
"""

# One profile per nation and market segment, from all customers: the segment gives the usage,
# the nation the developer and productivity kinds, the customers the budget and the lists.
PROFILES = """
WITH g AS (
  SELECT c_nationkey AS nation, c_mktsegment AS segment, CAST(sum(c_custkey) AS BIGINT) AS k FROM customer
  GROUP BY c_nationkey, c_mktsegment
)
SELECT concat(CAST(nation AS STRING), '-', segment) AS profile_id,
  CASE segment WHEN 'AUTOMOBILE' THEN 'gaming' WHEN 'BUILDING' THEN 'portability' WHEN 'FURNITURE' THEN 'productivity'
    WHEN 'HOUSEHOLD' THEN 'design' ELSE 'dev' END AS usage_key,
  CAST(5000 + (k * 37) % 20000 AS DOUBLE) AS min_budget,
  CAST(5000 + (k * 37) % 20000 + CASE WHEN k % 6 = 0 THEN 60 ELSE 10000 + (k * 53) % 60000 END AS DOUBLE) AS max_budget,
  CASE nation % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'ml' WHEN 2 THEN 'mobile' WHEN 3 THEN 'gamedev' ELSE 'general' END AS dev_mode,
  CASE nation % 4 WHEN 0 THEN 'office' WHEN 1 THEN 'data' WHEN 2 THEN 'light_dev' ELSE 'multitask' END AS productivity_profile,
  CAST(CASE WHEN nation % 3 = 0 THEN 7.5 ELSE 6.0 END AS DOUBLE) AS min_gpu_score_required,
  CASE WHEN nation % 7 = 3 THEN split('lenovo,apple,asus,hp', ',') END AS allowed_brands,
  CASE WHEN nation % 8 = 5 THEN split('windows,macos', ',') END AS allowed_oses,
  CASE WHEN nation % 6 = 2 THEN 16 END AS min_ram,
  CASE WHEN nation % 9 = 4 THEN 512 END AS min_ssd,
  nation % 2 = 0 AS exclude_apple_in_gaming,
  CAST(3 + k % 8 AS INT) AS top_n
FROM g
"""

# Titles with the screen in them, as shops write them.
TITLES = f"""
SELECT seq, source, price AS price_text, concat_ws(' ', name, screen_size) AS title,
  concat_ws(' ', screen_size, cpu, gpu) AS specs
FROM ({LISTINGS}) AS listings_base
"""

# Each listing's shopper: the profile of the customer's nation and segment.
OWN_PROFILE = """
SELECT o_orderkey AS seq, concat(CAST(c_nationkey AS STRING), '-', c_mktsegment) AS profile_id
FROM orders JOIN customer ON c_custkey = o_custkey
"""

STOCK_HINTS = """
SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN concat('Durum: ', 'TÜKENDİ'  , ' tükendi')
  WHEN 'O' THEN 'Stokta var, hızlı kargo' ELSE o_orderpriority END AS hint
FROM orders
"""

NOISE = f"""
SELECT seq, CASE WHEN seq % 11 = 3 THEN concat('ÜRÜN SİLİNECEK ', name) WHEN seq % 11 = 5 THEN NULL ELSE name END AS title
FROM ({LISTINGS}) AS listings_base
"""

LABELLED = f"""
SELECT seq, concat('Ekran: ', coalesce(screen_size, '-'), chr(10),
  CASE seq % 3 WHEN 0 THEN 'Isletim Sistemi : ' WHEN 1 THEN 'Operating System -' ELSE 'Sistem: ' END, coalesce(os, ''), chr(10),
  'Bellek: ', coalesce(ram, ''), ' GB') AS specs
FROM ({LISTINGS}) AS listings_base
"""

CARD_TEXT = f"""
SELECT seq, concat('Yeni', chr(10), ' ', name, ' ', chr(10), 'Puan 4,5', chr(10), coalesce(price, 'fiyat yok'), chr(10), 'Sepete ekle') AS card
FROM ({LISTINGS}) AS listings_base
"""

TITLE_CHOICE = """CASE substr(profile_id, 1, 1) WHEN '1' THEN 'Starfield;Lies of P' WHEN '2' THEN 'Forza Horizon 5'
  WHEN '3' THEN 'Apex/Fortnite (yüksek ayar)' WHEN '4' THEN 'Cyberpunk 2077 (2.0);Helldivers 2;Lies of P' END"""
DESIGN_CHOICE = """CASE substr(profile_id, 1, 1) WHEN '1' THEN 'graphic;3d' WHEN '2' THEN 'video' WHEN '3' THEN 'cad;graphic'
  WHEN '4' THEN 'graphic' END"""

# Shop pages written from the listings, one page per listing.
_PAGE = "SELECT seq AS page_id, concat('https://shop.example/list/', CAST(seq AS STRING)) AS url, {html} AS html FROM ({rows}) AS listings_base"
MADE_PAGES = {
    "amazon": _PAGE.format(rows=LISTINGS, html="""concat('<html><body><div class="s-main"><div data-component-type="s-search-result" data-asin="B',
      CAST(seq AS STRING), '">', CASE WHEN seq % 7 = 2 THEN '<span class="s-label-popover-default">Sponsored</span>' ELSE '' END,
      '<h2><a class="a-link-normal" href="/dp/', CAST(seq AS STRING), '"><span>', name, '</span></a></h2>',
      CASE WHEN price IS NULL THEN '' ELSE concat('<span class="a-price"><span class="a-offscreen">', price, '</span></span>') END,
      '</div></div></body></html>')"""),
    "vatan": _PAGE.format(rows=LISTINGS, html="""concat('<html><body><div class="product-list"><a href="/urun/', CAST(seq AS STRING), '">',
      '<div class="product-list__product-name"><h3>', name, ' 12.345 TL</h3></div></a><span class="product-list__price">',
      coalesce(price, ''), '</span></div></body></html>')"""),
    "mediamarkt": _PAGE.format(rows=LISTINGS, html="""concat('<html><body><article><a href="/tr/product/', CAST(seq AS STRING), '">Yeni</a><p>', name,
      '</p><p>', coalesce(price, 'fiyat yok'), '</p></article></body></html>')"""),
    "incehesap": _PAGE.format(rows=LISTINGS, html="""concat('<html><body><ul><li class="prd"><a class="prd-link" href="/urun/', CAST(seq AS STRING), '">git</a>',
      '<h3 class="prd-title">', name, '</h3><div class="price">', coalesce(price, ''), '</div></li></ul></body></html>')"""),
    # Some product pages have no price of their own. Cards of a list find a page for two of three.
    "detail": f"""SELECT seq AS page_id, concat('https://shop.example/urun/', CAST(seq AS STRING)) AS url,
      concat('<html><body><h1> ', CASE WHEN seq % 13 = 4 THEN 'ÜRÜN SİLİNECEK ' ELSE '' END, name, ' </h1><div class="price">yeni</div>',
        CASE WHEN seq % 5 = 1 OR price IS NULL THEN '' ELSE concat('<span class="old-fiyat">', price, '</span>') END,
        '<div class="stok">', CASE seq % 3 WHEN 0 THEN 'Tükendi' WHEN 1 THEN 'Stokta var' ELSE '' END, '</div>',
        '<table><tr><td>RAM</td><td>', coalesce(ram, '-'), '</td></tr></table><dl><dt>Ekran</dt><dd>', coalesce(screen_size, '-'),
        '</dd></dl></body></html>') AS html
      FROM ({LISTINGS}) AS listings_base""",
}
MADE_PAGES["detail_all"], MADE_PAGES["detail"] = MADE_PAGES["detail"], MADE_PAGES["detail"] + " WHERE seq % 3 <> 2"


#: Stored bytes whose rows one task reads text from.
PIECE_BYTES = 1 << 20


def spread(df: DataFrame, stored_bytes: int) -> DataFrame:
    """Input dealt out by its size: to pieces of about PIECE_BYTES, and to all cores at least.

    Parsing text is far dearer than moving it. A file is read by as many tasks as it has row
    groups at most, which may be few however large it is, so its pieces as read don't count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-stored_bytes // PIECE_BYTES)))


def stored_bytes(spark: SparkSession, path: str) -> int:
    return sum(int(length) for _, length, _ in input_state(spark, path))


def sql_over(spark: SparkSession, sf_dir: str, query: str, parses: bool = True) -> DataFrame:
    """Runs SQL over the parquet tables it names, without leaving views behind.

    ``parses``: whether rows are read as text or made into it afterwards, which is to be dealt out.
    """
    tables = sorted(set(re.findall(r"\b(?:FROM|JOIN) (orders|customer|nation|pages)\b", query)))
    paths = {t: f"{sf_dir}/{t}.parquet" for t in tables}
    frames = {t: spark.read.parquet(p) for t, p in paths.items()}
    if parses:
        frames = {t: spread(f, stored_bytes(spark, paths[t])) for t, f in frames.items()}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (orders|customer|nation|pages)\b", r"\1 {\2}", query), **frames)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_over(spark, sf_dir, LISTINGS)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_over(spark, sf_dir, PROFILES, parses=False)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_over(spark, sf_dir, TITLES)
