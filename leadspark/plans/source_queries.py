"""Registered queries over search texts, listings of sources and text parsers, and their SQL.

Inputs are derived from the supplied tables by key arithmetic; the SQL states what was put in, or the rule.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import query_columns as Q
from ..operators import resolve as R
from ..operators.components import ensure_checkpoint_dir
from ..sources import listings, registry
from ..sources.payload import NORMALISERS
from . import oracle as O
from .derived import pick
from .queries import query

# ---- search texts: (category, its one-word swap, qualifiers), places, and the forms that join them

_CATEGORIES = [
    ("hospitals", "hospital", ""), ("cafe", "cafes", ""), ("best vegan indian food", "bests vegan indian food", "indian,vegan,best"), ("salons", "salon", ""), ("glass works", None, ""),
    ("it firms", None, ""), ("24/7 pharmacy", None, "24/7"), ("Luxury hotels", None, "luxury"), ("eye care delivery", "eyes care delivery", "delivery"),
]
_PLACES = ["Dubai", "Goa", "Paris", "New Delhi", "Eluru"]
_FORMS = ["{c} in {p}", "{c} near {p}", "{c}, {p}", " {c} at {p}. ", "{c}", "{c} close to {p}", "{c}, {p}, AP;"]


def _texts_sql() -> str:
    """k, category, swap, qualifiers, place (null where the text has none) and the text q."""
    c, s, u, p = (pick(i, v) for i, v in (("k % 9", [x[0] for x in _CATEGORIES]), ("k % 9", [x[1] for x in _CATEGORIES]), ("k % 9", [x[2] for x in _CATEGORIES]), ("k % 5", _PLACES)))
    part = lambda y: {"{c}": "c", "{p}": "p"}.get(y) or f"'{y}'"
    form = f"CASE k % 7 {' '.join(f'WHEN {i} THEN concat({", ".join(part(y) for y in re.split(r"({[cp]})", f) if y)})' for i, f in enumerate(_FORMS))} END"
    where = "CASE WHEN k % 7 = 4 THEN NULL WHEN k % 7 = 6 THEN concat(p, ', AP') ELSE p END"
    return f"SELECT k, c AS category, s AS swap, u AS qualifiers, {where} AS place, {form} AS q FROM (SELECT k, {c} AS c, {s} AS s, {u} AS u, {p} AS p FROM (SELECT CAST(p_partkey AS BIGINT) AS k FROM part) AS keys_) AS rows_"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(_texts_sql())


_T = f"WITH t AS MATERIALIZED ({_texts_sql()})"
_VARIED = "CASE WHEN place IS NULL THEN concat_ws('|', category, swap) ELSE concat_ws('|', category || ' in ' || place, category || ' ' || place, place || ' ' || category, category, swap) END"


@query(f"{_T} SELECT k, category, place AS location FROM t")
def query_parts(spark, sf_dir):
    """Category and location of search texts, by comma, preposition or none."""
    q = F.col("q")
    return _texts(spark, sf_dir).select("k", Q.bare_category(Q.category_of(q)).alias("category"), Q.location_of(q).alias("location"))


@query(f"{_T} SELECT k, qualifiers FROM t")
def query_qualifiers(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", F.array_join(Q.qualifiers_of(Q.category_of(F.col("q"))), ",").alias("qualifiers"))


@query(f"{_T} SELECT k, {_VARIED} AS variations FROM t")
def query_variations(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", F.array_join(Q.variations(F.col("category"), F.coalesce("place", F.lit(""))), "|").alias("variations"))


@query(f"{_T} SELECT k, CASE WHEN place IS NULL THEN '' WHEN contains(place, ', AP') THEN concat_ws('|', place, split_part(place, ',', 1), split_part(place, ',', 1) || ' AP') ELSE place END AS scopes FROM t")
def query_scopes(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", F.array_join(Q.scopes(F.col("place")), "|").alias("scopes"))


@query(f"""{_T}, v AS (SELECT *, trim(q) AS x, {_VARIED} AS v FROM t)
SELECT k, x AS text, category, place AS location, qualifiers, CASE WHEN list_contains(list_transform(string_split(v, '|'), lambda y: lower(y)), lower(x)) THEN v ELSE x || '|' || v END AS variations, CASE WHEN place IS NULL THEN 1 WHEN contains(place, ', AP') THEN 3 ELSE 1 END AS n_scopes FROM v""")
def interpreted_queries(spark, sf_dir):
    x = _texts(spark, sf_dir).select("k", Q.interpret(F.col("q")).alias("i"))
    return x.select("k", "i.text", "i.category", "i.location", F.array_join("i.qualifiers", ",").alias("qualifiers"), F.array_join("i.variations", "|").alias("variations"), F.size("i.scopes").alias("n_scopes"))


@query("""WITH t AS (SELECT k, c, CASE k % 3 WHEN 0 THEN 'shops of Delhi' WHEN 1 THEN 'Eye shops - Goa ' ELSE 'shops' END AS q, CASE WHEN k % 2 = 0 THEN ' Pune ' END AS given FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_name AS c FROM part))
SELECT k, CASE k % 3 WHEN 1 THEN 'Eye shops' ELSE 'shops' END AS category, CASE WHEN k % 2 = 0 THEN 'Pune' ELSE CASE k % 3 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'Goa' ELSE '' END END AS location FROM t""")
def query_pairs(spark, sf_dir):
    """Category and location as the sources split them, with locations that are given apart."""
    k = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"))
    k = k.selectExpr("k", "CASE k % 3 WHEN 0 THEN 'shops of Delhi' WHEN 1 THEN 'Eye shops - Goa ' ELSE 'shops' END AS q", "CASE WHEN k % 2 = 0 THEN ' Pune ' END AS given")
    return k.select("k", Q.split_category(F.col("q")).alias("category"), Q.split_location(F.col("q"), F.col("given")).alias("location"))


@query("""WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part)
SELECT k, CASE k % 3 WHEN 0 THEN 'Dubai' WHEN 1 THEN 'Pune' ELSE 'Eluru' END AS location, CASE k % 4 WHEN 0 THEN 'salons' WHEN 1 THEN 'eye care' WHEN 2 THEN 'salons' ELSE 'eye care' END AS category FROM t""")
def query_cities(spark, sf_dir):
    """Texts that name a known city at the end or at the start, without a preposition."""
    k = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"))
    city = "CASE k % 3 WHEN 0 THEN 'Dubai' WHEN 1 THEN 'Pune' ELSE 'Eluru' END"
    rows = k.selectExpr("k", f"CASE k % 4 WHEN 0 THEN concat('salons ', {city}) WHEN 1 THEN concat('eye care  ', {city}) WHEN 2 THEN concat({city}, ' salons') ELSE concat(' ', {city}, ' eye care') END AS q")
    return rows.select("k", Q.location_of(F.col("q")).alias("location"), Q.category_of(F.col("q")).alias("category"))


@query("""WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_name AS n FROM part), w AS (SELECT k, regexp_extract_all(n || ' Spas 24 as-is', '[A-Za-z]+|[^A-Za-z]+') AS w FROM t)
SELECT k, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z]') THEN array_to_string(list_transform(string_split(x, ''), lambda c: '[' || upper(c) || lower(c) || ']'), '') || CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN '?' ELSE '' END ELSE x END), '') AS pattern FROM w""")
def case_patterns(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").cast("long").alias("k"), Q.either_case(F.concat("p_name", F.lit(" Spas 24 as-is"))).alias("pattern"))


@query(f"{_T} SELECT k, CASE WHEN k % 7 IN (0, 1, 3) THEN lower(category) ELSE lower(trim(q)) END AS name FROM t")
def name_groups(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", Q.name_group(F.col("q")).alias("name"))


# ---- listings of the sources

_L = {
    "name": "CASE WHEN k % 31 = 0 THEN NULL ELSE concat('Shop ', CAST(k % 700 AS STRING), CASE WHEN k % 3 = 0 THEN ' Café' ELSE '' END) END", "address": f"CASE WHEN k % 5 = 4 THEN NULL ELSE concat(CAST(k % 90 AS STRING), ' MG Rd, ', {pick('k % 4', ['Eluru', 'Hyderabad', 'Old Town', 'Goa'])}, {pick('k % 3', ['', ', Karnataka', ', Goa 560001'])}) END",
    "phone": "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN concat('98 ', CAST(10000000 + k % 600 AS STRING)) ELSE '123' END", "website": "CASE WHEN k % 6 = 1 THEN concat('https://s', CAST(k AS STRING), '.in') END", "maps_url": "CASE WHEN k % 7 <> 0 THEN concat('https://maps/', CAST(k AS STRING)) END",
    "source_url": "CASE WHEN k % 8 <> 0 THEN concat('https://src/', CAST(k AS STRING)) END", "category": pick("k % 4", ["hospitals", "food", None, "retail"]), "product": pick("k % 3", ["pumps", None, "valves"]),
    "rating": "CASE WHEN k % 9 <> 0 THEN CAST((k % 10) * 0.5 AS DOUBLE) END", "reviews_count": "CASE WHEN k % 5 <> 0 THEN CAST(k % 40 AS INTEGER) END", "opening_hours": "CASE WHEN k % 10 = 3 THEN 'Open till 9' END",
    "latitude": "CASE WHEN k % 6 <> 2 THEN CAST(17.3 + (k % 20) * 0.01 AS DOUBLE) END", "longitude": "CASE WHEN k % 6 <> 2 THEN CAST(78.4 + (k % 20) * 0.01 AS DOUBLE) END", "seq": "k",
}
_LISTED = f"listed AS MATERIALIZED (SELECT {', '.join(f'{e} AS {c}' for c, e in _L.items())}, 'm' || (k % 2) AS method, 'https://find/' || (k % 5) AS search_url, k FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier))".replace("AS STRING)", "AS VARCHAR)")
_STATES = O.lst([s.lower() for s in C.STATES])
_PARTS = f"""parts AS (SELECT *, list_transform(string_split(coalesce(address, ''), ','), lambda x: trim(x)) AS p FROM listed
), placed AS (SELECT *, list_filter(p, lambda x: regexp_matches(x, '^[A-Za-z\\s]+$') AND length(x) > 2 AND lower(x) NOT IN {_STATES}) AS ok FROM parts
), split_ AS (SELECT *, CASE WHEN len(p) >= 2 AND list_contains(ok, p[-2]) THEN p[-2] ELSE list_reverse(list_filter(ok, lambda x: lower(x) <> 'india'))[1] END AS city, CASE WHEN len(p) > 1 AND lower(p[-1]) IN {_STATES} THEN p[-1] END AS state, nullif(regexp_extract(coalesce(address, ''), '\\b(\\d{{6}})\\b', 1), '') AS pin_code FROM placed)"""


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    found = F.struct(F.concat(F.lit("m"), (F.col("k") % 2).cast("string")).alias("extraction_method"), F.lit("q").alias("search_query"), F.concat(F.lit("https://find/"), (F.col("k") % 5).cast("string")).alias("search_url"), F.lit("page").alias("source_type"))
    return k.selectExpr("k", *[f"{e} AS {c}" for c, e in _L.items()]).withColumn("_provenance", found)


def _normalised(name: str):
    def run(spark, sf_dir):
        r = F.col("raw_data")
        return NORMALISERS[name](_listings(spark, sf_dir)).select("source_record_id", *[r[c].alias(c) for c in ("name", "address", "city", "state", "pin_code", "phone", "website", "industry", "latitude", "rating", "reviews_count", "opening_hours", "source_url")], r["metadata"]["extraction_method"].alias("method"), r["metadata"]["source_type"].alias("source_type"))

    return run


def _id_sql(prefix: str, url: str | None) -> str:
    return f"'{prefix}' || substr(md5(" + (f"coalesce(name, '') || '|' || coalesce({url}, '')" if url else f"'{prefix}' || coalesce(name, '')") + "), 1, 16)"


_WIDE = "latitude, rating, reviews_count, opening_hours"
_NONE = "NULL::DOUBLE AS latitude, NULL::DOUBLE AS rating, NULL::INTEGER AS reviews_count, NULL::VARCHAR AS opening_hours"
_NO_PLACE = "NULL::VARCHAR AS city, NULL::VARCHAR AS state, NULL::VARCHAR AS pin_code"
for _name, _prefix, _url, _rest in (
    ("google_maps_scraper", "gmaps_scraper_", "maps_url", f"coalesce(address, '') AS address, city, state, pin_code, category AS industry, {_WIDE}, coalesce(maps_url, search_url) AS source_url, method, 'page' AS source_type"),
    ("google_search", "gmaps_", "maps_url", f"coalesce(address, '') AS address, city, state, pin_code, category AS industry, {_WIDE}, coalesce(maps_url, search_url) AS source_url, method, 'page' AS source_type"),
    ("web_search", "web_", "source_url", f"address, {_NO_PLACE}, category AS industry, {_WIDE}, source_url, 'web_search' AS method, 'page' AS source_type"),
    ("indiamart", "imart_", "source_url", f"address, {_NO_PLACE}, product AS industry, {_NONE}, source_url, method, 'b2b_directory' AS source_type"),
    ("justdial", "jd_", None, f"address, {_NO_PLACE}, category AS industry, {_NONE}, search_url AS source_url, method, 'business_directory' AS source_type"),
):
    _f = _normalised(_name)
    _f.__name__ = f"listings_{_name}"
    query(f"WITH {_LISTED}, {_PARTS} SELECT {_id_sql(_prefix, _url)} AS source_record_id, name, phone, website, {_rest} FROM split_")(_f)


@query("""WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)
SELECT CASE WHEN k % 9 = 0 THEN '' ELSE 'p' || k END AS source_record_id, CASE WHEN k % 5 = 0 THEN '' ELSE 'Plåce ' || k END AS name, k || ' A St' AS address, CAST(k AS DOUBLE) AS latitude, k % 50 AS review_count, '+91 ' || k AS phone_intl, 'OPERATIONAL' AS business_status, 'cafe,food' AS types, 'https://g/' || k AS google_maps_url FROM k""")
def listings_google_places(spark, sf_dir):
    k = F.col("k")
    t = k.cast("string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    places = rows.select(
        F.when(k % 9 != 0, F.concat(F.lit("p"), t)).alias("id"), F.struct(F.when(k % 5 != 0, F.concat(F.lit("Plåce "), t)).alias("text")).alias("displayName"), F.concat(t, F.lit(" A St")).alias("formattedAddress"), F.struct(k.cast("double").alias("latitude"), k.cast("double").alias("longitude")).alias("location"),
        (k % 50).cast("int").alias("userRatingCount"), F.concat(F.lit("+91 "), t).alias("internationalPhoneNumber"), F.lit("OPERATIONAL").alias("businessStatus"), F.array(F.lit("cafe"), F.lit("food")).alias("types"), F.concat(F.lit("https://g/"), t).alias("googleMapsUri"),
    )
    r = F.col("raw_data")
    out = NORMALISERS["google_places"](places)
    return out.select("source_record_id", *[r[c].alias(c) for c in ("name", "address", "latitude", "phone_intl", "business_status", "google_maps_url")], r["review_count"].cast("long").alias("review_count"), F.array_join(r["types"], ",").alias("types"))


@query("""WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier), e AS (SELECT DISTINCT k // 2 AS i, CASE (k // 2) % 2 WHEN 0 THEN 'node' ELSE 'way' END AS type FROM k)
SELECT 'osm_' || type || '_' || i AS source_record_id, 'Om ' || i AS name, concat_ws(', ', CASE WHEN i % 2 = 0 THEN '12' END, 'Main St', CASE WHEN i % 5 <> 0 THEN 'Goa' END) AS address, CASE WHEN i % 5 <> 0 THEN 'Goa' END AS city, CASE WHEN i % 4 = 0 THEN '+91 ' || i WHEN i % 4 = 1 THEN '08' || i END AS phone,
  CASE i % 3 WHEN 0 THEN 'cafe' WHEN 1 THEN 'bakery' ELSE '' END AS industry, CASE type WHEN 'node' THEN CAST(i + 1 AS DOUBLE) ELSE CAST(i + 2 AS DOUBLE) END AS latitude, 'https://www.openstreetmap.org/' || type || '/' || i AS source_url FROM e WHERE i % 7 <> 3""")
def listings_openstreetmap(spark, sf_dir):
    """Each element comes twice; those without a name go."""
    i = F.col("i")
    t = i.cast("string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.floor(F.col("s_suppkey").cast("long") / 2).cast("long").alias("i"))
    tags = {"name": F.when(i % 7 != 3, F.concat(F.lit("Om "), t)), "addr:housenumber": F.when(i % 2 == 0, "12"), "addr:street": F.lit("Main St"), "addr:city": F.when(i % 5 != 0, "Goa"), "phone": F.when(i % 4 == 0, F.concat(F.lit("+91 "), t)), "contact:phone": F.when(i % 4 == 1, F.concat(F.lit("08"), t)), "amenity": F.when(i % 3 == 0, "cafe"), "shop": F.when(i % 3 == 1, "bakery")}
    every = F.map_filter(F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    way = i % 2 == 1
    osm = rows.select(F.when(way, "way").otherwise("node").alias("type"), i.alias("id"), F.when(~way, (i + 1).cast("double")).alias("lat"), F.when(~way, i.cast("double")).alias("lon"), F.struct((i + 2).cast("double").alias("lat"), i.cast("double").alias("lon")).alias("center"), every.alias("tags"))
    r = F.col("raw_data")
    return NORMALISERS["openstreetmap"](osm).select("source_record_id", *[r[c].alias(c) for c in ("name", "address", "city", "phone", "industry", "latitude", "source_url")])


@query(f"WITH {_LISTED} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY regexp_replace(lower(name), '[^a-z0-9]', '', 'g') ORDER BY seq) AS n FROM listed WHERE length(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]', '', 'g')) >= 3) WHERE n = 1")
def named_listings(spark, sf_dir):
    return registry.named_listings(_listings(spark, sf_dir)).select("seq")


@query(f"WITH {_LISTED} SELECT seq FROM listed WHERE contains(lower(coalesce(address, '')), 'hyderabad')")
def city_listings(spark, sf_dir):
    return registry.in_city(_listings(spark, sf_dir), "Hyderabad").select("seq")


@query("SELECT page_id FROM pages WHERE NOT contains(lower(html), 'unusual traffic') AND length(html) >= 500")
def readable_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where(registry.readable_page(F.col("html"))).select("page_id")


@query(f"WITH {_LISTED} SELECT seq FROM listed WHERE k % 2 = 1")
def fallback_listings(spark, sf_dir):
    """The first source has no row, so the next one is read, and the last one is not."""
    rows = _listings(spark, sf_dir)
    return registry.first_non_empty([rows.where("false"), rows.where("k % 2 = 1"), rows]).select("seq")


@query(f"SELECT name, name IN {O.lst(C.SELECTABLE_SOURCES)} AS selectable FROM (SELECT unnest([{', '.join(map(O.q, C.SOURCES))}]) AS name)")
def source_names(spark, sf_dir):
    return registry.listed(spark)


@query(f"""WITH {_LISTED}, {_PARTS}, a AS (
  SELECT 'google_search' AS source_adapter, {_id_sql('gmaps_', 'maps_url')} AS source_record_id, name, coalesce(address, '') AS address, city, state, phone, website, category AS industry, latitude, longitude, rating, reviews_count, maps_url, coalesce(maps_url, search_url) AS source_url, opening_hours, pin_code FROM (SELECT * FROM split_ WHERE k % 2 = 0 ORDER BY seq LIMIT 200)
  UNION ALL SELECT 'web_search', {_id_sql('web_', 'source_url')}, name, address, NULL, NULL, phone, website, category, latitude, longitude, rating, reviews_count, maps_url, source_url, opening_hours, NULL FROM (SELECT * FROM split_ WHERE k % 2 = 1 ORDER BY seq LIMIT 200)
) SELECT source_adapter, source_record_id, round_even(({' + '.join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" if f in ('rating', 'reviews_count', 'latitude', 'longitude') else f"CASE WHEN coalesce({f}, '') <> '' THEN 1 ELSE 0 END" for f in ('name', 'phone', 'address', 'website', 'industry', 'rating', 'reviews_count', 'latitude', 'longitude', 'opening_hours', 'city', 'state', 'pin_code'))} + {{}}) / 15.0 * 100, 1) AS completeness
FROM a WHERE contains(lower(concat_ws(' ', coalesce(address, ''), coalesce(city, ''), coalesce(state, ''), coalesce(name, ''))), 'karnataka')""".replace("{}", "CASE WHEN source_adapter = 'google_search' AND coalesce(maps_url, '') <> '' OR source_adapter = 'web_search' AND coalesce(maps_url, '') <> '' THEN 1 ELSE 0 END"))
def extracted(spark, sf_dir):
    """One search over two sources: at most 200 listings of each, those of the state asked for, with how complete they are."""
    rows = _listings(spark, sf_dir)
    found = {"google_search": rows.where("k % 2 = 0"), "web_search": rows.where("k % 2 = 1")}
    kept, _ = registry.extract(found, "org-1", "run-1", "", None, "Karnataka")
    return kept.select("source_adapter", "source_record_id", F.col("raw_data.metadata.completeness_score").alias("completeness"))


@query(f"""WITH {_LISTED} SELECT 'google_search' AS source_adapter, least(count(*), 200) AS n_listings FROM listed WHERE k % 3 = 0 UNION ALL SELECT 'justdial', least(count(*), 200) FROM listed WHERE k % 3 = 1""")
def extraction_goes_on(spark, sf_dir):
    """One of three sources cannot be read; the others' listings are kept, and the trouble is told."""
    rows = _listings(spark, sf_dir)
    broken = rows.withColumn("name", F.when(F.raise_error(F.lit("source is down")).isNull(), F.col("name")))
    errors: list[str] = []
    _, counts = registry.extract({"google_search": rows.where("k % 3 = 0"), "web_search": broken, "justdial": rows.where("k % 3 = 1")}, "o", "r", "", None, None, errors=errors)
    assert len(errors) == 1 and registry.run_status(1, errors) == "completed"
    return counts


@query(f"WITH {_LISTED} SELECT 'justdial' AS source_adapter, name, phone, rating FROM listed WHERE k % 4 <= 1")
def exchanged_listings(spark, sf_dir):
    """Listings as JSON lines in the shared folder, written and read in small splits by the library's own data source."""
    ensure_checkpoint_dir(spark)
    listings.register(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/listings-{uuid.uuid4().hex}"
    rows = _listings(spark, sf_dir).where("k % 4 <= 1").select("name", "phone", "rating", F.col("category"))
    rows.write.format("lead_listings").mode("append").save(path)
    back = spark.read.format("lead_listings").option("source", "justdial").option("split_bytes", 2000).load(path)
    return back.where(F.col("source_adapter") == "justdial").select("source_adapter", "name", "phone", "rating")


@query(f"WITH {_LISTED} SELECT 'web_search' AS source_adapter, name, phone, rating FROM listed WHERE k % 4 <> 3 AND rating >= 3")
def followed_listings(spark, sf_dir):
    """Listings that arrive as JSON lines in three steps, followed by a stream of the library's own data source that is stopped and started between."""
    ensure_checkpoint_dir(spark)
    listings.register(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/followed-{uuid.uuid4().hex}"
    for step in range(3):
        _listings(spark, sf_dir).where(f"k % 4 = {step}").select("name", "phone", "rating").coalesce(2).write.format("lead_listings").mode("append").save(f"{base}/in")
        time.sleep(2 * listings.SETTLED)
        rows = spark.readStream.format("lead_listings").option("source", "web_search").load(f"{base}/in").where("rating >= 3").select("source_adapter", "name", "phone", "rating")
        run = rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/out")
        run.processAllAvailable()
        run.stop()
    return spark.read.parquet(f"{base}/out")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey % 50 AS BIGINT) AS n FROM supplier ORDER BY s_suppkey LIMIT 20")
def places(spark, sf_dir):
    """One answer of the places API: its cap and the fields that are asked for."""
    k = F.col("s_suppkey").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("string").alias("id"), (k % 50).cast("int").alias("userRatingCount"), k.alias("seq"), F.lit("x").alias("notAsked"))
    page = registry.places_page(rows)
    assert page.columns == ["id", "userRatingCount"]
    return page.select("id", F.col("userRatingCount").cast("long").alias("n"))


# ---- text parsers


@query("""WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)
SELECT k, CAST(3 + (k % 4) * 0.5 AS DOUBLE) AS rating, CASE WHEN k % 2 = 0 THEN CAST(1200 + k % 700 AS INTEGER) END AS reviews_count, 'Cafe' AS category, k || ' MG Road' AS address, CASE WHEN k % 3 = 0 THEN '098765 43210' WHEN k % 3 = 1 THEN '+91 80 2345 6789' END AS phone,
  CASE WHEN k % 3 <> 2 THEN 'Closes 9 pm' END AS opening_hours, CASE WHEN k % 5 <> 0 THEN CAST(16 + k % 10 AS DOUBLE) END AS latitude, CASE WHEN k % 5 <> 0 THEN CAST(81 AS DOUBLE) END AS longitude FROM k""")
def listing_texts(spark, sf_dir):
    """What the lines of a map listing say."""
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    t = F.col("k").cast("string")
    line = lambda test, *xs: F.when(test, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])).otherwise("")
    text = F.concat(
        F.lit("Star Cafe\n"), (F.lit(3) + (F.col("k") % 4) * 0.5).cast("decimal(2,1)").cast("string"), F.lit("\n"), line(F.col("k") % 2 == 0, F.format_number(F.lit(1200) + F.col("k") % 700, 0), " reviews\n"),
        F.lit("Cafe · "), t, F.lit(" MG Road\n"), line(F.col("k") % 3 == 0, "Closes 9 pm · 098765 43210\n"), line(F.col("k") % 3 == 1, "Closes 9 pm · \n+91 80 2345 6789\n"),
    )
    href = line(F.col("k") % 5 != 0, "https://m/!3d", (F.lit(16) + F.col("k") % 10).cast("string"), "!4d81!x")
    return k.select("k", T.listing_fields(text, href).alias("f")).select("k", "f.*")


@query("""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) SELECT k, '98765' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') || CASE WHEN k % 2 = 0 THEN ',+918023456789' ELSE '' END AS phones FROM c""")
def phones_in_text(spark, sf_dir):
    k = F.col("k")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    text = F.concat(F.lit("call 98765"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit(" or 12-34, "), F.when(k % 2 == 0, "+91 8023456789 now").otherwise("none"))
    return rows.select("k", F.array_join(T.phones_in(text), ",").alias("phones"))


@query("""WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)
SELECT k, CASE k % 4 WHEN 0 THEN 'Star Hotel ' || k WHEN 1 THEN 'Om ' || k WHEN 2 THEN 'Lotus ' || k ELSE '' END AS directory_name, CASE k % 5 WHEN 0 THEN 'Star Clinic ' || k WHEN 1 THEN 'Om Care ' || k END AS snippet_name FROM k""")
def listing_names(spark, sf_dir):
    """Names without what a directory or a search result appends; lists and articles name no business."""
    k = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    named = k.selectExpr("k", "CASE k % 4 WHEN 0 THEN concat('Star Hotel ', k, ' - JustDial Goa') WHEN 1 THEN concat('Om ', k, ' | India | x') WHEN 2 THEN concat('Lotus ', k) ELSE 'A - list of all' END AS d", "CASE k % 5 WHEN 0 THEN concat('Star Clinic ', k, ' - Contact us') WHEN 1 THEN concat('Om Care ', k) WHEN 2 THEN 'Top 10 hospitals' WHEN 3 THEN 'List of clinics in Goa' ELSE concat('Star on Facebook ', k) END AS s")
    return named.select("k", T.directory_name(F.col("d")).alias("directory_name"), T.snippet_name(F.col("s")).alias("snippet_name"))


# ---- identity of records

_DIG = lambda x: O.rep(f"coalesce({x}, '')", "[^0-9]")


@query(f"""WITH {_LISTED}, h AS (SELECT *, {_DIG('phone')} AS d, {O.key('name')} AS g, regexp_replace(regexp_extract(trim(lower(coalesce(website, ''))), 'https?://(?:www\\.)?([^/]+)', 1), '[^a-z0-9]', '', 'g') AS w FROM listed
), c AS (SELECT *, CASE WHEN starts_with(d, '91') AND length(d) > 10 THEN d[3:] ELSE d END AS p, CASE {' '.join(f"WHEN ends_with(g, '{s}') THEN g[:length(g) - {len(s)}]" for s in C.BUSINESS_ENDINGS)} ELSE g END AS n FROM h)
SELECT k, CASE WHEN length(p) >= 8 THEN 'phone:' || p WHEN n <> '' AND w <> '' THEN 'name:' || n || '|domain:' || w WHEN n <> '' THEN 'name:' || n ELSE md5(CAST(k AS VARCHAR)) END AS entity_key FROM c""")
def entity_keys(spark, sf_dir):
    rows = _listings(spark, sf_dir)
    return rows.select("k", R.entity_key(F.col("name"), F.col("phone"), F.col("website"), F.col("k").cast("string")).alias("entity_key"))


@query(f"""WITH {_LISTED}, m AS (SELECT *, 'g' || (k % 50) AS key FROM listed)
SELECT key, arg_min(name, CASE WHEN coalesce(name, '') <> '' THEN k END) AS name, arg_min(phone, CASE WHEN coalesce(phone, '') <> '' THEN k END) AS phone, arg_min(website, CASE WHEN coalesce(website, '') <> '' THEN k END) AS website, arg_min(latitude, CASE WHEN latitude <> 0 THEN k END) AS latitude,
  max(CASE WHEN rating <> 0 THEN rating END) AS rating, max(CASE WHEN reviews_count <> 0 THEN reviews_count END) AS reviews_count, array_to_string(list_sort(list(DISTINCT 's' || (k % 3))), ',') AS sources,
  arg_min('s' || (k % 3), CASE WHEN coalesce(phone, '') <> '' THEN k END) AS phone_from FROM m GROUP BY key""")
def merged_records(spark, sf_dir):
    """The records of a key as one, with the source of each value."""
    k = F.col("k")
    rows = _listings(spark, sf_dir).withColumns({"key": F.concat(F.lit("g"), (k % 50).cast("string")), "idx": k, "source": F.concat(F.lit("s"), (k % 3).cast("string")), "industry": F.col("category")})
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("email", "city", "state", "pin_code")})
    out = R.merge_records(rows)
    return out.select("key", "name", "phone", "website", "latitude", "rating", "reviews_count", F.array_join("sources", ",").alias("sources"), F.try_element_at("field_sources", F.lit("phone")).alias("phone_from"))


@query("""WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier) SELECT k, k % 6 IN (0, 1, 2, 3) AS same FROM k""")
def same_entities(spark, sf_dir):
    """Pairs of records that are one business by phone, name, domain or nearness, and pairs that are not."""
    k = F.col("k")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    t, r = k.cast("string"), k % 6
    null = F.lit(None).cast("string")
    at = lambda x: F.when(r.isin(3, 5), x).cast("double")
    a = {"phone": F.when(r == 0, F.concat(F.lit("+91 98765 "), F.lpad(t, 5, "0"))), "name": F.when(r == 1, F.concat(F.lit("Star "), t)).when(r == 3, "abcd").otherwise("Alpha"), "website": F.when(r == 2, F.concat(F.lit("https://www.s"), t, F.lit(".in/a"))).otherwise(null), "latitude": at(F.lit(16.7)), "longitude": at(F.lit(81.1))}
    b = {"phone": F.when(r == 0, F.concat(F.lit("98765"), F.lpad(t, 5, "0"))).when(r == 4, "12345678"), "name": F.when(r == 1, F.concat(F.lit("The STAR "), t, F.lit("!"))).when(r == 3, "dcbax").otherwise("Zzz"), "website": F.when(r == 2, F.concat(F.lit("http://s"), t, F.lit(".in"))).otherwise(null), "latitude": at(F.lit(16.7002)), "longitude": at(F.lit(81.1001))}
    return rows.select("k", R.same_entity(a, b).alias("same"))
