"""The queries that are registered with the driver, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import assess as A
from ..functions import text as T
from ..operators import query_text, relevance
from ..operators import resolve as R
from ..operators.components import ensure_checkpoint_dir
from ..operators.similar import near_and_similar, similar_names
from . import oracle as O
from . import serve, stages, stats, write
from .derived import ORGANIZATION, RUN, raw_records

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import source_queries, table_queries  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _as_double(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema])


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.clean(raw_records(spark, sf_dir))


class _SingleCompanies:
    """Every record as a company of its own, with the later stages' tables: what the read queries are tried on.

    A table is made when it is first asked for.  Each is written once and read by the next, as in a deployment; the
    writes also keep the optimiser from copying long expressions into every filter and join above them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        ensure_checkpoint_dir(spark)
        self.raw = raw_records(spark, sf_dir)
        self.links = self.raw.select(F.col("id").alias("record_id"), F.md5("id").alias("company_id"))

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def companies(self) -> DataFrame:
        return stages.clean(self.raw).select(
            F.md5("record_id").alias("company_id"), F.coalesce("name", F.lit("Unknown")).alias("name"), T.url_domain(F.col("website")).alias("domain"), "phone", "website", "address", "city", "state",
            T.country(F.col("phone"), F.col("city"), F.col("state")).alias("country"), "latitude", "longitude", "rating", F.col("reviews_count").alias("review_count"), F.col("completeness").alias("completeness_score"),
        ).checkpoint()

    @cached_property
    def facts(self) -> DataFrame:
        return stages.record_facts(self.raw, self.links).checkpoint()

    @cached_property
    def validations(self) -> DataFrame:
        return stages.validate(self.companies, self.facts).checkpoint()

    @cached_property
    def enrichments(self) -> DataFrame:
        return stages.enrich(self.companies, self.facts).checkpoint()

    @cached_property
    def scores(self) -> DataFrame:
        return stages.score(self.companies, self.enrichments, self.validations).checkpoint()


def single_companies(spark: SparkSession, sf_dir: str) -> _SingleCompanies:
    return _SingleCompanies(spark, sf_dir)


# ---- cleaning

_FIELDS = ["name", "phone", "website", "address", "city", "state"]


@query(f"WITH {O.CLEANED} SELECT record_id, {', '.join(_FIELDS)}, right({O.std_phone('phone')}, 10) AS local_phone, completeness, array_to_string(changes, ' / ') AS changes FROM (SELECT * FROM cleaned)")
def clean_records(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return c.select("record_id", *_FIELDS, F.right("phone_display", F.lit(10)).alias("local_phone"), "completeness", F.array_join("changes", " / ").alias("changes"))


@query(f"""WITH {O.RAW}, a AS (
  SELECT id, name, phone, website, {O.key('name')} AS k, {O.rep("coalesce(phone, '')", '[^0-9]')} AS d FROM raw
) SELECT id, {O.match_name('name')} AS match_name, k AS group_key, CASE WHEN starts_with(d, '91') AND length(d) > 10 THEN d[3:] ELSE d END AS compact_phone,
  CASE {' '.join(f"WHEN ends_with(k, '{s}') THEN k[:length(k) - {len(s)}]" for s in C.BUSINESS_ENDINGS)} ELSE k END AS compact_name,
  md5(CASE WHEN length(d) >= 8 THEN 'p:' || d ELSE 'n:' || k END) AS listing_key, {O.domain(O.std_url('website'))} AS domain, rtrim(ltrim({O.rep("lower(trim(name))", '[^a-z0-9]+', '-')}, '-'), '-') AS slug, '****' || right(phone, 4) AS hint FROM a""")
def match_keys(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    n, p, w = (F.col(f"raw_data.{c}") for c in ("name", "phone", "website"))
    return raw.select("id", T.match_name(n).alias("match_name"), T.group_key(n).alias("group_key"), T.compact_phone(p).alias("compact_phone"), T.compact_name(n).alias("compact_name"), T.listing_key(n, p).alias("listing_key"), T.url_domain(T.standard_url(w)).alias("domain"), T.slug(n).alias("slug"), T.key_hint(p).alias("hint"))


@query(f"""WITH {O.RAW}, p AS (SELECT id, coalesce(address, '') AS a, list_transform(string_split(coalesce(address, ''), ','), lambda x: trim(x)) AS p FROM raw
), w AS (SELECT *, list_filter(p, lambda x: regexp_matches(x, '^[A-Za-z\\s]+$') AND length(x) > 2 AND lower(x) NOT IN {O.lst([s.lower() for s in C.STATES])}) AS ok FROM p
) SELECT id, CASE WHEN len(p) >= 2 AND list_contains(ok, p[-2]) THEN p[-2] ELSE list_reverse(list_filter(ok, lambda x: lower(x) <> 'india'))[1] END AS city,
  CASE WHEN len(p) > 1 AND lower(p[-1]) IN {O.lst([s.lower() for s in C.STATES])} THEN p[-1] END AS state, nullif(regexp_extract(a, '\\b(\\d{{6}})\\b', 1), '') AS pin_code FROM w""")
def address_parts(spark, sf_dir):
    return raw_records(spark, sf_dir).select("id", T.address_parts(F.col("raw_data.address")).alias("p")).select("id", "p.city", "p.state", "p.pin_code")


@query(f"WITH {O.CLEANED} SELECT record_id, {O.country('phone', 'city', 'state')} AS country FROM cleaned")
def countries(spark, sf_dir):
    return cleaned(spark, sf_dir).select("record_id", T.country(F.col("phone"), F.col("city"), F.col("state")).alias("country"))


# ---- entity resolution


@query(f"WITH {O.CLEANED}, {O.KEY_EDGES} SELECT a, b FROM exact")
def exact_edges(spark, sf_dir):
    return R.key_edges(R.with_index(cleaned(spark, sf_dir), "retrieved_at", "record_id"))


@query(f"""WITH {O.CLEANED}, m AS (SELECT idx, {O.match_name('name')} AS m, coalesce(nullif({O.key('city')}, ''), '_unknown_') AS block FROM cleaned
), o AS MATERIALIZED (SELECT block, m, min(idx) AS idx, {O.BIGRAMS('m')} AS g FROM m WHERE length(m) >= 3 GROUP BY block, m)
SELECT o.idx AS a, m.idx AS b FROM m JOIN o USING (block, m) WHERE m.idx <> o.idx
UNION ALL SELECT x.idx, y.idx FROM o x JOIN o y ON x.block = y.block AND x.idx < y.idx WHERE {O.DICE('x.g', 'y.g', 'x.m', 'y.m')} >= 0.85""")
def fuzzy_edges(spark, sf_dir):
    c = R.with_index(cleaned(spark, sf_dir), "retrieved_at", "record_id")
    city = T.group_key(F.col("city"))
    return similar_names(c.select(F.col("idx").alias("item"), F.when(city == "", "_unknown_").otherwise(city).alias("block"), T.match_name(F.col("name")).alias("name")), R.FUZZY)


@query(f"""WITH {O.CLEANED}, m AS (SELECT idx, {O.match_name('name')} AS m, latitude, longitude FROM cleaned WHERE latitude <> 0 AND longitude <> 0
), o AS MATERIALIZED (SELECT m, latitude, longitude, min(idx) AS idx, {O.BIGRAMS('m')} AS g, CAST(floor(latitude / 0.01) AS BIGINT) AS gx, CAST(floor(longitude / 0.01) AS BIGINT) AS gy FROM m WHERE length(m) >= 3 GROUP BY m, latitude, longitude
), n AS (SELECT x.idx AS a, y.idx AS b, x.g AS xg, y.g AS yg, x.m AS xm, y.m AS ym, pow(sin(radians(y.latitude - x.latitude) / 2), 2) + cos(radians(x.latitude)) * cos(radians(y.latitude)) * pow(sin(radians(y.longitude - x.longitude) / 2), 2) AS h
  FROM o x JOIN o y ON x.idx < y.idx AND abs(x.gx - y.gx) <= 1 AND abs(x.gy - y.gy) <= 1)
SELECT o.idx AS a, m.idx AS b FROM m JOIN o USING (m, latitude, longitude) WHERE m.idx <> o.idx
UNION ALL SELECT a, b FROM n WHERE {O.KM} <= 1.0 AND {O.DICE('xg', 'yg', 'xm', 'ym')} >= 0.70""")
def spatial_edges(spark, sf_dir):
    c = R.with_index(cleaned(spark, sf_dir).select("retrieved_at", "record_id", "name", "latitude", "longitude"), "retrieved_at", "record_id")
    return near_and_similar(c.select(F.col("idx").alias("item"), T.match_name(F.col("name")).alias("name"), "latitude", "longitude"), R.SPATIAL)


_CLUSTER = ["best_name", "best_phone", "best_address", "best_website", "best_city", "best_state"]


@query(f"WITH RECURSIVE {O.CLUSTERS} SELECT root, 'entity_' || (row_number() OVER (ORDER BY root) - 1) AS entity_id, {', '.join(_CLUSTER)}, place.a AS latitude, place.o AS longitude, rated.r AS rating, rated.n AS review_count, completeness, source_adapters, first_record, size FROM clusters")
def entity_clusters(spark, sf_dir):
    _, found = stages.resolve(cleaned(spark, sf_dir))
    return found.select("root", "entity_id", *_CLUSTER, "latitude", "longitude", "rating", "review_count", "completeness", F.array_join("source_adapters", ",").alias("source_adapters"), "first_record", "size")


@query(f"WITH RECURSIVE {O.CLUSTERS} SELECT root, record_id, idx, idx <> root AS duplicate FROM assigned")
def cluster_members(spark, sf_dir):
    assigned, _ = stages.resolve(cleaned(spark, sf_dir))
    return R.members(assigned)


@query(f"""WITH RECURSIVE {O.CLUSTERS}, u AS (SELECT *, lower(trim(coalesce(best_name, 'Unknown'))) AS k FROM clusters)
SELECT md5(k) AS company_id, arg_min(coalesce(best_name, 'Unknown'), root) AS name, {', '.join(f"arg_min(best_{f}, CASE WHEN {O.full(f'best_{f}')} THEN root END) AS {f}" for f in ('phone', 'website', 'address', 'city', 'state'))},
  arg_min(place.a, CASE WHEN {O.num('place.a')} THEN root END) AS latitude, arg_min(rated.r, CASE WHEN {O.num('rated.r')} THEN root END) AS rating, arg_min(rated.n, CASE WHEN {O.num('rated.n')} THEN root END) AS review_count,
  arg_min(completeness, root) AS completeness_score, arg_min({O.country('best_phone', 'best_city', 'best_state')}, root) AS country FROM u GROUP BY k""")
def companies(spark, sf_dir):
    _, found = stages.resolve(cleaned(spark, sf_dir))
    out, _ = R.upsert_companies(found)
    return out.select("company_id", "name", "phone", "website", "address", "city", "state", "latitude", "rating", "review_count", "completeness_score", "country")


@query(f"""WITH RECURSIVE {O.CLUSTERS} SELECT (SELECT count(*) FROM assigned) AS raw_records_read, (SELECT count(*) FROM assigned WHERE len(changes) > 0) AS records_with_changes, (SELECT count(*) FROM assigned WHERE len(changes) = 0) AS records_without_changes,
  CAST(sum(size - 1) AS BIGINT) AS duplicates_identified, count(*) FILTER (size > 1) AS clusters_with_multiple, count(*) FILTER (size = 1) AS clusters_single FROM clusters""")
def clean_summary(spark, sf_dir):
    return stages.clean_summary(*stages.resolve(cleaned(spark, sf_dir)))


@query(f"""WITH {O.CLEANED}, s AS (SELECT *, row_number() OVER (PARTITION BY source_adapter, md5(CASE WHEN length({O.rep("coalesce(raw_phone, '')", '[^0-9]')}) >= 8 THEN 'p:' || {O.rep("coalesce(raw_phone, '')", '[^0-9]')} ELSE 'n:' || {O.key('raw_name')} END) ORDER BY record_id) AS k FROM cleaned)
SELECT record_id, source_adapter FROM s WHERE k = 1""")
def source_listings(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    key = F.concat_ws("|", "source_adapter", T.listing_key(F.col("raw_data.name"), F.col("raw_data.phone")))
    return R.first_seen(raw, key, "id").select(F.col("id").alias("record_id"), "source_adapter")


# ---- relevance

_LOCATION = "lower(concat_ws(' ', coalesce(address, ''), coalesce(city, ''), coalesce(state, ''), coalesce(name, ''), coalesce(maps_url, '')))"


@query(f"""WITH {O.RAW}, t AS (SELECT *, {_LOCATION} AS t, lower(trim(city)) AS c, coalesce(latitude <> 0 AND longitude <> 0, false) AS here FROM raw)
SELECT id FROM t WHERE CASE WHEN NOT ({O.full('name')} OR {O.full('phone')} OR {O.full('address')} OR here) THEN false WHEN contains(t, 'hyderabad') THEN true WHEN contains(c, 'hyderabad') THEN true WHEN contains(t, 'telangana') THEN true
  WHEN here AND sqrt(pow(latitude - 17.385, 2) + pow(longitude - 78.4867, 2)) < 0.45 THEN true WHEN {O.full('city')} THEN false ELSE {O.full('address')} OR {O.full('phone')} OR here END""")
def location_filter(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    r = {c: F.col(f"raw_data.{c}") for c in ("name", "phone", "address", "city", "state", "latitude", "longitude", "source_url", "maps_url")} | {"metadata": F.lit("")}
    return raw.where(relevance.fits_location(r, "Hyderabad", "Telangana")).select("id")


def _category_sql(category: str) -> str:
    words = lambda ws: "[" + ", ".join(map(O.q, ws)) + "]"
    every = "|".join(sorted(f for w in set(category.split()) - set(C.GENERIC_CATEGORY_WORDS) for f in relevance.forms(w)))
    other = words(sorted({w for t, ws in C.TRADE_WORDS.items() if t != category for w in ws}))
    generic = lambda ws: f"(len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains({words(ws)}, x))) = 0)"
    return f"""WITH {O.RAW}, t AS (SELECT id, trim(coalesce(name, '')) AS n, lower(trim(coalesce(industry, ''))) AS i, lower(concat_ws(' ', coalesce(name, ''), CASE WHEN lower(trim(coalesce(industry, ''))) <> '{category}' THEN coalesce(industry, '') ELSE '' END, coalesce(address, ''), coalesce(city, ''))) AS t, regexp_extract_all(lower(coalesce(name, '')), '[a-z]{{3,}}') AS w FROM raw)
SELECT id FROM t WHERE trim(t) = '' OR regexp_matches(t, '(^|[^a-z])({every})([^a-z]|$)') OR NOT ((i IN {O.lst(C.INDUSTRY_CONFLICTS[category])} AND i <> '{category}') OR (i = '{category}' AND n <> '' AND (len(list_intersect(w, {other})) > 0 OR {generic(C.GENERIC_NAME_WORDS + C.GENERIC_NAME_WORDS_STAMPED)})) OR (i = '' AND n <> '' AND {generic(C.GENERIC_NAME_WORDS)}))"""


@query(_category_sql("hospitals"))
def category_filter(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    n, i, a, c = (F.col(f"raw_data.{f}") for f in ("name", "industry", "address", "city"))
    return raw.where(relevance.fits_category(n, i, a, c, "hospitals")).select("id")


@query("""WITH t AS (SELECT p_partkey, trim(p_name || CASE p_partkey % 4 WHEN 0 THEN ' in ' WHEN 1 THEN ' near ' WHEN 2 THEN ' around ' ELSE ' ' END || p_brand) AS q FROM part)
SELECT p_partkey, q, CASE WHEN contains(q, ' in ') THEN split_part(q, ' in ', 2) WHEN contains(q, ' near ') THEN split_part(q, ' near ', 2) WHEN contains(q, ' around ') THEN split_part(q, ' around ', 2) END AS location,
  CASE WHEN contains(q, ' in ') THEN split_part(q, ' in ', 1) WHEN contains(q, ' near ') THEN split_part(q, ' near ', 1) WHEN contains(q, ' around ') THEN split_part(q, ' around ', 1) ELSE q END AS category FROM t""")
def query_split(spark, sf_dir):
    text = F.concat("p_name", F.expr("case p_partkey % 4 when 0 then ' in ' when 1 then ' near ' when 2 then ' around ' else ' ' end"), "p_brand")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.trim(text).alias("q"))
    return rows.select("p_partkey", "q", F.expr(query_text.location_sql("q")).alias("location"), F.expr(query_text.category_sql("q")).alias("category"))


# ---- validation, enrichment, scoring


@query(f"WITH {O.COMPANIES} SELECT * FROM validations")
def validations(spark, sf_dir):
    return single_companies(spark, sf_dir)["validations"].drop("details")


@query(f"WITH {O.COMPANIES} SELECT company_id, industry, email, phones, google_maps_url FROM enrichments")
def enrichments(spark, sf_dir):
    e = single_companies(spark, sf_dir)["enrichments"]
    return e.select("company_id", "industry", "email", F.get("additional_phones", F.lit(0)).alias("phones"), "google_maps_url")


_PAGE = "coalesce(" + ", ".join(f"CASE WHEN contains(w, {O.q(k)}) THEN {O.q(v)} END" for k, v in C.PAGE_INDUSTRIES) + ")"


@query(f"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), '\\s+', ' ', 'g')) AS title, list_filter(regexp_extract_all(html, {O.q(C.PAGE_EMAIL)}), lambda e: NOT ({' OR '.join(f'contains(lower(e), {O.q(n)})' for n in C.PAGE_EMAIL_NOISE)})) AS e FROM pages
), w AS (SELECT *, lower(coalesce(title, '')) || ' ' AS w FROM t) SELECT page_id, nullif(title, '') AS title, e[1] AS email, {_PAGE} AS industry FROM w""")
def page_facts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", A.page_facts(F.col("html")).alias("f")).select("page_id", "f.title", "f.email", "f.industry")


@query(f"WITH {O.COMPANIES} SELECT company_id, CAST(industry_score AS DOUBLE) AS industry_score, CAST(size_score AS DOUBLE) AS size_score, CAST(location_score AS DOUBLE) AS location_score, CAST(technology_score AS DOUBLE) AS technology_score, CAST(data_quality_score AS DOUBLE) AS data_quality_score, CAST(validation_score AS DOUBLE) AS validation_score, total_score, '1.0' AS score_version FROM scores")
def scores(spark, sf_dir):
    return _as_double(single_companies(spark, sf_dir)["scores"])


@query(f"""WITH {O.COMPANIES} SELECT c.company_id, c.name, c.phone, c.website, c.city, c.state, CAST(industry_score AS DOUBLE) AS industry_score, CAST(size_score AS DOUBLE) AS size_score, CAST(location_score AS DOUBLE) AS location_score, CAST(technology_score AS DOUBLE) AS technology_score, CAST(data_quality_score AS DOUBLE) AS data_quality_score, CAST(validation_score AS DOUBLE) AS validation_score, total_score, '1.0' AS score_version,
  CASE WHEN total_score >= 60 THEN 'high' WHEN total_score >= 35 THEN 'medium' ELSE 'low' END AS tier FROM scores s JOIN companies c USING (company_id)""")
def scored_leads(spark, sf_dir):
    t = single_companies(spark, sf_dir)
    return _as_double(serve.scored_leads(t["companies"], t["enrichments"], t["validations"], t["scores"], limit=None))


@query(f"""WITH {O.COMPANIES} SELECT c.company_id, c.name, total_score, CASE WHEN total_score >= 60 THEN 'high' WHEN total_score >= 35 THEN 'medium' ELSE 'low' END AS tier FROM scores s JOIN companies c USING (company_id) JOIN enrichments e USING (company_id) JOIN validations v USING (company_id)
WHERE total_score BETWEEN 40 AND 90 AND e.industry ILIKE '%health%' AND e.email IS NULL AND c.phone IS NOT NULL AND v.overall_status = 'VALID' ORDER BY total_score DESC, company_id LIMIT 100""")
def scored_leads_filtered(spark, sf_dir):
    t = single_companies(spark, sf_dir)
    f = serve.Filters(min_score=40, max_score=90, industry="health", has_email=False, has_phone=True, validation_status="valid")
    return _as_double(serve.scored_leads(t["companies"], t["enrichments"], t["validations"], t["scores"], f, 100).select("company_id", "name", "total_score", "tier"))


_UNIFIED = f"""WITH {O.COMPANIES}, unified AS (
  SELECT c.company_id, c.name, e.industry, c.address, c.city, c.state, c.country, c.phone, e.email, c.website, nullif(c.rating, 0) AS rating, nullif(c.review_count, 0) AS review_count, nullif(c.latitude, 0) AS latitude, nullif(c.longitude, 0) AS longitude,
    v.overall_status, s.total_score, c.source_adapter AS source, hash_saved AS is_saved FROM (SELECT *, substr(company_id, 1, 1) = '0' AS hash_saved FROM companies) c LEFT JOIN enrichments e USING (company_id) LEFT JOIN validations v USING (company_id) LEFT JOIN scores s USING (company_id)
)"""


def _unified(spark, sf_dir):
    t = single_companies(spark, sf_dir)
    saved = serve.saved_counts(t["companies"].where(F.substring("company_id", 1, 1) == "0"))
    sources = serve.company_sources(t["links"], t["raw"])
    return t, serve.unified_leads(t["companies"], t["enrichments"], t["validations"], t["scores"], sources, saved)


@query(f"{_UNIFIED} SELECT * FROM unified")
def unified_leads(spark, sf_dir):
    return _as_double(_unified(spark, sf_dir)[1].drop("description", "social_links", "founded_year", "company_size", "sources"))


@query(f"{_UNIFIED} SELECT company_id, name, total_score, source FROM unified WHERE city ILIKE '%lon%' AND phone IS NOT NULL AND website IS NULL AND source = 'openstreetmap' ORDER BY total_score DESC NULLS LAST, company_id LIMIT 200 OFFSET 5")
def lead_list(spark, sf_dir):
    f = serve.Filters(city="lon", has_phone=True, has_website=False, source="openstreetmap")
    return _as_double(serve.list_leads(_unified(spark, sf_dir)[1], f, 200, 5).select("company_id", "name", "total_score", "source"))


@query(f"{_UNIFIED} SELECT count(*) AS total, count(total_score) AS with_score, count(phone) AS with_phone, count(industry) AS with_industry FROM unified")
def lead_stats(spark, sf_dir):
    t = single_companies(spark, sf_dir)
    return stats.lead_stats(t["companies"], t["scores"], t["enrichments"])


@query(f"{_UNIFIED} SELECT source, count(*) AS n FROM unified GROUP BY source")
def source_breakdown(spark, sf_dir):
    return stats.source_breakdown(_unified(spark, sf_dir)[1])


@query(f"{_UNIFIED} SELECT count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS with_position, count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS without_position FROM unified")
def map_counts(spark, sf_dir):
    return stats.map_counts(_unified(spark, sf_dir)[1])


@query(f"WITH {O.COMPANIES} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS status, count(*) AS n FROM validations GROUP BY {f}" for f in stats.STATUS_FIELDS))
def status_counts(spark, sf_dir):
    return stats.status_counts(single_companies(spark, sf_dir)["validations"])


@query(f"WITH {O.COMPANIES} SELECT count(*) AS total, avg_ AS avg_score, min(total_score) AS min_score, max(total_score) AS max_score, count(*) FILTER (total_score >= 60) AS high, count(*) FILTER (total_score >= 35 AND total_score < 60) AS medium, count(*) FILTER (total_score < 35) AS low FROM scores, (SELECT round_even(CAST(avg(total_score) AS DOUBLE), 2) AS avg_ FROM scores) GROUP BY avg_")
def score_stats(spark, sf_dir):
    return stats.score_stats(single_companies(spark, sf_dir)["scores"])


@query(f"WITH {O.COMPANIES} SELECT count(*) AS total, count(industry) AS with_industry, 0::BIGINT AS with_social_links, count(email) AS with_email, 0::BIGINT AS with_description, 0::BIGINT AS with_founded_year FROM enrichments")
def enrichment_stats(spark, sf_dir):
    return stats.enrichment_stats(single_companies(spark, sf_dir)["enrichments"])


@query(f"""WITH {O.RAW} SELECT s.source, s.source = 'google_places' AS requires_api_key, count(r.id) AS candidates_contributed, count(r.id) AS leads_enriched, CAST(s.source IN ('openstreetmap', 'web_search') AS BIGINT) AS total_runs,
  CASE WHEN s.source = 'google_places' THEN 'not_configured' WHEN count(r.id) > 0 THEN 'active' ELSE 'available' END AS status FROM (SELECT unnest([{', '.join(map(O.q, C.SOURCES))}]) AS source) s LEFT JOIN raw r ON r.source_adapter = s.source GROUP BY s.source""")
def source_stats(spark, sf_dir):
    runs = spark.sql(f"select '{RUN}' as id, timestamp'2024-01-02 00:00:00' as created_at, 'completed' as status, array('openstreetmap', 'web_search') as sources_used")
    return stats.source_stats(raw_records(spark, sf_dir), runs).drop("last_run_at", "has_api_key")


@query(f"WITH {O.RAW} SELECT source_adapter, count(*) AS n FROM raw GROUP BY source_adapter")
def extraction_counts(spark, sf_dir):
    return stats.extraction_counts(raw_records(spark, sf_dir))


_FACTORS = ["industry", "size", "location", "technology", "data_quality", "validation"]


@query(f"""WITH {O.COMPANIES} SELECT c.name AS company_name, e.industry, c.address, c.city, c.state, c.country, c.phone, e.email, c.website, CASE WHEN {O.full('e.industry')} THEN 'enrichment' ELSE 'raw_data' END AS source, coalesce(c.website, '') AS source_url, c.rating, c.review_count, c.latitude, c.longitude,
  v.overall_status AS validation_status, NULL::VARCHAR AS enrichment_description, NULL::VARCHAR AS enrichment_founded_year, {', '.join(f'CAST({f}_score AS DOUBLE) AS {f}_score' for f in _FACTORS)}, total_score, '1.0' AS score_version
FROM scores s JOIN companies c USING (company_id) LEFT JOIN enrichments e USING (company_id) LEFT JOIN validations v USING (company_id) WHERE total_score >= 50""")
def export_rows(spark, sf_dir):
    t = single_companies(spark, sf_dir)
    rows = serve.export_rows(t["companies"], t["enrichments"], t["validations"], t["scores"], serve.Filters(min_score=50))
    assert rows.columns == C.LEAD_CSV_COLUMNS
    return _as_double(rows.drop("enrichment_social_links"))


@query(f"""WITH {O.RAW} SELECT name AS "Name", address AS "Address", city AS "City", state AS "State", phone AS "Phone", website AS "Website", CAST(rating AS DOUBLE) AS "Rating", CAST(latitude AS DOUBLE) AS "Latitude", CAST(longitude AS DOUBLE) AS "Longitude", strftime(make_timestamp((1704067200 + minutes * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') AS "Retrieved At", source_record_id AS "Place ID", source_adapter AS "Source" FROM raw ORDER BY minutes DESC, id LIMIT 10000""")
def raw_export(spark, sf_dir):
    rows = write.raw_export(raw_records(spark, sf_dir))
    assert rows.columns == C.RAW_CSV_COLUMNS
    return rows.select("Name", "Address", "City", "State", "Phone", "Website", "Rating", "Latitude", "Longitude", "Retrieved At", "Place ID", "Source")


@query(f"WITH {O.RAW} SELECT id, source_adapter FROM raw WHERE source_adapter = 'web_search' ORDER BY minutes DESC, id LIMIT 50 OFFSET 50")
def raw_page(spark, sf_dir):
    rows = stages.of_tenant(raw_records(spark, sf_dir), ORGANIZATION, RUN)
    return serve.raw_results(rows, source="web_search", number=2, size=50)[0].select("id", "source_adapter")


@cache
def headline() -> tuple[str, ...]:
    """What bench.py times."""
    return ("clean_records", "exact_edges", "fuzzy_edges", "spatial_edges", "entity_clusters", "scored_leads", "unified_leads", "status_counts", "score_stats", "page_facts")
