"""Registered queries over stored tables: listings, counts, saved leads, sinks and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import assess as A
from ..operators import relevance
from ..operators import resolve as R
from ..operators.components import ensure_checkpoint_dir
from ..operators.run_index import resolve_runs
from ..sources import file_skipping, registry
from ..streaming import company_state, ingest
from ..streaming import progress as stream_records
from . import serve, stages, stats, write
from . import tables as B
from . import oracle as O
from .derived import raw_records
from .oracle import country as country_sql
from .oracle import q
from .queries import cleaned, query

RUN_2 = "00000000-0000-4000-8000-000000000002"
_links = lambda t: t.select(F.col("id").alias("record_id"), "company_id")


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [B.table(spark, sf_dir, n) for n in names]


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---- counts


@query(f"{B.with_('raw', 'companies', 'runs')} SELECT 'runs' AS kind, count(*) AS n FROM t_runs UNION ALL SELECT 'records', count(*) FROM t_raw UNION ALL SELECT 'companies', count(*) FROM t_companies")
def dashboard(spark, sf_dir):
    raw, companies, runs = _tables(spark, sf_dir, "raw", "companies", "runs")
    return stats.dashboard(raw, companies, runs)


@query(f"{B.with_('validations')} SELECT count(*) AS companies_read, " + ", ".join(f"count(*) FILTER ({f} = '{s}') AS {f.removesuffix('_status')}_{s.lower()}" for f in stats.STATUS_FIELDS for s in ("VALID", "INVALID", "UNKNOWN", "NOT_AVAILABLE") if f not in ("overall_status", "business_existence_status") or s != "NOT_AVAILABLE") + " FROM t_validations")
def validation_summary(spark, sf_dir):
    return stats.validation_summary(B.table(spark, sf_dir, "validations"))


@query(f"""{B.with_('enrichments')} SELECT count(*) AS enriched, count(description_source) AS with_website_scrape, count(*) FILTER (industry_source LIKE 'inferred%') AS with_industry_inference,
  count(*) FILTER (more_phone IS NOT NULL OR coalesce(email_source, '') = 'raw_data_metadata' OR coalesce(social_links_source, '') = 'raw_data_metadata') AS with_metadata_extraction,
  count(facebook) AS with_social_links, count(email) AS with_email, count(founded_year) AS with_founded_year, count(company_size) AS with_company_size, count(description) AS with_description FROM t_enrichments""")
def enrichment_summary(spark, sf_dir):
    return stats.enrichment_summary(B.table(spark, sf_dir, "enrichments"))


@query(f"""{B.with_('scores')} SELECT count(*) AS total, round_even(CAST(avg(total_score) AS DOUBLE), 2) AS avg_score, CAST(min(total_score) AS DOUBLE) AS min_score, CAST(max(total_score) AS DOUBLE) AS max_score,
  count(*) FILTER (total_score >= 60) AS high, count(*) FILTER (total_score >= 35 AND total_score < 60) AS medium, count(*) FILTER (total_score < 35) AS low FROM t_scores""")
def scoring_summary(spark, sf_dir):
    return stats.score_stats(B.table(spark, sf_dir, "scores"))


@query(f"""{B.with_('raw', 'runs')}, u AS (SELECT CASE used WHEN 0 THEN ['openstreetmap', 'web_search'] WHEN 1 THEN ['justdial'] ELSE [] END AS s, * FROM t_runs), r AS (SELECT unnest(s) AS source, status, minutes FROM u
), g AS (SELECT source, count(*) AS n, max(CASE WHEN status = 'completed' THEN minutes END) AS last_run FROM r GROUP BY source
), f AS (SELECT source_adapter AS source, count(*) AS n FROM t_raw GROUP BY 1
) SELECT s.source, s.source = 'google_places' AS requires_api_key, coalesce(f.n, 0) AS candidates_contributed, coalesce(f.n, 0) AS leads_enriched, coalesce(g.n, 0) AS total_runs, g.last_run AS last_run, s.source = 'google_places' AS has_api_key,
  CASE WHEN coalesce(f.n, 0) > 0 THEN 'active' ELSE 'available' END AS status FROM (SELECT unnest([{', '.join(map(q, C.SOURCES))}]) AS source) s LEFT JOIN f USING (source) LEFT JOIN g USING (source)""")
def source_history(spark, sf_dir):
    """source_stats with the last completed run of each source and with an active key."""
    raw, runs = _tables(spark, sf_dir, "raw", "runs")
    raw = raw.withColumn("raw_data", F.struct(F.struct(F.array("source_adapter").alias("contributing_sources")).alias("metadata")))
    keys = spark.sql("select * from values ('google_places', 'active'), ('google_places', 'active'), ('justdial', 'active'), ('web_search', 'revoked') as t(source_adapter, status)")
    out = stats.source_stats(raw, runs, keys)
    return out.withColumn("last_run", F.floor((F.unix_timestamp("last_run_at") - 1704067200) / 60).cast("long")).drop("last_run_at")


@query(f"{B.with_('runs')} SELECT id, status FROM t_runs ORDER BY minutes DESC, id LIMIT 5")
def recent_runs(spark, sf_dir):
    return serve.recent_runs(B.table(spark, sf_dir, "runs")).select("id", "status")


@query(f"{B.with_('raw')} SELECT count(*) AS total FROM t_raw WHERE pipeline_run_id = '{RUN_2}' AND source_adapter = 'openstreetmap'")
def raw_total(spark, sf_dir):
    return serve.raw_results(B.table(spark, sf_dir, "raw"), RUN_2, "openstreetmap")[1]


# ---- lists


@query(f"{B.with_('validations', 'companies')} SELECT v.*, c.name FROM t_validations v JOIN t_companies c USING (company_id) WHERE overall_status = 'INVALID'")
def validation_list(spark, sf_dir):
    return serve.validation_results(*_tables(spark, sf_dir, "validations", "companies"), status="invalid")


@query(f"{B.with_('enrichments', 'companies')} SELECT e.company_id, c.name, e.industry, e.email FROM t_enrichments e JOIN t_companies c USING (company_id) WHERE e.industry IS NULL")
def enrichment_list(spark, sf_dir):
    return serve.enrichment_results(*_tables(spark, sf_dir, "enrichments", "companies"), has_industry=False).select("company_id", "name", "industry", "email")


@query(f"{B.with_('raw')} SELECT company_id, array_to_string(list_sort(list(DISTINCT source_adapter)), ',') AS sources FROM t_raw WHERE company_id IS NOT NULL GROUP BY company_id")
def company_sources(spark, sf_dir):
    raw = B.table(spark, sf_dir, "raw")
    return serve.company_sources(_links(raw), raw).select("company_id", F.array_join("sources", ",").alias("sources"))


@query(f"{B.with_('raw')} SELECT DISTINCT company_id FROM t_raw WHERE pipeline_run_id = '{RUN_2}' AND company_id IS NOT NULL")
def run_companies(spark, sf_dir):
    raw = B.table(spark, sf_dir, "raw")
    return serve.run_companies(raw, _links(raw), RUN_2)


_LEADS = f"""{B.with_('companies', 'enrichments', 'validations', 'scores', 'raw', 'saved')}, src AS (SELECT company_id, min(source_adapter) AS source, array_to_string(list_sort(list(DISTINCT source_adapter)), ',') AS sources FROM t_raw WHERE company_id IS NOT NULL GROUP BY 1
), sv AS (SELECT company_id, count(*) AS n FROM t_saved GROUP BY 1), leads AS (
  SELECT c.company_id, c.name, e.industry, c.address, c.city, c.state, c.country, c.phone, e.email, c.website, nullif(c.rating, 0) AS rating, nullif(c.review_count, 0) AS review_count, c.latitude, c.longitude, e.description, e.facebook, e.founded_year, e.company_size,
    v.overall_status, CAST(s.total_score AS DOUBLE) AS total_score, src.sources, src.source, coalesce(sv.n, 0) > 0 AS is_saved
  FROM t_companies c LEFT JOIN t_enrichments e USING (company_id) LEFT JOIN t_validations v USING (company_id) LEFT JOIN t_scores s USING (company_id) LEFT JOIN src USING (company_id) LEFT JOIN sv USING (company_id))"""


def _leads(spark, sf_dir, run: bool = False) -> DataFrame:
    c, e, v, s, raw, saved = _tables(spark, sf_dir, "companies", "enrichments", "validations", "scores", "raw", "saved")
    return serve.unified_leads(c, e, v, s, serve.company_sources(_links(raw), raw), serve.saved_counts(saved), serve.run_companies(raw, _links(raw), RUN_2) if run else None)


@query(f"{_LEADS} SELECT * FROM leads")
def leads_in_full(spark, sf_dir):
    """All columns of the unified leads, maps and lists as text."""
    rows = _leads(spark, sf_dir)
    return rows.withColumns({"facebook": F.try_element_at("social_links", F.lit("facebook")), "sources": F.array_join("sources", ","), "total_score": F.col("total_score").cast("double")}).drop("social_links")


@query(f"{_LEADS} SELECT company_id, name, total_score, source FROM leads WHERE company_id IN (SELECT company_id FROM t_raw WHERE pipeline_run_id = '{RUN_2}') ORDER BY total_score DESC NULLS LAST, company_id LIMIT 40 OFFSET 3")
def run_leads(spark, sf_dir):
    return serve.list_leads(_leads(spark, sf_dir, run=True), limit=40, offset=3).select("company_id", "name", F.col("total_score").cast("double").alias("total_score"), "source")


@query(f"{B.with_('companies')} SELECT company_id, CASE WHEN coalesce(city, '') <> '' AND coalesce(state, '') <> '' THEN city || ', ' || state WHEN coalesce(city, '') <> '' THEN city WHEN coalesce(state, '') <> '' THEN state ELSE address END AS label FROM t_companies")
def location_labels(spark, sf_dir):
    c = B.table(spark, sf_dir, "companies")
    return c.select("company_id", serve.location_label(F.col("city"), F.col("state"), F.col("address")).alias("label"))


# ---- saved leads: requests name a company, a run, and sometimes a record

_ASKED = "asked AS MATERIALIZED (SELECT CASE WHEN k % 17 = 5 THEN 'nobody' ELSE md5(CAST(k AS VARCHAR)) END AS company_id, '00000000-0000-4000-8000-' || lpad(CAST(CASE WHEN k % 19 = 3 THEN 77 ELSE k % 4 END AS VARCHAR), 12, '0') AS run, CASE WHEN k % 5 = 0 THEN 'r' || lpad(CAST(k AS VARCHAR), 9, '0') WHEN k % 23 = 7 THEN 'gone' END AS asked_for FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer))"
_KNOWN = f"""{B.with_('companies', 'enrichments', 'validations', 'scores', 'raw', 'runs', 'saved')}, {_ASKED}, known AS MATERIALIZED (
  SELECT a.*, EXISTS (SELECT 1 FROM t_companies c WHERE c.company_id = a.company_id) AS has_company, EXISTS (SELECT 1 FROM t_runs r WHERE r.id = a.run) AS has_run,
    CASE WHEN asked_for IS NULL THEN (SELECT min(w.id) FROM t_raw w WHERE w.company_id = a.company_id AND w.pipeline_run_id = a.run AND w.minutes = (SELECT min(y.minutes) FROM t_raw y WHERE y.company_id = a.company_id AND y.pipeline_run_id = a.run))
      ELSE (SELECT min(w.id) FROM t_raw w WHERE w.id = asked_for) END AS record FROM asked a
), judged AS MATERIALIZED (
  SELECT *, CASE WHEN NOT has_company THEN 'company not found' WHEN NOT has_run THEN 'run not found' WHEN record IS NULL THEN 'record not found'
    WHEN EXISTS (SELECT 1 FROM t_saved s WHERE s.company_id = known.company_id AND s.pipeline_run_id = known.run AND s.raw_record_id = known.record) THEN 'already saved' END AS reason FROM known)"""


def _requests(spark, sf_dir):
    k = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    run = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.when(F.col("k") % 19 == 3, 77).otherwise(F.col("k") % 4).cast("string"), 12, "0"))
    record = F.when(F.col("k") % 5 == 0, F.concat(F.lit("r"), F.lpad(F.col("k").cast("string"), 9, "0"))).when(F.col("k") % 23 == 7, "gone")
    asked = k.select(F.when(F.col("k") % 17 == 5, "nobody").otherwise(F.md5(F.col("k").cast("string"))).alias("company_id"), run.alias("pipeline_run_id"), record.alias("raw_record_id"))
    c, e, v, s, raw, runs, saved = _tables(spark, sf_dir, "companies", "enrichments", "validations", "scores", "raw", "runs", "saved")
    return serve.new_leads(asked, c, runs, raw, _links(raw), e, v, s, saved)


@query(f"""{_KNOWN} SELECT DISTINCT md5(j.company_id || '|' || run || '|' || record) AS id, j.company_id, run AS pipeline_run_id, record AS raw_record_id, coalesce(v.overall_status, 'pending') AS validation_status, CASE WHEN e.company_id IS NULL THEN 'pending' ELSE 'completed' END AS enrichment_status,
  CAST(s.total_score AS DOUBLE) AS lead_score, s.score_version, CAST(nullif(s.industry_score, 0) AS DOUBLE) AS industry, CAST(nullif(s.data_quality_score, 0) AS DOUBLE) AS data_quality
FROM judged j LEFT JOIN t_validations v USING (company_id) LEFT JOIN t_enrichments e USING (company_id) LEFT JOIN t_scores s USING (company_id) WHERE reason IS NULL""")
def saved_leads(spark, sf_dir):
    new = _requests(spark, sf_dir)[0]
    parts = {n: F.col(f"score_components.{n}_score").alias(n) for n in ("industry", "data_quality")}
    return new.select("id", "company_id", "pipeline_run_id", "raw_record_id", "validation_status", "enrichment_status", F.col("lead_score").cast("double").alias("lead_score"), "score_version", *parts.values())


@query(f"{_KNOWN} SELECT company_id, run AS pipeline_run_id, asked_for AS raw_record_id, reason FROM (SELECT DISTINCT company_id, run, asked_for, reason FROM judged) WHERE reason IS NOT NULL")
def refused_leads(spark, sf_dir):
    return _requests(spark, sf_dir)[1]


@query("SELECT k, CASE WHEN k % 2 = 0 THEN 'active' END AS found FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)")
def active_keys(spark, sf_dir):
    """Organizations of even number hold an active key; the others hold a revoked one, or one of another source."""
    k = F.col("n_nationkey").cast("long")
    orgs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("k"))
    keys = orgs.select(F.col("k").cast("string").alias("organization_id"), F.when(F.col("k") % 4 == 3, "justdial").otherwise("google_places").alias("source_adapter"), F.when(F.col("k") % 4 == 1, "revoked").otherwise("active").alias("status"))
    found = registry.active_keys(keys, "google_places").withColumn("found", F.lit("active"))
    return orgs.join(found, orgs.k == found.organization_id, "left").select("k", "found")


# ---- upsert, validation with domains, enrichment with pages

_FOUND = {"k": "k", "best_name": "CASE WHEN k % 9 = 0 THEN NULL WHEN k % 2 = 0 THEN concat('Star ', CAST(k % 40 AS STRING)) ELSE concat(' STAR ', CAST(k % 40 AS STRING)) END", "best_phone": "CASE WHEN k % 3 = 0 THEN concat('+44', CAST(k AS STRING)) END", "best_website": "CASE WHEN k % 4 = 1 THEN concat('https://www.S', CAST(k AS STRING), '.com/x') END", "best_address": "CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN concat('A', CAST(k AS STRING)) END", "best_city": "CASE k % 3 WHEN 0 THEN 'London' WHEN 1 THEN 'Goa' END", "best_state": "CASE WHEN k % 4 = 2 THEN 'Goa' END", "latitude": "CASE k % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(k AS DOUBLE) END", "longitude": "CASE k % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(k AS DOUBLE) END", "rating": "CASE WHEN k % 6 = 1 THEN CAST(k % 5 AS DOUBLE) END", "review_count": "CASE WHEN k % 6 = 2 THEN CAST(k % 7 AS INTEGER) END", "completeness": "CAST(k % 10 AS DOUBLE) / 10"}
_found_sql = lambda source, key: f"SELECT {', '.join(f'{e} AS {c}' for c, e in _FOUND.items())} FROM (SELECT CAST({key} AS BIGINT) AS k FROM {source})".replace("AS STRING)", "AS VARCHAR)")
_UP = ["phone", "website", "address", "city", "state", "latitude", "longitude", "rating", "review_count"]
_DOMAIN = "nullif(lower(regexp_replace(regexp_extract(best_website, '^https://([^/]*)', 1), '^www[.]', '')), '')"
_there = lambda f: f"{f} <> ''" if f in ("phone", "website", "address", "city", "state") else f"{f} <> 0"


@query(f"""WITH f AS ({_found_sql('customer', 'c_custkey')}), o AS ({_found_sql('supplier', 's_suppkey')}), rows_ AS (
  SELECT 1 AS late, k AS pos, trim(coalesce(nullif(best_name, ''), 'Unknown')) AS name, {_DOMAIN} AS domain, {country_sql('best_phone', 'best_city', 'best_state')} AS country, completeness AS completeness_score, best_phone AS phone, best_website AS website, best_address AS address, best_city AS city, best_state AS state, latitude, longitude, rating, review_count FROM f
  UNION ALL SELECT 0, k, 'Star ' || k, 'old.com', 'Old', 0.25, best_phone, NULL, best_address, 'Old Town', NULL, latitude, longitude, rating, review_count FROM o
), keyed AS (SELECT *, md5(lower(name)) AS company_id, late * 1000000000 + pos AS turn FROM rows_)
SELECT company_id, {', '.join(f'arg_min(struct_pack(v := {f}), turn).v AS {f}' for f in ('name', 'domain', 'country', 'completeness_score'))}, {', '.join(f'arg_min({f}, CASE WHEN {_there(f)} THEN turn END) AS {f}' for f in _UP)} FROM keyed GROUP BY company_id""")
def upserted(spark, sf_dir):
    """Clusters that meet companies from before: these keep their name, domain and country, and take what they lacked."""
    k = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).cast("long").alias("k")).selectExpr(*[f"{e} AS {n}" for n, e in _FOUND.items()])
    found = k("customer", "c_custkey").withColumnRenamed("k", "root")
    old = k("supplier", "s_suppkey").withColumn("name", F.concat(F.lit("Star "), F.col("k").cast("string")))
    old = old.select(F.md5(F.lower("name")).alias("company_id"), "name", F.lit("old.com").alias("domain"), F.lit("Old").alias("country"), F.lit(0.25).alias("completeness_score"), F.col("best_phone").alias("phone"), F.lit(None).cast("string").alias("website"), F.col("best_address").alias("address"), F.lit("Old Town").alias("city"), F.lit(None).cast("string").alias("state"), "latitude", "longitude", "rating", "review_count")
    return R.upsert_companies(found, old)[0]


_HOSTED = f"""{B.with_('companies')}, f AS (SELECT *, CASE k % 4 WHEN 0 THEN 'a@shop' || (k % 12) || '.in' WHEN 1 THEN 'broken@' WHEN 2 THEN 'a@mailinator.com' END AS email, k % 12 AS d, k % 300 AS h FROM t_companies)"""


@query(f"""{_HOSTED}, s AS (SELECT company_id,
  CASE k % 4 WHEN 0 THEN CASE d % 3 WHEN 0 THEN 'VALID' WHEN 1 THEN 'INVALID' ELSE 'UNKNOWN' END WHEN 1 THEN 'INVALID' WHEN 2 THEN 'INVALID' ELSE 'NOT_AVAILABLE' END AS email_status,
  CASE WHEN phone IS NULL THEN 'NOT_AVAILABLE' ELSE 'VALID' END AS phone_status,
  CASE WHEN website IS NULL THEN 'NOT_AVAILABLE' WHEN h % 2 = 0 THEN 'VALID' ELSE 'INVALID' END AS website_status,
  1 + CAST(phone IS NOT NULL AS INT) + CAST(address IS NOT NULL AS INT) + CAST(coalesce(city, '') <> '' AS INT) + CAST(coalesce(latitude <> 0 AND longitude <> 0, false) AS INT) + CAST(website IS NOT NULL AS INT) AS fields_present,
  2 * CAST(phone IS NOT NULL AS INT) + CAST(address IS NOT NULL AS INT) + CAST(coalesce(city, '') <> '' AS INT) + 2 * CAST(coalesce(latitude <> 0 AND longitude <> 0, false) AS INT) + CAST(website IS NOT NULL AS INT) + CAST(rating IS NOT NULL AS INT) + 1 AS existence_score FROM f
), x AS (SELECT *, CASE WHEN fields_present < 2 THEN 'INVALID' WHEN existence_score >= 4 THEN 'VALID' WHEN existence_score >= 2 THEN 'UNKNOWN' ELSE 'INVALID' END AS business_existence_status FROM s)
SELECT *, CASE WHEN business_existence_status = 'INVALID' THEN 'INVALID' WHEN 'VALID' IN (email_status, phone_status, website_status) THEN 'VALID' ELSE 'UNKNOWN' END AS overall_status FROM x""")
def validations_with_domains(spark, sf_dir):
    """Statuses with facts on mail servers and hosts, and their details; the table of domains repeats some."""
    c = B.table(spark, sf_dir, "companies")
    k = F.col("k")
    email = F.when(k % 4 == 0, F.concat(F.lit("a@shop"), (k % 12).cast("string"), F.lit(".in"))).when(k % 4 == 1, "broken@").when(k % 4 == 2, "a@mailinator.com")
    facts = c.select("company_id", email.alias("first_email"), F.array(F.lit("openstreetmap")).alias("sources"))
    mail = spark.range(12).select(F.concat(F.lit("shop"), F.col("id").cast("string"), F.lit(".in")).alias("domain"), F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False).alias("has_mx"), F.lit(None).cast("boolean").alias("resolves"))
    hosts = spark.range(300).select(F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".com")).alias("domain"), F.lit(None).cast("boolean").alias("has_mx"), (F.col("id") % 2 == 0).alias("resolves"))
    v = stages.validate(c, facts, mail.unionByName(hosts).unionByName(mail))
    return v.select("company_id", "email_status", "phone_status", "website_status", "business_existence_status", "overall_status", F.col("details.existence_score").cast("int").alias("existence_score"), F.col("details.fields_present").cast("int").alias("fields_present"))


@query(f"""{B.with_('companies')}, p AS (SELECT *, CASE WHEN k % 6 = 0 THEN k % 300 END AS h FROM t_companies), s AS (SELECT *, CASE WHEN h IS NOT NULL THEN 'website:' || website END AS site FROM p)
SELECT company_id, CASE WHEN h % 2 = 0 AND h IS NOT NULL THEN 'Education' WHEN k % 5 = 1 THEN 'Healthcare' WHEN k % 5 = 2 THEN 'Food & Beverage' WHEN k % 5 = 3 THEN 'Education' WHEN k % 5 = 4 THEN 'Hospitality' WHEN k % 5 = 0 THEN NULL END AS industry,
  CASE WHEN h % 2 = 0 AND h IS NOT NULL THEN site WHEN k % 5 <> 0 THEN 'inferred_from_name:' || name END AS industry_source,
  CASE WHEN h % 9 = 0 THEN (10 + h) || ' employees' END AS company_size, CASE WHEN h % 4 = 0 THEN CAST(1950 + h % 60 AS VARCHAR) END AS founded_year, CASE WHEN h % 12 = 0 THEN 'We are site ' || h WHEN h IS NOT NULL THEN 'About text of ' || h END AS description, site AS description_source,
  CASE WHEN h % 8 = 0 THEN 'https://facebook.com/page' || h WHEN k % 7 = 0 THEN 'https://facebook.com/raw' || k END AS facebook, CASE WHEN k % 14 = 0 THEN 'https://twitter.com/raw' || k END AS twitter,
  CASE WHEN h % 18 = 0 THEN 'mail' || h || '@real.in' WHEN k % 3 = 0 THEN 'raw' || k || '@x.in' END AS email, CASE WHEN h % 18 = 0 THEN site WHEN k % 3 = 0 THEN 'raw_data_metadata' END AS email_source, CASE WHEN k % 11 = 0 THEN '98' || k END AS phones, k % 4 AS raw_records_count FROM s""")
def enrichments_with_pages(spark, sf_dir):
    """What pages of websites, names and raw records add, in this order of trust."""
    c = B.table(spark, sf_dir, "companies")
    h = F.col("id")
    n = h.cast("string")
    part = lambda test, *xs: F.when(test, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])).otherwise("")
    html = F.concat(
        part(h % 2 == 0, "<html><head><title> Green \n School ", n, "</title>"), part(h % 2 == 1, "<html><head><title> Page ", n, "</title>"),
        part(h % 12 == 0, '<meta name="description" content="We are  site ', n, '">'), F.lit("<style>.x{founded in 1800}</style></head><body>"),
        part(h % 12 != 0, '<div id="about">About <b>text</b> of ', n, "</div>"), part(h % 4 == 0, "<p>Founded in ", (F.lit(1950) + h % 60).cast("string"), "</p>"),
        part(h % 9 == 0, "<p>", (F.lit(10) + h).cast("string"), " employees</p>"), part(h % 8 == 0, '<a href="https://facebook.com/page', n, '/">f</a>'),
        part(h % 18 == 0, "<a>noise@example.com</a> <a>mail", n, "@real.in</a>"), F.lit("</body></html>"),
    )
    pages = spark.range(300).where("id % 6 = 0").select(F.concat(F.lit("https://www.site"), n, F.lit(".com")).alias("url"), html.alias("html"))
    k, t = F.col("k"), F.col("k").cast("string")
    links = F.map_filter(F.create_map(F.lit("facebook"), F.when(k % 7 == 0, F.concat(F.lit("https://facebook.com/raw"), t)), F.lit("twitter"), F.when(k % 14 == 0, F.concat(F.lit("https://twitter.com/raw"), t))), lambda _, v: v.isNotNull())
    facts = c.select("company_id", (k % 4).alias("n_records"), F.when(k % 3 == 0, F.concat(F.lit("raw"), t, F.lit("@x.in"))).alias("email"), F.when(k % 11 == 0, F.array(F.concat(F.lit("98"), t))).alias("phones"), F.lit(None).cast("string").alias("google_maps_url"), F.when(F.size(links) > 0, links).alias("social_links"))
    e = stages.enrich(c.withColumn("website", F.when(k % 6 == 0, F.col("website"))), facts, pages)
    link = lambda p: F.try_element_at("social_links", F.lit(p)).alias(p)
    return e.select("company_id", "industry", "industry_source", "company_size", "founded_year", "description", "description_source", link("facebook"), link("twitter"), "email", "email_source", F.get("additional_phones", F.lit(0)).alias("phones"), "raw_records_count")


@query(f"SELECT '1.0' AS version, key AS factor, value AS weight FROM (VALUES {', '.join(f'({q(k)}, {w / 100}::DOUBLE)' for k, w in C.SCORE_WEIGHTS.items())}) AS t(key, value)")
def scoring_formula(spark, sf_dir):
    return spark.range(1).select(A.scoring_formula().alias("f")).select(F.col("f.version").alias("version"), F.explode("f.weights").alias("factor", "weight")).withColumn("weight", F.col("weight").cast("double"))


# ---- sinks


@query(f"{B.with_('raw')} SELECT organization_id, 2 * count(*) AS n FROM t_raw GROUP BY organization_id")
def raw_appended(spark, sf_dir):
    """Raw records are added twice; none is replaced."""
    path = _folder(spark, "raw")
    for _ in range(2):
        write.append_raw(B.table(spark, sf_dir, "raw"), path)
    return spark.read.parquet(path).groupBy("organization_id").agg(F.count("*").alias("n"))


@query(f"{B.with_('raw')} SELECT organization_id, id FROM t_raw WHERE organization_id = 'org-2' OR (organization_id = 'org-1' AND minutes < 500)")
def tenants_replaced(spark, sf_dir):
    """Of three organizations, one gets fewer rows, one stays, and one is emptied."""
    path, raw = _folder(spark, "tenants"), B.table(spark, sf_dir, "raw").select("organization_id", "id", "minutes")
    for org in ("org-1", "org-2", "org-3"):
        write.replace_tenant(stages.of_tenant(raw, org), org, path)
    write.replace_tenant(stages.of_tenant(raw, "org-1").where("minutes < 500"), "org-1", path)
    write.replace_tenant(stages.of_tenant(raw, "org-3").where("false"), "org-3", path)
    return write.tenants(spark, path).select("organization_id", "id")


@query(f"{B.with_('raw')} SELECT r.id AS record_id, md5('c' || r.minutes) AS company_id FROM t_raw r")
def records_linked(spark, sf_dir):
    raw = B.table(spark, sf_dir, "raw")
    assigned = raw.select(F.col("id").alias("record_id"), F.col("minutes").alias("root"))
    links = raw.select(F.col("minutes").alias("root")).distinct().withColumn("company_id", F.md5(F.concat(F.lit("c"), F.col("root").cast("string"))))
    return stages.link_back(assigned, links)


@query(f"""{_LEADS} SELECT name AS company_name, coalesce(phone, '') AS phone, coalesce(city, '') AS city, coalesce(email, '') AS email, CASE WHEN facebook IS NULL THEN '' ELSE '{{"facebook":"' || facebook || '"}}' END AS enrichment_social_links, CASE WHEN coalesce(industry, '') <> '' THEN 'enrichment' ELSE 'raw_data' END AS source
FROM leads WHERE total_score >= 70""")
def leads_as_csv(spark, sf_dir):
    """The lead export, written as CSV and read again; empty texts stand for nulls."""
    path = _folder(spark, "leads")
    c, e, v, s = _tables(spark, sf_dir, "companies", "enrichments", "validations", "scores")
    write.export_leads(serve.export_rows(c, e, v, s, serve.Filters(min_score=70)), path, {"min_score": 70})
    back = spark.read.csv(path, header=True, escape='"')
    assert back.columns == C.LEAD_CSV_COLUMNS
    return back.select("company_name", *[F.coalesce(x, F.lit("")).alias(x) for x in ("phone", "city", "email", "enrichment_social_links", "source")])


@query(f"{_LEADS} SELECT 'csv' AS format, count(*) AS record_count, '{{\"min_score\": 70}}' AS applied_filters, {len(C.LEAD_CSV_COLUMNS)} AS n_columns FROM leads WHERE total_score >= 70")
def export_record(spark, sf_dir):
    """The record that an export leaves: its format, rows, filters and columns."""
    import json

    c, e, v, s = _tables(spark, sf_dir, "companies", "enrichments", "validations", "scores")
    f = serve.Filters(min_score=70)
    made = write.export_leads(serve.export_rows(c, e, v, s, f), _folder(spark, "leads"), f.applied())
    return spark.createDataFrame([(made["format"], made["record_count"], json.dumps(made["applied_filters"]), len(made["columns"]))], "format string, record_count long, applied_filters string, n_columns int")


@query(f"WITH {O.CLEANED} SELECT record_id, name, phone, city, 'cleaned' AS status FROM cleaned")
def cleaned_stored(spark, sf_dir):
    """Cleaned records, written beside the raw ones and read again."""
    path = _folder(spark, "cleaned")
    write.store_cleaned(stages.clean(raw_records(spark, sf_dir)).withColumn("_work", F.lit(1)), path)
    back = spark.read.parquet(path)
    assert "_work" not in back.columns
    return back.select("record_id", "name", "phone", "city", "status")


# ---- facts of raw records, and positions of cities


@query("""WITH r AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), f AS (SELECT k, 'c' || (k % 30) AS company_id, k % 7 AS minutes, CASE k % 4 WHEN 0 THEN 'A' || k || '@x.in' WHEN 1 THEN 'no mail' WHEN 2 THEN '' END AS email, CASE WHEN k % 5 = 0 THEN 'https://m/' || k END AS maps, CASE WHEN k % 3 = 0 THEN 'https://facebook.com/' || k END AS facebook, CASE WHEN k % 6 = 1 THEN 'https://linkedin.com/' || k END AS linkedin FROM r
), t AS (SELECT *, minutes * 1000000000 + k AS turn FROM f)
SELECT company_id, count(*) AS n_records, arg_min(email, CASE WHEN email <> '' THEN turn END) AS first_email, min(CASE WHEN contains(email, '@') THEN lower(email) END) AS email, arg_min(maps, CASE WHEN maps IS NOT NULL THEN turn END) AS google_maps_url,
  arg_max(facebook, CASE WHEN facebook IS NOT NULL THEN turn END) AS facebook, arg_max(linkedin, CASE WHEN linkedin IS NOT NULL THEN turn END) AS linkedin FROM t GROUP BY company_id""")
def record_facts(spark, sf_dir):
    """What raw records say of their companies: of links to one platform the latest wins."""
    from ..sources.payload import payload

    k = F.col("k")
    t = k.cast("string")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"))
    email = F.when(k % 4 == 0, F.concat(F.lit("A"), t, F.lit("@x.in"))).when(k % 4 == 1, "no mail").when(k % 4 == 2, "")
    url = lambda test, base: F.when(test, F.concat(F.lit(base), t))
    data = payload(email=email, maps_url=url(k % 5 == 0, "https://m/"), m_facebook_url=url(k % 3 == 0, "https://facebook.com/"), m_linkedin_url=url(k % 6 == 1, "https://linkedin.com/"))
    raw = rows.select(F.lpad(t, 12, "0").alias("id"), F.lit("web_search").alias("source_adapter"), B.at(k % 7).alias("retrieved_at"), data.alias("raw_data"), F.concat(F.lit("c"), (k % 30).cast("string")).alias("c"))
    facts = stages.record_facts(raw.drop("c"), raw.select(F.col("id").alias("record_id"), F.col("c").alias("company_id")))
    link = lambda p: F.try_element_at("social_links", F.lit(p)).alias(p)
    return facts.select("company_id", "n_records", "first_email", "email", "google_maps_url", link("facebook"), link("linkedin"))


@query(f"""{B.with_('companies')}, d AS (SELECT * FROM (VALUES ('goa', 15.5, 74.0), {', '.join(f"({q(c)}, {x}, {y})" for c, (x, y) in C.CITY_POSITIONS.items() if c != 'goa')}) AS v(city, a, o))
SELECT company_id, CASE WHEN coalesce(latitude <> 0 AND longitude <> 0, false) THEN latitude ELSE CAST(d.a AS DOUBLE) END AS latitude, CASE WHEN coalesce(latitude <> 0 AND longitude <> 0, false) THEN longitude ELSE CAST(d.o AS DOUBLE) END AS longitude FROM t_companies c LEFT JOIN d ON lower(trim(c.city)) = d.city""")
def company_positions(spark, sf_dir):
    """Companies without a position take their city's, from the known cities and one that is added."""
    more = spark.createDataFrame([("Goa", 15.5, 74.0)], "city string, latitude double, longitude double")
    return relevance.with_position(B.table(spark, sf_dir, "companies"), relevance.city_positions(spark, more)).select("company_id", "latitude", "longitude")


# ---- streams


def _stream(spark, sf_dir):
    """Raw records that arrive in three files, each with a third of the names; the last repeats names of the first in capitals."""
    base = _folder(spark, "stream")
    recorder = stream_records.record(spark, f"{base}/progress")
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    from ..sources.payload import payload

    for part in range(3):
        name = F.concat(F.lit("firm " if part < 2 else "FIRM "), F.hex(F.col("k") % F.lit(10_000_000) * F.lit(7_919)))
        phone = F.concat(F.lit("9"), F.lpad((F.col("k") * F.lit(3) + F.lit(part)).cast("string"), 9, "0"))
        rows = keys.where(F.col("k") % 2 == part % 2).select(
            F.concat(F.lit(f"{part}-"), F.col("k").cast("string")).alias("id"), F.lit("o").alias("organization_id"), F.lit("r").alias("pipeline_run_id"), F.lit("web_search").alias("source_adapter"), F.concat(F.lit(f"s{part}-"), F.col("k").cast("string")).alias("source_record_id"),
            F.lit("extracted").alias("status"), F.timestamp_seconds(F.lit(1704067200) + F.col("k")).alias("retrieved_at"), F.lit(None).cast("string").alias("company_id"), payload(name=name, phone=phone).alias("raw_data"),
        )
        rows.coalesce(1).write.mode("append").parquet(f"{base}/raw")
        run = ingest.start(spark, f"{base}/raw", f"{base}/companies", f"{base}/links", f"{base}/checkpoint", buckets=16)
        run.awaitTermination()
        seen = ingest.progress(spark, run) if part == 0 else seen.unionByName(ingest.progress(spark, run))
    stream_records.stop(spark, recorder)
    return base, seen


_STREAMED = f"""WITH RECURSIVE k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier), r AS (
  SELECT part, k, part * 1000000000000 + k AS node, CASE WHEN part < 2 THEN 'firm ' ELSE 'FIRM ' END || upper(to_hex((k % 10000000) * 7919)) AS raw_name, '9' || lpad(CAST(k * 3 + part AS VARCHAR), 9, '0') AS raw_phone
  FROM k, (VALUES (0), (1), (2)) AS p(part) WHERE k % 2 = part % 2
), cleaned AS MATERIALIZED (SELECT part, node, {O.std_name('raw_name')} AS name, {O.std_phone('raw_phone')} AS phone FROM r
), named AS MATERIALIZED (SELECT *, {O.BIGRAMS('m')} AS g FROM (SELECT *, {O.match_name('name')} AS m FROM cleaned) WHERE length(m) >= 3
), alike AS MATERIALIZED (SELECT x.node AS a, y.node AS b FROM named x JOIN named y ON x.part = y.part AND x.node < y.node WHERE x.m = y.m OR {O.DICE('x.g', 'y.g', 'x.m', 'y.m')} >= 0.85
), {O.closure('merged', 'alike')}, clusters AS (SELECT DISTINCT coalesce(label, cleaned.node) AS node FROM cleaned LEFT JOIN merged ON merged.node = cleaned.node
), found AS (SELECT node, md5(lower(trim(name))) AS company_id, phone FROM clusters JOIN cleaned USING (node))"""


@query(f"{_STREAMED} SELECT company_id, arg_min(phone, node) AS phone FROM found GROUP BY company_id")
def streamed_companies(spark, sf_dir):
    """The company table after three batches: names that are alike in a batch merge, and names that arrive again keep their first phone."""
    base, _ = _stream(spark, sf_dir)
    return ingest.latest(spark, f"{base}/companies").select("company_id", "phone")


@query("SELECT unnest([0, 1, 2])::BIGINT AS batch_id")
def stream_batches(spark, sf_dir):
    """The batches that three starts of one stream report."""
    return _stream(spark, sf_dir)[1].select("batch_id")


@query("WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier) SELECT CAST(part AS BIGINT) AS batch_id, count(*) AS n_rows FROM k, (VALUES (0), (1), (2)) AS p(part) WHERE k % 2 = part % 2 GROUP BY part")
def stream_progress(spark, sf_dir):
    """The rows of each batch of a stream that was started three times, as its listener has stored them."""
    base, _ = _stream(spark, sf_dir)
    return stream_records.progress(spark, f"{base}/progress").select("batch_id", "n_rows")


@query(f"""WITH k AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier), r AS (
  SELECT part, k, (k * 37) % 1000 AS sec, part || '-' || k AS id, CASE WHEN part < 2 THEN 'firm ' ELSE 'FIRM ' END || upper(to_hex((k // 3) * 7919)) AS raw_name, CASE WHEN k % 3 <> part THEN '9' || lpad(CAST(k * 3 + part AS VARCHAR), 9, '0') END AS raw_phone
  FROM k, (VALUES (0), (1), (2)) AS p(part) WHERE k % 2 = part % 2
), c AS (SELECT part, sec, id, {O.std_name('raw_name')} AS name, {O.std_phone('raw_phone')} AS phone, 1 AS n FROM r
), every AS (
  SELECT md5(lower(trim(name))) AS company_id, * FROM c
  UNION ALL SELECT DISTINCT md5('firm ' || lower(to_hex((k // 3) * 7919))), -1, 0, '', 'firm ' || lower(to_hex((k // 3) * 7919)), CASE WHEN (k // 3) % 2 = 0 THEN '+910000000001' END, 10 FROM k WHERE (k // 3) % 5 = 0
), o AS (SELECT *, row_number() OVER (ORDER BY part, sec, id) AS turn FROM every)
SELECT company_id, arg_min(name, turn) AS name, arg_min(phone, turn) FILTER (phone IS NOT NULL) AS phone, CAST(sum(n) AS BIGINT) AS n_records FROM o GROUP BY company_id HAVING max(part) >= 0""")
def stateful_companies(spark, sf_dir):
    """Companies in the state store after three files and as many starts of one stream; some are known before."""
    from ..sources.payload import payload

    base, k = _folder(spark, "state"), F.col("k")
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    number = F.hex(F.floor(k / 3) * F.lit(7_919))
    name = F.concat(F.lit("firm "), F.lower(number))
    known = keys.where("floor(k / 3) % 5 = 0").select(name.alias("name"), F.when(F.floor(k / 3) % 2 == 0, "+910000000001").alias("phone")).distinct()
    known = known.select(R.company_key().alias("company_id"), "name", "phone", *[F.lit(None).cast("string").alias(f) for f in company_state.TEXTS if f != "phone"], *[F.lit(None).cast("double").alias(f) for f in company_state.NUMBERS], F.lit(10).alias("n_records"))
    for part in range(3):
        of = F.concat(F.lit("firm " if part < 2 else "FIRM "), number)
        phone = F.when(k % 3 != part, F.concat(F.lit("9"), F.lpad((k * 3 + part).cast("string"), 9, "0")))
        rows = keys.where(k % 2 == part % 2).select(
            F.concat(F.lit(f"{part}-"), k.cast("string")).alias("id"), F.lit("o").alias("organization_id"), F.lit("r").alias("pipeline_run_id"), F.lit("web_search").alias("source_adapter"), F.concat(F.lit(f"s{part}-"), k.cast("string")).alias("source_record_id"),
            F.lit("extracted").alias("status"), F.timestamp_seconds(F.lit(1704067200) + (k * 37) % 1000).alias("retrieved_at"), F.lit(None).cast("string").alias("company_id"), payload(name=of, phone=phone).alias("raw_data"),
        )
        rows.coalesce(1).write.mode("append").parquet(f"{base}/raw")
        company_state.start(spark, f"{base}/raw", f"{base}/out", f"{base}/checkpoint", known).awaitTermination()
    return company_state.current(spark, f"{base}/out").select("company_id", "name", "phone", "n_records")


@query(f"WITH RECURSIVE {O.CLUSTERS} SELECT root, record_id, idx FROM assigned")
def members_run_by_run(spark, sf_dir):
    """The clusters of all records after three runs of a third of the time each, which meet in a stored index."""
    rows = cleaned(spark, sf_dir).checkpoint()
    first, last = rows.agg(F.unix_micros(F.min("retrieved_at")), F.unix_micros(F.max("retrieved_at"))).first()
    third = F.floor((F.unix_micros("retrieved_at") - F.lit(first)) * 3 / F.lit(last - first + 1))
    return resolve_runs(spark, [rows.where(third == k) for k in range(3)], _folder(spark, "runs"), buckets=8).select("root", "record_id", "idx")


@query("SELECT CAST(p_partkey AS BIGINT) AS k, p_name FROM part WHERE contains(lower(p_name), (SELECT lower(max(p_name)) FROM part))")
def names_in_few_files(spark, sf_dir):
    """The rows that contain the last of all names, from the files alone whose trigrams allow it."""
    path, index = _folder(spark, "names"), _folder(spark, "trigrams")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"), "p_name")
    rows.repartitionByRange(16, "p_name").write.parquet(path)
    file_skipping.build(spark, path, ["p_name"], index)
    return file_skipping.containing(spark, path, index, "p_name", rows.agg(F.max("p_name")).first()[0])
