"""Counts and summaries, each in one pass over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C

STATUS_FIELDS = ["email_status", "phone_status", "website_status", "business_existence_status", "overall_status"]
_none_is_zero = lambda c: F.coalesce(c, F.lit(0))


def dashboard(raw: DataFrame, companies: DataFrame, runs: DataFrame) -> DataFrame:
    """(kind, n) for runs, records and companies."""
    one = lambda t, kind: t.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(runs, "runs").unionByName(one(raw, "records")).unionByName(one(companies, "companies"))


def status_counts(validations: DataFrame) -> DataFrame:
    """(field, status, n) over the five statuses, by one unpivot."""
    return validations.unpivot([], STATUS_FIELDS, "field", "status").groupBy("field", "status").agg(F.count("*").alias("n"))


def validation_summary(validations: DataFrame) -> DataFrame:
    counters = [F.count_if(F.col(f) == s).alias(f"{f.removesuffix('_status')}_{s.lower()}") for f in STATUS_FIELDS for s in ("VALID", "INVALID", "UNKNOWN", "NOT_AVAILABLE") if not (f in ("overall_status", "business_existence_status") and s == "NOT_AVAILABLE")]
    return validations.agg(F.count("*").alias("companies_read"), *counters)


def enrichment_stats(enrichments: DataFrame) -> DataFrame:
    return enrichments.agg(F.count("*").alias("total"), *[F.count(c).alias(f"with_{c}") for c in ("industry", "social_links", "email", "description", "founded_year")])


def enrichment_summary(enrichments: DataFrame) -> DataFrame:
    from_name = F.coalesce(F.col("industry_source"), F.lit("")).startswith("inferred")
    meta = F.col("additional_phones").isNotNull() | (F.col("email_source") == "raw_data_metadata") | (F.col("social_links_source") == "raw_data_metadata")
    return enrichments.agg(
        F.count("*").alias("enriched"), F.count("description_source").alias("with_website_scrape"), F.count_if(from_name).alias("with_industry_inference"), F.count_if(meta).alias("with_metadata_extraction"),
        *[F.count(c).alias(f"with_{c}") for c in ("social_links", "email", "founded_year", "company_size", "description")],
    )


def score_stats(scores: DataFrame) -> DataFrame:
    """Count, mean, least and largest total (zeros for no rows), and how many are high (60 or more), medium (35 or more) and low."""
    s = F.col("total_score")
    return scores.agg(
        F.count("*").alias("total"), _none_is_zero(F.bround(F.avg(s.cast("double")), 2)).alias("avg_score"), _none_is_zero(F.min(s)).cast("double").alias("min_score"), _none_is_zero(F.max(s)).cast("double").alias("max_score"),
        F.count_if(s >= 60).alias("high"), F.count_if((s >= 35) & (s < 60)).alias("medium"), F.count_if(s < 35).alias("low"),
    )


def lead_stats(companies: DataFrame, scores: DataFrame, enrichments: DataFrame) -> DataFrame:
    rows = companies.select("company_id", "phone").join(scores.select("company_id", "total_score"), "company_id", "left").join(enrichments.select("company_id", "industry"), "company_id", "left")
    return rows.agg(F.count("*").alias("total"), F.count("total_score").alias("with_score"), F.count("phone").alias("with_phone"), F.count("industry").alias("with_industry"))


def extraction_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source_adapter").agg(F.count("*").alias("n"))


def source_breakdown(leads: DataFrame) -> DataFrame:
    return leads.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source")


def source_stats(raw: DataFrame, runs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One row for each source: records, records it contributed to, runs, the last completed run, and its status."""
    spark = raw.sparkSession
    listed = spark.createDataFrame([(n, n not in C.SELECTABLE_SOURCES) for n in C.SOURCES], "source string, requires_api_key boolean")
    found = raw.groupBy(F.col("source_adapter").alias("source")).agg(F.count("*").alias("candidates_contributed"))
    given = raw.select(F.explode(F.array_distinct("raw_data.metadata.contributing_sources")).alias("source")).groupBy("source").agg(F.count("*").alias("leads_enriched"))
    used = runs.select("created_at", "status", F.explode(F.array_distinct("sources_used")).alias("source"))
    ran = used.groupBy("source").agg(F.count("*").alias("total_runs"), F.max(F.when(F.col("status") == "completed", F.col("created_at"))).alias("last_run_at"))
    out = listed.join(found, "source", "left").join(given, "source", "left").join(ran, "source", "left")
    if keys is None:
        out = out.withColumn("has_api_key", F.lit(False))
    else:
        active = keys.where("status = 'active'").select(F.col("source_adapter").alias("source"), F.lit(True).alias("has_api_key")).distinct()
        out = out.join(active, "source", "left").withColumn("has_api_key", F.coalesce("has_api_key", F.lit(False)) & F.col("requires_api_key"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select("source", "requires_api_key", n("candidates_contributed"), n("leads_enriched"), n("total_runs"), "last_run_at", "has_api_key")
    status = F.when(F.col("requires_api_key") & ~F.col("has_api_key"), "not_configured").when(F.col("candidates_contributed") > 0, "active").otherwise("available")
    return out.withColumn("status", status)


def map_counts(leads: DataFrame) -> DataFrame:
    ok = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude")
    return leads.agg(F.count_if(ok).alias("with_position"), F.count_if(~ok).alias("without_position"))
