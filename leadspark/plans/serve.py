"""Read queries over companies, enrichments, validations, scores, raw records, runs and saved leads.

Tables are DataFrames with the columns of the stages plus organization_id.  Orders end in
the primary key, so that pages do not overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.assess import tier
from ..functions.text import full, or_null


@dataclass(frozen=True)
class Filters:
    """Optional filters; None leaves a filter out."""

    min_score: float | None = None
    max_score: float | None = None
    industry: str | None = None
    city: str | None = None
    has_phone: bool | None = None
    has_email: bool | None = None
    has_website: bool | None = None
    validation_status: str | None = None
    source: str | None = None

    def applied(self) -> dict:
        """The filters in use; flags that are False count as in use, empty texts do not."""
        out = {k: v for k, v in self.__dict__.items() if v is not None and v != ""}
        return out | ({"validation_status": out["validation_status"].upper()} if "validation_status" in out else {})


def like(column: str, part: str) -> Column:
    """Case-insensitive containment; % and _ in `part` are wildcards."""
    return F.col(column).ilike(f"%{part}%")


def present(column: str, wanted: bool) -> Column:
    return F.col(column).isNotNull() if wanted else F.col(column).isNull()


def filtered(df: DataFrame, f: Filters) -> DataFrame:
    if f.min_score is not None:
        df = df.where(F.col("total_score") >= f.min_score)
    if f.max_score is not None:
        df = df.where(F.col("total_score") <= f.max_score)
    if f.industry:
        df = df.where(like("industry", f.industry))
    if f.city:
        df = df.where(like("city", f.city))
    for flag, column in ((f.has_phone, "phone"), (f.has_email, "email"), (f.has_website, "website")):
        if flag is not None:
            df = df.where(present(column, flag))
    if f.validation_status:
        df = df.where(F.col("overall_status") == f.validation_status.upper())
    return df.where(F.array_contains("sources", f.source)) if f.source else df


def page(df: DataFrame, limit: int, offset: int = 0, most: int | None = None) -> DataFrame:
    """Rows offset .. offset + limit of a sorted frame; Spark takes only the first rows of each task."""
    if limit < 1 or offset < 0 or (most is not None and limit > most):
        raise ValueError(f"limit must lie between 1 and {most or 'any'}, and offset not be negative")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def numbered_page(df: DataFrame, number: int, size: int, most: int = 100) -> DataFrame:
    if number < 1:
        raise ValueError("pages start at 1")
    return page(df, size, (number - 1) * size, most)


def company_sources(record_company: DataFrame, raw: DataFrame) -> DataFrame:
    """(company_id, sources): sorted, so that the first one is the same in every run."""
    rows = raw.drop("company_id").join(record_company.withColumnRenamed("record_id", "id"), "id").where(F.col("company_id").isNotNull())
    return rows.groupBy("company_id").agg(F.array_sort(F.collect_set("source_adapter")).alias("sources"))


def saved_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy("company_id").agg(F.count("*").alias("saved_count"))


def is_uuid(x: str | None) -> bool:
    return bool(x and re.fullmatch(r"[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}", x))


def unified_leads(companies: DataFrame, enrichments: DataFrame, validations: DataFrame, scores: DataFrame, sources: DataFrame, saved: DataFrame, run_companies: DataFrame | None = None) -> DataFrame:
    """One row for each company with what the other tables know of it; zero ratings, positions and review counts become null, a zero score stays."""
    rows = companies if run_companies is None else companies.join(run_companies.select("company_id").distinct(), "company_id", "left_semi")
    for t, cols in ((enrichments, ("industry", "email", "description", "social_links", "founded_year", "company_size")), (validations, ("overall_status",)), (scores, ("total_score",)), (sources, ("sources",)), (saved, ("saved_count",))):
        rows = rows.join(t.select("company_id", *cols), "company_id", "left")
    zero = lambda c: F.nullif(F.col(c), F.lit(0).cast(rows.schema[c].dataType)).alias(c)
    return rows.select(
        "company_id", "name", "industry", "address", "city", "state", "country", "phone", "email", "website", zero("rating"), zero("review_count"), zero("latitude"), zero("longitude"), "description", "social_links", "founded_year", "company_size",
        "overall_status", "total_score", "sources", F.get("sources", F.lit(0)).alias("source"), (F.coalesce("saved_count", F.lit(0)) > 0).alias("is_saved"),
    )


def list_leads(leads: DataFrame, f: Filters = Filters(), limit: int = 200, offset: int = 0) -> DataFrame:
    """Best first, companies without a score last."""
    return page(filtered(leads, f).orderBy(F.col("total_score").desc_nulls_last(), "company_id"), limit, offset, 1000)


def get_lead(leads: DataFrame, company_id: str) -> DataFrame:
    return leads.where(F.col("company_id") == company_id)


def scored_leads(companies: DataFrame, enrichments: DataFrame, validations: DataFrame, scores: DataFrame, f: Filters = Filters(), limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Scores with their companies.  A filter on enrichment or validation keeps only companies that have such a row, so has_email=False leaves out those never enriched."""
    rows = scores.join(companies, "company_id")
    if f.industry or f.has_email is not None:
        rows = rows.join(enrichments.select("company_id", "industry", "email"), "company_id")
    if f.validation_status:
        rows = rows.join(validations.select("company_id", "overall_status"), "company_id")
    rows = filtered(rows, f).withColumn("tier", tier(F.col("total_score")))
    columns = ["company_id", "name", "phone", "website", "city", "state", *[c for c in scores.columns if c != "company_id"], "tier"]
    rows = rows.select(*columns).orderBy(F.col("total_score").desc(), "company_id")
    return rows if limit is None else page(rows, limit, offset, 500)


def validation_results(validations: DataFrame, companies: DataFrame, status: str | None = None) -> DataFrame:
    rows = validations.join(companies.select("company_id", "name"), "company_id")
    return rows.where(F.col("overall_status") == status.upper()) if status else rows


def enrichment_results(enrichments: DataFrame, companies: DataFrame, has_industry: bool | None = None) -> DataFrame:
    rows = enrichments.join(companies.select("company_id", "name"), "company_id")
    return rows if has_industry is None else rows.where(present("industry", has_industry))


def raw_results(raw: DataFrame, run_id: str | None = None, source: str | None = None, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a page, latest first; one row with the count of all)."""
    rows = raw if run_id is None else raw.where(F.col("pipeline_run_id") == run_id)
    rows = rows if source is None else rows.where(F.col("source_adapter") == source)
    return numbered_page(rows.orderBy(F.col("retrieved_at").desc(), "id"), number, size), rows.agg(F.count("*").alias("total"))


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), "id").limit(n)


def run_companies(raw: DataFrame, record_company: DataFrame, run_id: str) -> DataFrame | None:
    """The companies of a run, or None for a malformed id, which filters nothing."""
    if not is_uuid(run_id):
        return None
    return raw.drop("company_id").where(F.col("pipeline_run_id") == run_id).join(record_company.withColumnRenamed("record_id", "id"), "id").select("company_id").where(F.col("company_id").isNotNull()).distinct()


def new_leads(requests: DataFrame, companies: DataFrame, runs: DataFrame, raw: DataFrame, record_company: DataFrame, enrichments: DataFrame, validations: DataFrame, scores: DataFrame, leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads to save, refused requests with a reason) for requests(company_id, pipeline_run_id, raw_record_id).

    A request without a record takes the first one of the company in the run.  Refused are unknown
    companies, runs and records, and leads that are saved already.
    """
    known = requests.dropDuplicates().join(companies.select("company_id", F.lit(True).alias("has_company")), "company_id", "left").join(runs.select(F.col("id").alias("pipeline_run_id"), F.lit(True).alias("has_run")), "pipeline_run_id", "left")
    linked = raw.drop("company_id").join(record_company.withColumnRenamed("record_id", "id"), "id")
    first = linked.groupBy("company_id", "pipeline_run_id").agg(F.min_by("id", F.struct("retrieved_at", "id")).alias("first_record"))
    known = known.join(first, ["company_id", "pipeline_run_id"], "left").join(raw.select(F.col("id").alias("raw_record_id"), F.lit(True).alias("has_record")), "raw_record_id", "left")
    record = F.when(F.col("raw_record_id").isNull(), F.col("first_record")).when(F.col("has_record"), F.col("raw_record_id"))
    known = known.withColumn("record", record)
    key = ["company_id", "pipeline_run_id", "record"]
    saved = leads.select("company_id", "pipeline_run_id", F.col("raw_record_id").alias("record"), F.lit(True).alias("saved")).distinct()
    known = known.join(saved, key, "left")
    reason = F.when(F.col("has_company").isNull(), "company not found").when(F.col("has_run").isNull(), "run not found").when(F.col("record").isNull(), "record not found").when(F.col("saved"), "already saved")
    known = known.withColumn("reason", reason)
    factors = ["industry_score", "size_score", "location_score", "technology_score", "data_quality_score", "validation_score"]
    rows = known.where(F.col("reason").isNull()).select(*key).distinct()
    rows = rows.join(validations.select("company_id", "overall_status"), "company_id", "left").join(enrichments.select("company_id", F.lit(True).alias("enriched")), "company_id", "left").join(scores, "company_id", "left")
    parts = F.struct(*[F.nullif(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in factors])
    new = rows.select(
        F.md5(F.concat_ws("|", *key)).alias("id"), "company_id", "pipeline_run_id", F.col("record").alias("raw_record_id"), F.coalesce("overall_status", F.lit("pending")).alias("validation_status"), F.lit(None).cast("string").alias("validation_issues"),
        F.when(F.col("enriched"), "completed").otherwise("pending").alias("enrichment_status"), F.col("total_score").alias("lead_score"), "score_version", F.when(F.col("total_score").isNotNull(), parts).alias("score_components"),
    )
    return new, known.where(F.col("reason").isNotNull()).select("company_id", "pipeline_run_id", "raw_record_id", "reason")


def location_label(city: Column, state: Column, address: Column) -> Column:
    label = F.concat_ws(", ", or_null(city), or_null(state))
    return F.when(label != "", label).otherwise(address)


def on_map(leads: DataFrame) -> DataFrame:
    """Leads with a position that can be drawn."""
    return leads.where("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)")


def export_rows(companies: DataFrame, enrichments: DataFrame, validations: DataFrame, scores: DataFrame, f: Filters = Filters()) -> DataFrame:
    """The columns of the lead export, best first; all text but for social links, which stay a map."""
    rows = scores.join(companies, "company_id").join(enrichments.select("company_id", "industry", "email", "description", "social_links", "founded_year"), "company_id", "left").join(validations.select("company_id", "overall_status"), "company_id", "left")
    rows = filtered(rows, f).orderBy(F.col("total_score").desc(), "company_id")
    return rows.select(
        F.col("name").alias("company_name"), "industry", "address", "city", "state", "country", "phone", "email", "website", F.when(full(F.col("industry")), "enrichment").otherwise("raw_data").alias("source"), F.coalesce("website", F.lit("")).alias("source_url"),
        "rating", "review_count", "latitude", "longitude", F.col("overall_status").alias("validation_status"), F.col("description").alias("enrichment_description"), F.col("social_links").alias("enrichment_social_links"), F.col("founded_year").alias("enrichment_founded_year"),
        "industry_score", "size_score", "location_score", "technology_score", "data_quality_score", "validation_score", "total_score", "score_version",
    )
