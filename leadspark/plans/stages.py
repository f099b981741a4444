"""The stages between raw records and scored leads, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import assess as A
from ..functions import text as T
from ..operators import resolve as R


def of_tenant(table: DataFrame, organization_id: str | None, run_id: str | None = None) -> DataFrame:
    """The rows of one organization, and of one run if given; partitioned tables are pruned by it."""
    if organization_id is not None:
        table = table.where(F.col("organization_id") == organization_id)
    return table if run_id is None else table.where(F.col("pipeline_run_id") == run_id)


def clean(raw: DataFrame) -> DataFrame:
    """raw_records with their cleaned fields: record_id, source_adapter, source_record_id, retrieved_at, the fields, completeness and `changes`.

    changes lists the fields that cleaning altered, as `field: 'old' -> 'new'`, None for null.
    Only rows whose name or address has a character beyond ASCII go to Python, for the normal form of both at once.
    """
    get = lambda f: F.col(f"raw_data.{f}")
    raw = T.with_normal_form(raw, {"__name": get("name"), "__address": get("address")})
    cleaned = {"name": T.standard_name(F.col("__name")), "phone": T.standard_phone(get("phone")), "website": T.standard_url(get("website")), "address": T.standard_address(F.col("__address")), "city": T.standard_city(get("city")), "state": T.standard_state(get("state"))}
    rows = raw.select(
        F.col("id").alias("record_id"), "organization_id", "pipeline_run_id", "source_adapter", "source_record_id", "retrieved_at", F.col("raw_data").alias("raw"), *[v.alias(k) for k, v in cleaned.items()],
        get("latitude").alias("latitude"), get("longitude").alias("longitude"), get("rating").alias("rating"), get("reviews_count").alias("reviews_count"),
    )
    show = lambda x: F.coalesce(x, F.lit("None"))
    note = lambda f: F.when(~F.col(f"raw.{f}").eqNullSafe(F.col(f)), F.concat(F.lit(f"{f}: '"), show(F.col(f"raw.{f}")), F.lit("' -> '"), show(F.col(f)), F.lit("'")))
    done = T.completeness(*[F.col(c) for c in ("name", "phone", "address", "website", "city", "latitude", "longitude", "rating")])
    return rows.select("*", T.display_phone(F.col("phone")).alias("phone_display"), done.alias("completeness"), F.array_compact(F.array(*[note(f) for f in cleaned])).alias("changes")).drop("raw")


def resolve(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned records with idx and root, clusters): the order of retrieval decides which of equals is best."""
    assigned = R.assign_clusters(R.with_index(cleaned, "retrieved_at", "record_id")).checkpoint()
    return assigned, R.clusters(assigned)


def clean_summary(assigned: DataFrame, clusters: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """One row: records read, clusters, duplicates, changed and unchanged records, clusters of several and of one."""
    a = assigned.agg(F.count("*").alias("raw_records_read"), F.count_if(F.size("changes") > 0).alias("records_with_changes"), F.count_if(F.size("changes") == 0).alias("records_without_changes"))
    c = clusters.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("duplicates_identified"), F.count_if(F.col("size") > 1).alias("clusters_with_multiple"), F.count_if(F.col("size") == 1).alias("clusters_single"))
    out = a.join(c)  # one row each
    return out.join(created.agg(F.count("*").alias("companies_created"))) if created is not None else out


def link_back(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """(record_id, company_id): raw records stay as they are."""
    return assigned.join(links, "root").select("record_id", "company_id")


def record_facts(raw: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each company_id: what its raw records say beyond the company itself.

    sources, n_records, the first e-mail by retrieval, the least e-mail with an @, phones, the first
    map link, and social links, of which the latest of a platform wins.
    """
    rows = raw.join(links.withColumnRenamed("record_id", "id"), "id") if "company_id" not in raw.columns else raw.drop("company_id").join(links.withColumnRenamed("record_id", "id"), "id")
    turn = F.struct("retrieved_at", "id")
    get = lambda f: T.or_null(F.col(f"raw_data.{f}"))
    email, phone = T.or_null(T.strip(get("email"))), T.or_null(T.strip(get("phone")))
    maps = F.coalesce(get("maps_url"), get("metadata.maps_url"))
    social = {p: get(f"metadata.{p}_url") for p in ("facebook", "twitter", "linkedin", "instagram")}
    out = rows.groupBy("company_id").agg(
        F.array_sort(F.collect_set("source_adapter")).alias("sources"), F.count("*").alias("n_records"),
        F.min_by(get("email"), F.when(get("email").isNotNull(), turn)).alias("first_email"),
        F.min(F.when(F.contains(email, F.lit("@")), F.lower(email))).alias("email"),
        F.array_sort(F.collect_set(phone)).alias("phones"), F.min_by(maps, F.when(maps.isNotNull(), turn)).alias("google_maps_url"),
        *[F.max_by(v, F.when(v.isNotNull(), turn)).alias(f"social_{p}") for p, v in social.items()],
    )
    links_ = F.map_filter(F.create_map(*[x for p in social for x in (F.lit(p), F.col(f"social_{p}"))]), lambda k, v: v.isNotNull())
    return out.withColumn("social_links", F.when(F.size(links_) > 0, links_)).drop(*[f"social_{p}" for p in social])


def validate(companies: DataFrame, facts: DataFrame | None = None, domains: DataFrame | None = None, unknown_website: str = A.VALID) -> DataFrame:
    """One row for each company: statuses of its e-mail, phone, website and existence, and the overall status.

    Looking up domains is left to `domains`(domain, has_mx, resolves); where it has no row, e-mails
    are UNKNOWN and websites have the status given.
    """
    rows = companies
    if facts is not None:
        rows = rows.join(facts.select("company_id", F.col("first_email").alias("email"), "sources"), "company_id", "left")
    else:
        rows = rows.withColumn("email", F.lit(None).cast("string")).withColumn("sources", F.lit(None).cast("array<string>"))
    if domains is not None:
        known = domains.groupBy("domain").agg(F.max("has_mx").alias("has_mx"), F.max("resolves").alias("resolves"))  # a domain that is listed twice is one
        mail = known.select(F.col("domain").alias("mail_domain"), "has_mx")
        host = known.select(F.col("domain").alias("web_domain"), "resolves")
        rows = rows.withColumn("mail_domain", F.get(F.split(F.lower(T.strip(F.col("email"))), "@"), F.lit(1))).withColumn("web_domain", A.website_host(F.col("website")))
        rows = rows.join(mail, "mail_domain", "left").join(host, "web_domain", "left")
    else:
        rows = rows.withColumn("has_mx", F.lit(None).cast("boolean")).withColumn("resolves", F.lit(None).cast("boolean"))
    exists = A.existence(*[F.col(c) for c in ("name", "phone", "address", "city", "latitude", "longitude", "website", "rating", "sources")])
    out = rows.select(
        "company_id", A.email_status(F.col("email"), F.col("has_mx")).alias("email_status"), A.phone_status(F.col("phone")).alias("phone_status"),
        A.website_status(F.col("website"), F.col("resolves"), unknown_website).alias("website_status"), exists.alias("existence"),
    )
    status = A.overall_status(F.col("email_status"), F.col("phone_status"), F.col("website_status"), F.col("existence.status"))
    details = F.struct(*[F.col(c) for c in ("email_status", "phone_status", "website_status")], F.col("existence.score").alias("existence_score"), F.col("existence.fields_present").alias("fields_present"))
    return out.select("company_id", "email_status", "phone_status", "website_status", F.col("existence.status").alias("business_existence_status"), status.alias("overall_status"), details.alias("details"))


def enrich(companies: DataFrame, facts: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """One row for each company: what its website, its name and its raw records add, in this order of trust.

    pages(url, html) holds fetched websites by the company's website; companies without one go without.
    """
    rows = companies.select("company_id", "name", "website")
    if pages is not None:
        read = pages.select(F.col("url").alias("website"), A.page_facts(F.col("html")).alias("page")).dropDuplicates(["website"])
        rows = rows.join(read, "website", "left")
    else:
        rows = rows.withColumn("page", A.page_facts(F.lit(None).cast("string")))
    if facts is not None:
        rows = rows.join(facts.select("company_id", "n_records", F.col("email").alias("own_email"), "phones", "google_maps_url", F.col("social_links").alias("own_links")), "company_id", "left")
    else:
        for c, kind in (("n_records", "long"), ("own_email", "string"), ("phones", "array<string>"), ("google_maps_url", "string"), ("own_links", "map<string,string>")):
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    site = F.when(F.coalesce(*[F.col(f"page.{c}") for c in ("title", "description", "founded_year", "company_size", "email", "industry")], F.when(F.col("page.social_links").isNotNull(), "x")).isNotNull(), F.concat(F.lit("website:"), "website"))
    rows, by_name = rows.withColumn("by_name", A.industry_of_name(F.col("name"))), F.col("by_name")
    none = F.create_map().cast("map<string,string>")
    page_links, own_links = F.coalesce("page.social_links", none), F.coalesce("own_links", none)
    both = F.map_concat(F.map_filter(own_links, lambda k, v: ~F.map_contains_key(page_links, k)), page_links)
    origin = lambda x, y, label: F.when(x.isNotNull(), site).when(y.isNotNull(), label)
    meta = F.lit("raw_data_metadata")
    return rows.select(
        "company_id", F.coalesce("page.industry", by_name).alias("industry"), origin(F.col("page.industry"), by_name, F.concat(F.lit("inferred_from_name:"), "name")).alias("industry_source"),
        F.col("page.company_size").alias("company_size"), F.when(F.col("page.company_size").isNotNull(), site).alias("company_size_source"), F.lit(None).cast("string").alias("revenue_range"),
        F.col("page.founded_year").alias("founded_year"), F.when(F.col("page.founded_year").isNotNull(), site).alias("founded_year_source"), F.col("page.description").alias("description"), site.alias("description_source"),
        F.when(F.size(both) > 0, both).alias("social_links"), origin(F.col("page.social_links"), F.col("own_links"), meta).alias("social_links_source"), F.lit(None).cast("array<string>").alias("technologies"),
        F.coalesce("page.email", "own_email").alias("email"), origin(F.col("page.email"), F.col("own_email"), meta).alias("email_source"),
        F.when(F.size("phones") > 0, F.col("phones")).alias("additional_phones"), F.when(F.size("phones") > 0, meta).alias("additional_phones_source"), "google_maps_url", F.coalesce("n_records", F.lit(0)).alias("raw_records_count"),
    )


def score(companies: DataFrame, enrichments: DataFrame, validations: DataFrame) -> DataFrame:
    """One row for each company: six factors between 0 and 1 and their weighted total in per cent, exact in decimals."""
    rows = companies.join(enrichments.select("company_id", "industry", "company_size", "technologies", "email", "description", "social_links"), "company_id", "left").join(validations.select("company_id", "overall_status"), "company_id", "left")
    c = F.col
    factors = {
        "industry": A.industry_score(c("industry")), "size": A.size_score(c("company_size")), "location": A.location_score(c("city"), c("latitude"), c("longitude"), c("address")), "technology": A.technology_score(c("technologies")),
        "data_quality": A.quality_score(c("phone"), c("website"), c("email"), c("address"), c("description"), c("social_links"), c("rating"), c("review_count")), "validation": A.validation_score(c("overall_status")),
    }
    out = rows.select("company_id", *[v.alias(f"{k}_score") for k, v in factors.items()])
    return out.select("*", A.total_score({k: c(f"{k}_score") for k in factors}).alias("total_score"), F.lit(C.SCORE_VERSION).alias("score_version"))


def run_all(raw: DataFrame, pages: DataFrame | None = None, domains: DataFrame | None = None, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """All stages on raw records: tables cleaned, clusters, companies, record_company, validations, enrichments and scores."""
    assigned, found = resolve(clean(raw))
    found = found.checkpoint()
    companies, links = R.upsert_companies(found, existing)
    companies = companies.checkpoint()
    record_company = link_back(assigned, links)
    facts = record_facts(raw, record_company).checkpoint()
    validations, enrichments = validate(companies, facts, domains), enrich(companies, facts, pages)
    return {"cleaned": assigned, "clusters": found, "companies": companies, "record_company": record_company, "facts": facts, "validations": validations, "enrichments": enrichments, "scores": score(companies, enrichments, validations)}


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
