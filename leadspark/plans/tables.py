"""Small tables of every kind, derived from the supplied ones by key arithmetic, for queries that read or write stored tables.

Each is a list of expressions that Spark and DuckDB read alike.  They hold several
organizations and runs, names beyond ASCII, blanks beside nulls, and companies without rows in the other tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .derived import pick


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def uuid(x: str) -> str:
    return f"concat('00000000-0000-4000-8000-', lpad({text(x)}, 12, '0'))"


_ID = f"md5({text('k')})"
_STATUS = lambda index, values: pick(index, values)
_SITE = f"concat('https://www.site', {text('k % 300')}, '.com')"

#: name -> (supplied table, its key, condition on the key k, expressions)
TABLES: dict[str, tuple[str, str, str, dict[str, str]]] = {
    "companies": ("customer", "c_custkey", "true", {
        "company_id": _ID, "name": f"concat({pick('k % 5', ['Café Ümlaut', 'Star Hospital', 'Om Bakery', 'Green School', 'Lotus Hotel'])}, ' ', {text('k')})",
        "phone": f"CASE WHEN k % 4 = 0 THEN NULL ELSE concat('+91', {text('9000000000 + k')}) END", "website": f"CASE WHEN k % 3 = 0 THEN {_SITE} END",
        "address": f"CASE WHEN k % 6 <> 1 THEN concat({text('k')}, ' MG Road') END", "city": pick("k % 4", ["Goa", "", None, "Pune"]), "state": pick("k % 3", ["Goa", None, ""]), "country": "'India'",
        "latitude": "CASE WHEN k % 5 <> 0 THEN CAST(10 + (k % 50) * 0.1 AS DOUBLE) END", "longitude": "CASE WHEN k % 10 <> 1 THEN CAST(70 + (k % 40) * 0.1 AS DOUBLE) END",
        "rating": "CASE WHEN k % 7 <> 0 THEN CAST((k % 10) * 0.5 AS DOUBLE) END", "review_count": "CASE WHEN k % 8 <> 0 THEN CAST(k % 30 AS INTEGER) END", "k": "k",
    }),
    "enrichments": ("customer", "c_custkey", "k % 5 <> 2", {
        "company_id": _ID, "industry": pick("k % 4", ["Healthcare", None, "Food & Beverage", ""]), "industry_source": pick("k % 3", ["website:https://x.in", "inferred_from_name:Star", None]),
        "email": f"CASE WHEN k % 4 = 1 THEN concat('a', {text('k')}, '@x.in') END", "email_source": "CASE WHEN k % 8 = 1 THEN 'raw_data_metadata' WHEN k % 4 = 1 THEN 'website:https://x.in' END",
        "description": f"CASE WHEN k % 3 = 1 THEN concat('About ', {text('k')}) END", "description_source": "CASE WHEN k % 3 = 1 THEN 'website:https://x.in' END", "founded_year": "CASE WHEN k % 6 = 2 THEN '1999' END",
        "company_size": "CASE WHEN k % 10 = 3 THEN '50 employees' END", "facebook": f"CASE WHEN k % 9 = 0 THEN concat('https://facebook.com/', {text('k')}) END", "social_links_source": "CASE WHEN k % 18 = 0 THEN 'raw_data_metadata' END",
        "more_phone": f"CASE WHEN k % 11 = 0 THEN {text('9100000000 + k')} END",
    }),
    "validations": ("customer", "c_custkey", "k % 7 <> 3", {
        "company_id": _ID, "email_status": pick("k % 4", ["VALID", "INVALID", "UNKNOWN", "NOT_AVAILABLE"]), "phone_status": pick("k % 3", ["VALID", "INVALID", "NOT_AVAILABLE"]), "website_status": pick("k % 5", ["VALID", "INVALID", "UNKNOWN", "NOT_AVAILABLE", "VALID"]),
        "business_existence_status": pick("k % 6", ["VALID", "INVALID", "UNKNOWN", "VALID", "VALID", "UNKNOWN"]), "overall_status": pick("k % 8", ["VALID", "INVALID", "UNKNOWN", "VALID", "VALID", "UNKNOWN", "INVALID", "VALID"]),
    }),
    "scores": ("customer", "c_custkey", "k % 6 <> 4", {
        "company_id": _ID, **{f"{f}_score": f"CAST((k % {n}) * {step} AS DECIMAL(3,2))" for f, n, step in (("industry", 3, 0.5), ("size", 2, 0.5), ("location", 5, 0.25), ("technology", 2, 0.5), ("data_quality", 9, 0.12), ("validation", 3, 0.5))},
        "total_score": "CAST((k * 37) % 10001 / 100.0 AS DECIMAL(5,2))", "score_version": "'1.0'",
    }),
    "raw": ("part", "p_partkey", "true", {
        "id": f"concat('r', lpad({text('k')}, 9, '0'))", "organization_id": pick("k % 3", ["org-1", "org-2", "org-3"]), "pipeline_run_id": uuid("k % 4"), "source_adapter": pick("k % 5", ["openstreetmap", "google_search", "web_search", "justdial", "openstreetmap"]),
        "minutes": "k % 1000", "company_id": f"CASE WHEN k % 10 <> 0 THEN md5({text('k % 120 + 1')}) END",
    }),
    "runs": ("nation", "n_nationkey", "true", {"id": uuid("k"), "status": pick("k % 4", ["completed", "failed", "completed", "running"]), "minutes": "(k * 7) % 25", "used": "k % 3"}),
    "saved": ("customer", "c_custkey", "k % 13 = 0", {"company_id": _ID, "pipeline_run_id": uuid("k % 4"), "raw_record_id": f"concat('r', lpad({text('k')}, 9, '0'))"}),
}


def sql(name: str) -> str:
    """The table as a common table expression for DuckDB."""
    source, key, where, columns = TABLES[name]
    listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"t_{name} AS MATERIALIZED (SELECT {listed} FROM (SELECT CAST({key} AS BIGINT) AS k FROM {source}) WHERE {where})".replace("AS STRING)", "AS VARCHAR)")


def with_(*names: str) -> str:
    return "WITH " + ", ".join(map(sql, names))


def at(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    source, key, where, columns = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").select(F.col(key).cast("long").alias("k")).where(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    if name == "enrichments":
        links = F.when(F.col("facebook").isNotNull(), F.create_map(F.lit("facebook"), F.col("facebook")))
        rows = rows.withColumn("social_links", links).withColumn("additional_phones", F.when(F.col("more_phone").isNotNull(), F.array("more_phone"))).withColumn("technologies", F.lit(None).cast("array<string>"))
    if name == "raw":
        rows = rows.withColumn("retrieved_at", at(F.col("minutes")))
    if name == "runs":
        used = F.when(F.col("used") == 0, F.array(F.lit("openstreetmap"), F.lit("web_search"))).when(F.col("used") == 1, F.array(F.lit("justdial"))).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn("created_at", at(F.col("minutes"))).withColumn("sources_used", used)
    return rows
