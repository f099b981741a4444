"""Lead payloads derived from the supplied star-schema tables by key arithmetic.

The expressions are SQL that Spark and DuckDB read alike, so that queries and the SQL
that states their results start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from ..sources.payload import payload

ORGANIZATION, RUN = "org-1", "00000000-0000-4000-8000-000000000001"

#: (source, table, key column, number used in the arithmetic)
PARTS = [("openstreetmap", "customer", "c_custkey", 0), ("google_search", "supplier", "s_suppkey", 1), ("web_search", "part", "p_partkey", 2)]


def div(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {n}) AS BIGINT)"


def pick(index: str, values: list[str | None]) -> str:
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


_NAME = (
    f"concat({pick('k % 6', ['Ra', 'Ki', 'Mo', 'Su', 'Te', 'Va'])}, {pick(div('k', 6) + ' % 4', ['na', 'lu', 'shi', 'ram'])}, {pick(div('k', 24) + ' % 3', ['', 'ni', 'vel'])}, ' ', "
    f"{pick('(k * 7 + s) % 11', ['Life', 'Star', 'Apollo', 'Green', 'Royal', 'City', 'Prime', 'Sunrise', 'Om', 'Global', 'Lotus'])}, ' ', "
    f"{pick(div('k', 11) + ' % 13', ['Hospital', 'Clinic', 'Bakery', 'Restaurant', 'Coffee House', 'Software Solutions', 'Hotel', 'School', 'Traders', 'Eye Care', 'Pharmacy', 'Travels', 'Store'])}, "
    f"{pick('k % 10', [' Pvt Ltd', ' | Best in town', ', Eluru', ' - Eluru', '', '', '', '', '  ', ''])})"
)
_CITY = pick(div("k", 3) + " % 6", ["Eluru", "bangalore", "Hyderabad", "bombay", "London", None])
_DIGITS = "CAST(9000000000 + (k * 13 + s * 5) % 20000 AS STRING)"

#: Payload fields over a key k and a source number s.
FIELDS = {
    "name": f"CASE WHEN k % 97 = 96 THEN NULL ELSE {_NAME} END",
    "phone": f"CASE WHEN k % 11 = 0 THEN NULL WHEN k % 17 = 3 THEN '12345' WHEN k % 19 = 5 THEN concat('+44 20 7930 ', CAST(1000 + k % 9000 AS STRING)) WHEN k % 3 = 0 THEN concat('0', {_DIGITS}) WHEN k % 3 = 1 THEN concat('+91 ', {_DIGITS}) ELSE {_DIGITS} END",
    "address": f"CASE WHEN k % 9 = 4 THEN NULL ELSE concat(CAST(k % 90 AS STRING), ' MG Rd,  ', coalesce({_CITY}, 'Old Town'), {pick('k % 3', [', Karnataka', ', Goa 560001', ''])}) END",
    "city": _CITY,
    "state": pick("k % 6", ["AP", "karnataka", "Telangana", "mh", None, "north goa"]),
    "website": "CASE k % 5 WHEN 0 THEN concat('http://www.site', CAST(k % 300 AS STRING), '.com/?utm_source=x') WHEN 1 THEN concat('Site', CAST(k % 300 AS STRING), '.in/a?ref=b&c=1') WHEN 2 THEN NULL WHEN 3 THEN 'https://www.facebook.com/' ELSE concat('https://www.bing.com/ck?u=', CAST(k AS STRING)) END",
    "email": "CASE k % 6 WHEN 0 THEN concat('Info@site', CAST(k % 300 AS STRING), '.com') WHEN 1 THEN 'broken@' WHEN 2 THEN 'a@mailinator.com' END",
    "industry": pick("k % 4", ["hospitals", "Retail", None, "food"]),
    "latitude": "CASE WHEN k % 5 = 0 THEN NULL ELSE 10 + (k % 211) * 0.013 END",
    "longitude": "CASE WHEN k % 5 = 0 THEN NULL ELSE 70 + (k % 197) * 0.011 END",
    "rating": "CASE WHEN k % 7 = 0 THEN NULL ELSE 1 + (k % 9) * 0.5 END",
    "reviews_count": "CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(k % 120 AS INTEGER) END",
    "maps_url": "CASE WHEN k % 4 = 1 THEN concat('https://maps.example/', CAST(k AS STRING)) END",
}

def record_fields(source: str) -> dict[str, str]:
    return {
        "id": f"concat('{source}-', lpad(CAST(k AS STRING), 12, '0'))",
        "source_adapter": f"'{source}'",
        "source_record_id": f"CASE WHEN k % 50 = 0 THEN concat('shared-', CAST({div('k', 100)} AS STRING)) ELSE concat('{source}_', CAST(k AS STRING)) END",
        "minutes": "k % 10000",
    }


def raw_sql() -> str:
    """The flat rows as SQL over the supplied tables."""
    one = lambda source, table, key, s: f"SELECT {', '.join(f'{e} AS {c}' for c, e in (record_fields(source) | FIELDS).items())}, k FROM (SELECT {key} AS k, {s} AS s FROM {table}) AS keys_{s}"
    return " UNION ALL ".join(one(*p) for p in PARTS).replace("AS STRING)", "AS VARCHAR)")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as raw records."""
    configure(spark)
    parts = None
    for source, table, key, s in PARTS:
        keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("k"), F.lit(s).alias("s"))
        flat = keys.selectExpr(*[f"{e} AS {c}" for c, e in (record_fields(source) | FIELDS).items()])
        meta = {"m_contributing_sources": F.array(F.col("source_adapter"))}
        rows = flat.select(
            "id", F.lit(ORGANIZATION).alias("organization_id"), F.lit(RUN).alias("pipeline_run_id"), "source_adapter", "source_record_id", F.lit("extracted").alias("status"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("minutes") * 60).alias("retrieved_at"), F.lit(None).cast("string").alias("company_id"), payload(**{c: F.col(c) for c in FIELDS}, **meta).alias("raw_data"),
        )
        parts = rows if parts is None else parts.unionByName(rows)
    return parts
