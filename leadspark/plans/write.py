"""Sinks: tables by organization, and CSV exports."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..sources.snapshots import Snapshots


def append_raw(records: DataFrame, path: str) -> None:
    """Raw records are only ever added, in a folder for each organization."""
    records.write.mode("append").partitionBy("organization_id").parquet(path)


def replace_tenant(table: DataFrame, organization_id: str, path: str) -> int:
    """One organization's rows replace its former ones in one step, other organizations' files stay; the new version.

    The table is kept as snapshots, a part an organization: a reader, or a failure at any point, sees the old rows or the new
    ones, never both or neither.  Without rows the organization is gone.
    """
    org = F.lit(organization_id)
    rows = table.drop("organization_id").withColumn("organization_id", org)
    return Snapshots(table.sparkSession, path).update([organization_id], lambda _: rows, org)


def tenants(spark: SparkSession, path: str, organization_id: str | None = None, version: int | None = None) -> DataFrame | None:
    """The rows that replace_tenant() has stored, of all organizations or by reading one's files alone; None before the first."""
    return Snapshots(spark, path).read(version, None if organization_id is None else [organization_id])


def store_cleaned(cleaned: DataFrame, path: str) -> None:
    """The cleaned fields of records beside the raw ones, marked as cleaned, without working columns; a run's rows replace its former ones."""
    rows = cleaned.select(*[c for c in cleaned.columns if not c.startswith("_")]).withColumn("status", F.lit("cleaned"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("organization_id", "pipeline_run_id").parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: null as empty, maps and arrays as JSON."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    one = lambda c: F.to_json(c) if kinds[c] in ("map", "array", "struct") else F.col(c).cast("string")
    return df.select(*[F.coalesce(one(c), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with quotes only where needed, doubled inside; `single` gathers a small export in one file, in order."""
    out = as_text(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")


def export_leads(rows: DataFrame, path: str, applied: dict, at: datetime | None = None, single: bool = False) -> dict:
    """Write export rows as CSV and return the export's record; the count comes from the same pass."""
    seen = Observation("export")
    write_csv(rows.select(*C.LEAD_CSV_COLUMNS).observe(seen, F.count("*").alias("n")), path, single)
    return {"export_time": (at or datetime.now(UTC)).isoformat(), "format": "csv", "record_count": seen.get["n"], "applied_filters": applied, "columns": C.LEAD_CSV_COLUMNS}


def raw_export(raw: DataFrame) -> DataFrame:
    """The 17 columns of the raw export, latest first, 10 000 rows at most."""
    get = lambda f: F.col(f"raw_data.{f}")
    values = [get(f) for f in ("name", "address", "city", "state", "country", "phone", "phone_intl", "website", "rating", "review_count", "business_status", "latitude", "longitude", "google_maps_url")]
    values += [F.col("source_record_id"), F.col("source_adapter"), F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss")]
    top = raw.orderBy(F.col("retrieved_at").desc(), "id").limit(C.RAW_CSV_ROWS)
    return top.select(*[v.alias(n) for v, n in zip(values, C.RAW_CSV_COLUMNS, strict=True)])


def export_raw(raw: DataFrame, path: str) -> int:
    """Write the raw export and return its rows; an error if there are none."""
    rows = raw_export(raw)
    seen = Observation("raw_export")
    if raw.limit(1).count() == 0:
        raise LookupError("no records to export")
    write_csv(rows.observe(seen, F.count("*").alias("n")), path, single=True)
    return seen.get["n"]
