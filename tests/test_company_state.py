"""Companies in the state store: restarts, initial state, and the result of one run over all."""

from pyspark.sql import functions as F

from leadspark.sources.payload import payload
from leadspark.streaming import company_state as S


def raw(spark, rows):
    """rows (id, minute, name, phone, city, latitude)"""
    df = spark.createDataFrame(rows, "id string, m int, name string, phone string, city string, latitude double")
    return df.select(
        "id", F.lit("o").alias("organization_id"), F.lit("r").alias("pipeline_run_id"), F.lit("web_search").alias("source_adapter"), F.col("id").alias("source_record_id"), F.lit("extracted").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("m")).alias("retrieved_at"), F.lit(None).cast("string").alias("company_id"), payload(name=F.col("name"), phone=F.col("phone"), city=F.col("city"), latitude=F.col("latitude")).alias("raw_data"),
    )


BATCHES = [
    [("b", 2, "Star Café", None, "goa", 0.0), ("a", 1, "STAR CAFÉ", "9811111111", "", None), ("c", 1, "Om", None, None, 2.5)],
    [("d", 0, "star café", "9822222222", "Delhi", 1.5), ("e", 0, None, None, None, None), ("f", 9, "New", "9833333333", None, None), ("g", 3, "New", "9844444444", None, None)],
    [("h", 5, "om", "9855555555", None, 3.5), ("i", 4, "Known", "9866666666", "Goa", None)],
]


def run(spark, folder, batches, known):
    paths = [f"{folder}/{x}" for x in ("in", "out", "state")]
    for rows in batches:
        raw(spark, rows).coalesce(1).write.mode("append").parquet(paths[0])
        q = S.start(spark, *paths, companies=known)
        q.awaitTermination()
        assert q.exception() is None
    return {r.name: (r.phone, r.city, r.latitude, r.n_records) for r in S.current(spark, paths[1]).collect()}


def test_a_restarted_stream_goes_on(spark, tmp_path):
    known = spark.createDataFrame([("Known", None, None)], "name string, phone string, city string").select(S.company_key().alias("company_id"), "name", *[F.lit(None).cast("string").alias(f) for f in S.TEXTS], *[F.lit(7.5 if f == "latitude" else None).cast("double").alias(f) for f in S.NUMBERS], F.lit(4).alias("n_records"))
    found = run(spark, str(tmp_path), BATCHES, known)
    assert found == {
        "Star Café": ("+919811111111", "Goa", 1.5, 3), "Om": ("+919855555555", None, 2.5, 2), "Unknown": (None, None, None, 1),
        "New": ("+919844444444", None, None, 2), "Known": ("+919866666666", "Goa", 7.5, 5),
    }
