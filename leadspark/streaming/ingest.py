"""Post-processing of new raw-record files as they arrive.

Each batch is cleaned and resolved like one search, and its companies are merged into the company table by name.  The table is
kept as snapshots whose parts are buckets of the company ids: a batch reads and writes the buckets that its companies fall
into, and all others keep their files.  Each version notes the batch that made it, so a batch that is run again after a
failure is not counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.components import ensure_checkpoint_dir
from ..operators.resolve import company_key, company_name, upsert_companies
from ..plans.stages import clean, link_back, resolve
from ..sources.payload import RAW_RECORD
from ..sources.snapshots import Snapshots, bucket

#: Buckets of a new company table; an existing one keeps its own number.  At 100 million companies a bucket holds 100 000.
BUCKETS = 1024


def merge_companies(found: DataFrame, path: str, batch_id: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Merge clusters into the company table at `path`, whose touched buckets alone are read and written; their links (root, company_id).

    With a batch_id, nothing is written if the table has that batch already.
    """
    table = Snapshots(found.sparkSession, path)
    note = table.manifest()["note"]
    buckets = note.get("buckets", buckets)
    found = found.checkpoint()
    new = found.select("root", company_name(F.col("best_name")).alias("name"), F.col("best_city").alias("city")).withColumn("company_id", company_key())
    touched = [r[0] for r in new.select(bucket(F.col("company_id"), buckets)).distinct().collect()]  # at most `buckets`
    if batch_id is None or note.get("batch", -1) < batch_id:
        more = {"buckets": buckets} | ({} if batch_id is None else {"batch": batch_id})
        table.update(touched, lambda old: upsert_companies(found, old)[0], bucket(F.col("company_id"), buckets), more)
    return new.select("root", "company_id")


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The company table, or as it was after the last batch before the given one; None if there is none."""
    table = Snapshots(spark, path)
    if before is None:
        return table.read()
    done = [v for v in table.versions() if table.manifest(v)["note"].get("batch", -1) < before]
    return table.read(done[-1]) if done else None


def process_batch(batch: DataFrame, batch_id: int, companies_path: str, links_path: str, buckets: int = BUCKETS) -> None:
    ensure_checkpoint_dir(batch.sparkSession)
    batch = batch.checkpoint()  # the stream's files are read once, though each stage looks at the records
    if batch.limit(1).count() == 0:
        return
    assigned, found = resolve(clean(batch))
    links = merge_companies(found, companies_path, batch_id, buckets)
    link_back(assigned, links).write.mode("overwrite").parquet(f"{links_path}/version={batch_id}")


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """(batch_id, started, seconds) of the query's batches that it still remembers, in order; streaming/progress.py keeps them beyond a restart."""
    seen = [(int(p["batchId"]), p["timestamp"], p["batchDuration"] / 1000) for p in query.recentProgress if p["numInputRows"]]
    return spark.createDataFrame(seen, "batch_id long, started string, seconds double")


def start(spark: SparkSession, raw_path: str, companies_path: str, links_path: str, checkpoint: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Follow the raw-record files at raw_path; with `once`, take what is there and stop."""
    stream = spark.readStream.schema(RAW_RECORD).parquet(raw_path)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: process_batch(b, i, companies_path, links_path, buckets))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
