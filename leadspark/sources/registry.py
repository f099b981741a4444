"""Sources by name: which there are, how their files are read, and one search over several of them."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import listing_key, payload_completeness
from ..operators.components import ensure_checkpoint_dir
from ..operators.relevance import fits_category, fits_location
from ..operators.resolve import first_seen
from .listings import RawRecordSource
from .payload import NORMALISERS, RAW_RECORD

FREE = set(C.SELECTABLE_SOURCES)


def check_sources(names: list[str]) -> list[str]:
    """The names without repeats, in order; an error if there are none or one cannot be selected."""
    unknown = [n for n in names if n not in C.SELECTABLE_SOURCES]
    if not names or unknown:
        raise ValueError(f"unknown sources: {unknown}" if unknown else "no source is given")
    return list(dict.fromkeys(names))


def listed(spark: SparkSession) -> DataFrame:
    """(name, selectable) of every source."""
    return spark.createDataFrame([(n, n in FREE) for n in NORMALISERS], "name string, selectable boolean")


def register(name: str, normaliser: Callable[[DataFrame], DataFrame], needs_key: bool = False) -> None:
    """Add a source: how its native listings become (source_record_id, raw_data)."""
    if name in NORMALISERS:
        raise ValueError(f"there is a source of this name: {name}")
    NORMALISERS[name] = normaliser
    if not needs_key:
        FREE.add(name)


def active_keys(keys: DataFrame, source: str) -> DataFrame:
    """The organizations that hold an active key of the source, each once, from keys(organization_id, source_adapter, status)."""
    return keys.where((F.col("source_adapter") == source) & (F.col("status") == "active")).select("organization_id").distinct()


def has_active_key(keys: DataFrame, organization_id: str, source: str) -> bool:
    """Whether keys(organization_id, source_adapter, status) holds an active key of the source."""
    return active_keys(keys.where(F.col("organization_id") == organization_id), source).limit(1).count() > 0


def open_source(name: str, keys: DataFrame | None = None, organization_id: str | None = None):
    """The normaliser of a source; an error for unknown ones and for those that lack an active key."""
    if name not in NORMALISERS:
        raise ValueError(f"unknown source: {name}")
    if name not in FREE and (keys is None or not has_active_key(keys, organization_id or "", name)):
        raise ValueError(f"no active key for source: {name}")
    return NORMALISERS[name]


def first_non_empty(frames: list[DataFrame]) -> DataFrame:
    """The first frame with a row, or the last one: a fallback source is read only when the earlier ones are empty."""
    for f in frames[:-1]:
        if f.limit(1).count():
            return f
    return frames[-1]


def listings(df: DataFrame, order: str = "seq") -> DataFrame:
    """A source's listings without repeats: the first of each phone, or of each name without a phone."""
    return first_seen(df, listing_key(F.col("name"), F.col("phone")), order)


def places_page(df: DataFrame, order: str = "seq") -> DataFrame:
    """The fields that are asked of the places API, of as many places as one answer has."""
    return df.orderBy(order).select(*[c for c in C.PLACE_FIELDS if c in df.columns]).limit(C.PLACES_PER_PAGE)


def named_listings(df: DataFrame, least: int = 3, order: str = "seq") -> DataFrame:
    """The first of each name in letters and digits, of those of at least so many."""
    key = F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z0-9]", "")
    return first_seen(df, F.when(F.length(key) >= least, key), order)


def in_city(df: DataFrame, city: str, address: str = "address") -> DataFrame:
    return df.where(F.contains(F.lower(F.coalesce(address, F.lit(""))), F.lit(city.lower()))) if city else df


def readable_page(html: Column) -> Column:
    """Whether a page is no block page of a directory."""
    return ~F.contains(F.lower(html), F.lit("unusual traffic")) & (F.length(html) >= 500)


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancel the jobs that start inside once so many seconds are over."""
    tag = f"limit-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobsWithTag, [tag]) if seconds is not None else None
    spark.sparkContext.addJobTag(tag)
    try:
        if timer:
            timer.start()
        yield
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def _listings_of(name: str, native: DataFrame, seconds: float | None) -> DataFrame:
    """A source's first listings, read at once."""
    if "seq" in native.columns:
        part = NORMALISERS[name](native.orderBy("seq").limit(C.LISTINGS_PER_SOURCE))
    else:
        part = NORMALISERS[name](native).orderBy("source_record_id").limit(C.LISTINGS_PER_SOURCE)
    with time_limit(native.sparkSession, seconds):
        return part.checkpoint().withColumn("source_adapter", F.lit(name))


def read_together(found: dict[str, DataFrame], seconds: float | None = None, overall: float | None = None) -> dict[str, DataFrame | Exception]:
    """The first listings of each source, or what kept it from being read; all are read at the same time.

    Each source is read by a thread of its own, whose jobs go to a pool of its name (which share alike under spark.scheduler.mode=FAIR) and are cancelled
    after `seconds`.  After `overall` seconds the jobs of all that are not done are cancelled; what they have
    read is dropped.
    """
    spark = next(iter(found.values())).sparkSession
    ensure_checkpoint_dir(spark)
    context, tag, done = spark.sparkContext, f"search-{uuid.uuid4().hex}", {}

    def read(name: str, native: DataFrame) -> None:
        context.setLocalProperty("spark.scheduler.pool", name)
        context.addJobTag(tag)
        try:
            done[name] = _listings_of(name, native, seconds)
        except Exception as e:  # noqa: BLE001  one source's trouble is not the search's
            done[name] = e

    threads = {name: InheritableThread(target=read, args=(name, native), daemon=True) for name, native in found.items()}
    end = None if overall is None else time.monotonic() + overall
    for t in threads.values():
        t.start()
    for t in threads.values():
        t.join(None if end is None else max(0.0, end - time.monotonic()))
    out = {name: done.get(name, TimeoutError(f"cut off after {overall} seconds")) for name in found}
    for t in threads.values():  # a thread may still be planning and start its job only now
        while t.is_alive():
            context.cancelJobsWithTag(tag)
            t.join(0.2)
    return out


def extract(found: dict[str, DataFrame], organization_id: str, run_id: str, category: str, city: str | None, state: str | None, at: Column | None = None, errors: list[str] | None = None, seconds: float | None = None, overall: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw records to append, listings of each source before the filters) of one search.

    `found` has the native listings of each source; all are read at the same time.  A source that cannot be planned or read, takes
    more than `seconds`, or is not done when the search has taken `overall` seconds, adds to `errors`, and the others go on.  Ids hash run, source, source id and
    payload, so that a repeated task or run gives the same.  Listings of each source end at the fixed limit, those that
    came first by their column seq, or else those of least source id; as they are so few, each source's are read at once.
    """
    if not found:
        raise ValueError("no source could be read")
    parts = []
    for name, part in read_together(found, seconds, overall).items():
        if isinstance(part, Exception):
            if errors is None:
                raise part
            errors.append(f"{name}: {part}")
        else:
            parts.append(part)
    if not parts:
        raise ValueError("no source could be read")
    every = reduce(DataFrame.unionByName, parts)
    r = {c: F.col(f"raw_data.{c}") for c in ("name", "phone", "address", "city", "state", "latitude", "longitude", "source_url", "maps_url", "industry")}
    r["metadata"] = F.to_json("raw_data.metadata")
    keep = fits_location(r, city, state) & fits_category(r["name"], r["industry"], r["address"], r["city"], category)
    fields = ["name", "phone", "address", "website", "email", "industry", "rating", "reviews_count", "latitude", "longitude", "maps_url", "opening_hours", "city", "state", "pin_code"]
    text = {"rating", "reviews_count", "latitude", "longitude"}
    present = [F.col(f"raw_data.{f}").isNotNull() if f in text else F.coalesce(F.col(f"raw_data.{f}") != "", F.lit(False)) for f in fields]
    meta = F.col("raw_data.metadata")
    stamped = meta.withField("contributing_sources", F.array(F.col("source_adapter"))).withField("completeness_score", payload_completeness(present)).withField("extraction_method", F.coalesce(meta["extraction_method"], F.col("source_adapter")))
    kept = every.where(keep).withColumn("raw_data", F.col("raw_data").withField("metadata", stamped))
    rows = kept.select(
        F.md5(F.concat_ws("|", F.lit(run_id), "source_adapter", "source_record_id", F.to_json("raw_data"))).alias("id"), F.lit(organization_id).alias("organization_id"), F.lit(run_id).alias("pipeline_run_id"),
        "source_adapter", "source_record_id", F.lit("extracted").alias("status"), (at if at is not None else F.current_timestamp()).alias("retrieved_at"), F.lit(None).cast("string").alias("company_id"), "raw_data",
    )
    return rows, every.groupBy("source_adapter").agg(F.count("*").alias("n_listings"))


def run_status(stored: int, errors: list[str]) -> str:
    return "failed" if errors and not stored else "completed"


def read_listings(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The listings of RawRecordSource from any path that Spark reads, split and pushed down by its own reader."""
    schema = RawRecordSource({}).schema()
    return spark.read.schema(schema).json(path).withColumn("source_adapter", F.lit(source))


def read_raw_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_RECORD).parquet(path)
