"""Companies kept in Spark's state store while raw records stream in.

Records are cleaned and grouped by their company's name.  A company's state is its row: the earliest record of the first batch gives
the name, every other field takes the first value that is there, and records are counted.  Known companies enter as
initial state.  The state lives in RocksDB under the stream's checkpoint, so a restarted
stream goes on where it stopped; each batch puts out the companies that it touched, as they are now.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.resolve import company_key, company_name
from ..plans.stages import clean
from ..sources.payload import RAW_RECORD

TEXTS, NUMBERS = ["phone", "website", "address", "city", "state"], ["latitude", "longitude", "rating"]
FIELDS = TEXTS + NUMBERS
STATE = ", ".join(["name string", *(f"{f} string" for f in TEXTS), *(f"{f} double" for f in NUMBERS), "n_records long"])
ROW = f"company_id string, {STATE}"
_TURN = ["retrieved_at", "record_id"]


class Company(StatefulProcessor):
    """The state of one company; a batch's records come in parts of any number and order."""

    def init(self, handle) -> None:
        self._row = handle.getValueState("company", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self._row.update((r["name"], *(None if pd.isna(r[f]) else r[f] for f in FIELDS), int(r["n_records"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._row.get() if self._row.exists() else (None,) * (len(FIELDS) + 1) + (0,)
        first: dict[str, tuple] = {}
        n = 0
        for part in rows:
            n += len(part)
            for f in ["name", *FIELDS]:
                there = part[f].notna() & (part[f] != (0 if f in NUMBERS else "")) if f != "name" else part[f].notna()
                if there.any():
                    r = part.loc[there, [*_TURN, f]].sort_values(_TURN, na_position="first").iloc[0]
                    found = ((not pd.isna(r[_TURN[0]]), r[_TURN[0]] if not pd.isna(r[_TURN[0]]) else None, r[_TURN[1]]), r[f])
                    if f not in first or found[0] < first[f][0]:
                        first[f] = found
        made = [old if old is not None else first[f][1] if f in first else None for f, old in zip(["name", *FIELDS], known, strict=False)]
        made = [None if v is None else float(v) if f in NUMBERS else str(v) for f, v in zip(["name", *FIELDS], made, strict=True)]
        row = (*made, int(known[-1]) + n)
        self._row.update(row)
        out = pd.DataFrame([(key[0], *row)], columns=["company_id", "name", *FIELDS, "n_records"])
        yield out.astype({f: "float64" for f in NUMBERS})

    def close(self) -> None:
        pass


def follow(raw: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """A stream of company rows (company_id, name, fields, n_records) from a stream of raw records; companies(company_id, name, fields, n_records) are known before."""
    rows = clean(raw).select(company_name(F.col("name")).alias("name"), *TEXTS, *[F.col(f).cast("double").alias(f) for f in NUMBERS], F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("retrieved_at"), F.coalesce("record_id", F.lit("")).alias("record_id"))
    keyed = rows.withColumn("company_id", company_key()).groupBy("company_id")
    before = None if companies is None else companies.select("company_id", "name", *TEXTS, *[F.col(f).cast("double").alias(f) for f in NUMBERS], F.col("n_records").cast("long").alias("n_records")).groupBy("company_id")
    return keyed.transformWithStateInPandas(Company(), ROW, "Update", "None", initialState=before)


def start(spark: SparkSession, raw_path: str, out_path: str, checkpoint: str, companies: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Follow the raw-record files at raw_path and write each batch's companies under out_path; the same call goes on after a stop.

    A batch that is run again writes the same folder.
    """
    stream = follow(spark.readStream.schema(RAW_RECORD).parquet(raw_path), companies)
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out_path}/batch={i}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def current(spark: SparkSession, out_path: str) -> DataFrame:
    """Each company as the last batch that touched it left it."""
    rows = spark.read.schema(f"{ROW}, batch long").parquet(out_path)
    last = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("batch")))
    return rows.withColumn("turn", last).where("turn = 1").drop("turn", "batch")
