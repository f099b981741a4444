"""Progress of streams that outlives their driver: a listener adds a small file for each batch, and a table reads them.

The folder of a stream is its id, which its checkpoint keeps, so batches from before and after a restart lie together; a batch that
runs again after a failure replaces its file.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ROW = "query string, run string, batch_id long, started string, seconds double, n_rows long"


class Recorder(StreamingQueryListener):
    """Writes the progress of every batch with rows, of all streams of the session, under `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark.sparkContext._jvm, path
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            row = {"query": str(p.id), "run": str(p.runId), "batch_id": p.batchId, "started": p.timestamp, "seconds": p.batchDuration / 1000, "n_rows": p.numInputRows}
            out = self._fs.create(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p.id}/{p.batchId:020d}.json"), True)
            out.write(bytearray(json.dumps(row).encode()))
            out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def record(spark: SparkSession, path: str) -> Recorder:
    """Start to record; spark.streams.removeListener() of the result stops it."""
    recorder = Recorder(spark, path)
    spark.streams.addListener(recorder)
    return recorder


def stop(spark: SparkSession, recorder: Recorder) -> None:
    """Stop to record once all that has happened so far is written."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(recorder)


def progress(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    """(query, run, batch_id, started, seconds, n_rows) of all recorded batches, or of one stream's."""
    rows = spark.read.schema(ROW).option("recursiveFileLookup", "true").json(path)
    return rows if query is None else rows.where(F.col("query") == query)
