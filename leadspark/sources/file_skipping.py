"""Containment search that reads only files that may hold the text.

For each file of a table and each text column searched, an index holds a Bloom filter of the column's trigrams, in lower case, as bitmaps of fixed
size.  A search for a text tests its trigrams against the filters, reads the files that pass, and filters their rows as ever, so a file that
passes by chance costs its reading and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a file's filter, in bitmaps of 4096 bytes.
BITS = 1 << 17
_BITMAP = 1 << 15


def _trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def _bit(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BITS))


def build(spark: SparkSession, path: str, columns: list[str], index_path: str) -> None:
    """Write the filters (file, column, bucket, bits) of the Parquet files under `path`; bits of a file are gathered where it is read."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns])).alias("t"))
    bits = rows.select("file", "t.column", F.explode(F.array_distinct(_trigrams(F.col("t.text")))).alias("trigram")).select("file", "column", _bit(F.col("trigram")).alias("bit"))
    made = bits.groupBy("file", "column", F.floor(F.col("bit") / _BITMAP).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(_BITMAP))).alias("bits"))
    made.write.mode("overwrite").parquet(index_path)


def files_with(spark: SparkSession, path: str, index_path: str, column: str, part: str) -> list[str] | None:
    """The files that may hold `part` in the column; None if it is too short to tell."""
    asked = spark.createDataFrame([(part,)], "part string").select(F.explode(F.array_distinct(_trigrams(F.col("part")))).alias("trigram"))
    bits = {r[0] for r in asked.select(_bit(F.col("trigram"))).collect()}  # a trigram a character of the search text
    if not bits:
        return None
    by_bucket: dict[int, list[int]] = {}
    for b in bits:
        by_bucket.setdefault(b // _BITMAP, []).append(b % _BITMAP)
    held = lambda at: F.getbit(F.conv(F.hex(F.substring(F.col("bits"), at // 8 + 1, 1)), 16, 10).cast("long"), F.lit(at % 8)) == 1
    tests = F.lit(False)
    for bucket, places in by_bucket.items():
        every = F.lit(True)
        for at in places:
            every &= held(at)
        tests |= (F.col("bucket") == bucket) & every
    index = spark.read.parquet(index_path).where((F.col("column") == column) & F.col("bucket").isin(list(by_bucket)))
    return [r.file for r in index.where(tests).groupBy("file").count().where(F.col("count") == len(by_bucket)).select("file").collect()]  # names of files alone


def containing(spark: SparkSession, path: str, index_path: str, column: str, part: str) -> DataFrame:
    """The rows whose column contains `part`, in any case; files without its trigrams are not read."""
    table = spark.read.parquet(path)
    files = files_with(spark, path, index_path, column, part)
    rows = table if files is None else spark.read.schema(table.schema).option("basePath", path).parquet(*files) if files else table.limit(0)
    return rows.where(F.contains(F.lower(F.col(column)), F.lower(F.lit(part))))
