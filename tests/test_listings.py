"""The library's own data source, and several sources read at the same time."""

import json
import time

import pytest
from pyspark.sql import functions as F

from leadspark.sources import listings, registry


def test_splits_give_each_line_once(tmp_path):
    texts = [b"", b"x" * 50, b'{"a": 1}', b"", "é".encode() * 9, b"end"]
    for last in (b"", b"\n"):
        data = b"\n".join(texts) + last
        (tmp_path / "f.jsonl").write_bytes(data)
        for size in (1, 2, 7, 60, 1000):
            for block in (1, 3, 1000):
                found = [x for at in range(0, len(data), size) for x in listings.lines(str(tmp_path), listings.Split(str(tmp_path / "f.jsonl"), at, min(len(data), at + size)), block)]
                assert found == texts


def test_a_large_file_is_read_in_splits_and_filters_are_taken(spark, tmp_path):
    listings.register(spark)
    rows = [{"name": f"n{i}", "rating": i % 5 + 0.5, "reviews_count": i} if i % 7 else {"name": f"n{i}"} for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "_passing.jsonl").write_text('{"name": "no"}')
    df = spark.read.format("lead_listings").option("source", "x").option("split_bytes", 5000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 20 and df.count() == 3000
    some = df.where("rating >= 3.5 and name like 'n1%' and source_adapter = 'x'").select("name")
    assert {r.name for r in some.collect()} == {r["name"] for r in rows if r.get("rating", 0) >= 3.5 and r["name"].startswith("n1")}
    assert "Filter" not in some._jdf.queryExecution().optimizedPlan().toString().replace("PushedFilters", "")
    assert df.where("source_adapter = 'y'").count() == 0
    assert df.where("reviews_count is null").count() == len([r for r in rows if "rating" not in r])


def test_a_writer_shows_all_or_nothing(spark, tmp_path):
    listings.register(spark)
    path = str(tmp_path / "out")
    rows = spark.range(100).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("rating")).repartition(3)
    rows.write.format("lead_listings").mode("append").save(path)
    read = lambda: spark.read.format("lead_listings").load(path)
    assert read().count() == 100 and read().where("rating is null").count() == 50
    broken = rows.withColumn("name", F.when(F.col("rating") == 98, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("lead_listings").mode("append").save(path)
    assert read().count() == 100
    rows.limit(5).write.format("lead_listings").mode("overwrite").save(path)
    assert read().count() == 5


def slow_rows(spark, name, seconds):
    def wait(batches):
        time.sleep(seconds)
        yield from batches

    rows = spark.createDataFrame([(f"{name} {i}", "x, Goa", "98", f"https://m/{name}{i}") for i in range(3)], "name string, address string, phone string, maps_url string").coalesce(1)
    return rows.mapInPandas(wait, rows.schema)


def test_sources_are_read_at_the_same_time_and_slow_ones_cut_off(spark):
    slow_rows(spark, "warm", 0).count()
    start = time.monotonic()
    names = ("google_search", "justdial", "web_search")
    errors = []
    _, counts = registry.extract({n: slow_rows(spark, n, 6) for n in names}, "o", "r", "", None, None, errors=errors)
    assert {r.source_adapter: r.n_listings for r in counts.collect()} == dict.fromkeys(names, 3) and not errors
    assert time.monotonic() - start < 16  # one after another they take 18
    start = time.monotonic()
    _, counts = registry.extract({n: slow_rows(spark, n, 100 if n == "justdial" else 0) for n in names}, "o", "r", "", None, None, errors=errors, overall=12)
    assert {r.source_adapter for r in counts.collect()} == {"google_search", "web_search"} and len(errors) == 1 and errors[0].startswith("justdial: cut off")
    assert time.monotonic() - start < 60
    with pytest.raises(Exception, match="(?i)cancel|cut off"):
        registry.extract({"justdial": slow_rows(spark, "justdial", 100)}, "o", "r", "", None, None, seconds=3)
