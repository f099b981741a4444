"""The pipeline as it is registered, from its tables to packed sequences: on the small tables, and on an empty one."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_run_on_whole_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = corpus_pipeline.run(spark, SF)
    rows = found.collect()
    assert found.columns[:2] == ["doc_id", "piece"] and 0 < len({r.doc_id for r in rows}) < docs.count()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():  # gapless, within 1024 tokens
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = corpus_pipeline.run(spark, str(tmp_path))
    assert empty.columns == found.columns and empty.count() == 0
