"""Containment search against a scan of all files."""

import random

from leadspark.sources import file_skipping as S


def test_files_without_the_text_are_not_read(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f, "".join(rng.choice("abcdefghÉ ") for _ in range(rng.randrange(0, 9))) + (f" needle{f}" if f < 3 else "")) for f in range(12) for _ in range(30)] + [(11, None)]
    path, index = str(tmp_path / "t"), str(tmp_path / "i")
    spark.createDataFrame(rows, "f int, name string").coalesce(1).write.partitionBy("f").parquet(path)
    S.build(spark, path, ["name"], index)
    for part in ("needle1", "NEEDLE2", "edl", "ab", "abc", "bÉ a", "x%_y", "nothing here", ""):
        found = S.containing(spark, path, index, "name", part)
        assert sorted(tuple(r) for r in found.select("f", "name").collect()) == sorted(r for r in rows if r[1] is not None and part.lower() in r[1].lower())
    assert len(S.files_with(spark, path, index, "name", "needle1")) == 1 and len(S.files_with(spark, path, index, "name", "edl")) == 3 and not S.files_with(spark, path, index, "name", "nothing here")
    files = S.containing(spark, path, index, "name", "needle1").inputFiles()
    assert len(files) == 1 and "f=1/" in files[0]
