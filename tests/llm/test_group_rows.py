"""The pipeline keeps one row of each group of near-duplicates, whatever the rows' ids."""

import pytest

import corpus_pipeline

A = "one two three four five six seven eight nine ten"
ROWS = [
    (1, A),
    (2, A + " eleven"),  # a near copy of 1
    (2, "another text that repeats an id of the table"),
    (3, "a first text with the id three in it"),
    (3, "and some other text with the id three"),
    (4, "the same id and nearly the same text as here b"),
    (4, "the same id and nearly the same text as here"),
    (None, "a text of no id that has a near copy without one"),
    (None, "a text of no id that has a near copy without one too"),
    (None, "no id and no copy at all"),
    (5, ""),
    (6, None),
]


@pytest.mark.parametrize("stored", [True, False])
def test_rows_with_texts(spark, tmp_path, stored):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    if stored:
        df.write.parquet(str(tmp_path / "d"))
        df = spark.read.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.keep_one_of_group(spark, df, "")
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((ROWS[i] for i in (0, 2, 3, 4, 6, 7, 9, 10, 11)), key=repr)
