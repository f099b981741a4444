"""Every operator takes texts of millions of characters: white space, line ends, one letter, and words."""

import zlib

import pytest

from leadspark.llm import decontaminate, language, licenses, media, ngram_join, packing, secrets, toxicity

ITEM = "a benchmark item of some nine words in all"
WORDS = " ".join(f"word{i % 5000}" for i in range(500_000)) + " licensed under cc by 4.0 " + ITEM + " token=abcdefgh12"
TEXTS = [" " * 2_000_000 + "a", "\n" * 2_000_000, "a" * 2_000_000, WORDS, WORDS + " more"]


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "docs")
    spark.createDataFrame([(i, t, "en", "a/b") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(path)
    return spark.read.parquet(path)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_join(long_docs):
    found = by_id(ngram_join.near_duplicates(long_docs))
    assert [found[i].component_id for i in range(5)] == [0, 1, 2, 3, 3] and found[1].n_shingles == 0 and found[2].n_shingles == 1


def test_models(spark, long_docs):
    short = spark.createDataFrame([(10, "the dog and the cat", "en"), (11, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    found = by_id(language.identify(long_docs, language.fit(short)))
    assert found[1].lang_pred == "und" and found[0].lang_pred != "und" and len(found) == 5
    labels = spark.createDataFrame([(10, 0), (11, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in by_id(toxicity.score(long_docs, toxicity.fit(short, labels))).values())


def test_scans(spark, long_docs):
    found = by_id(licenses.scan(long_docs))
    assert [found[i].n_words for i in range(4)] == [1, 0, 1, 500_000 + 6 + 9 + 2] and found[3].base_labels == "cc-by" and "cc-by-4.0" in found[3].labels
    found = by_id(secrets.scan(long_docs))
    assert [found[i].n_assign for i in range(5)] == [0, 0, 0, 1, 1] and [found[i].n_hex for i in range(3)] == [0, 0, 1]
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(long_docs, items).collect()} == {(3, 7), (4, 7)}


def test_media_and_packing(long_docs):
    found = by_id(media.read_back(media.store(long_docs)).drop("media", "hash"))
    for i, t in enumerate(TEXTS):
        payload = media.pad(t.encode())
        assert found[i].payload_bytes == len(payload) and found[i].tail_crc32 == zlib.crc32(payload[-64:])
    sizes = {}
    for r in packing.pack(long_docs, *packing.vocabulary()).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes[0] == 2_000_001 and all(sizes[i] > 400_000 for i in range(5))
