"""Texts with very long runs of white space or of letters get the ids of the JSON file's library."""

from leadspark.llm import packing


def test_long_runs_keep_their_ids():
    from tokenizers import Tokenizer

    paths = packing.vocabulary()
    encode, whole = packing.encoder(*paths), Tokenizer.from_file(paths[1])
    for text in (" " * 1_200_000 + "a", "\n" * 300_000, "a" * 300_000, " " * 5000 + "b", "x" * 999 + " " * 999 + "y", "a b " * 400 + " " * 1000 + "<|endoftext|>", "", " " * 999):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_bases_are_joined_where_they_are_many(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(120)], "doc_id long, text string").repartition(4)
    one, other = (sorted(map(tuple, packing.pack(docs, *packing.vocabulary(), broadcast_bases=n).drop("sequence_id", "offset").collect())) for n in (packing.BROADCAST_BASES, 0))
    assert one == other
    rows = packing.pack(docs, *packing.vocabulary(), broadcast_bases=0).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(o == sum(n for _, n in sorted(x)[:k]) for x in by.values() for k, (o, _) in enumerate(sorted(x)))
