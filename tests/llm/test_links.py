"""The number of links of each document, inside components too."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadspark.llm import ngram_join


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    meet = lambda s, t: s and t and 100 * len(s & t) >= 75 * len(s | t)
    return sorted(((r[0], sum(1 for j, t in enumerate(sets) if j != i and meet(sets[i], t))) for i, r in enumerate(rows)), key=repr)


def near_copies():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    base, rows = [word() for _ in range(120)], []
    for i in range(60):  # of several sizes: not all of a component link
        w = base[: rng.randrange(70, 121)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_links_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    profile = docs.mapInArrow(ngram_join._profile, "doc_id long, n long, cls binary, node long, bits binary, sketch binary").where("cls is not null")
    classes = profile.groupBy("cls", "node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count("*").alias("k")).checkpoint()
    found = ngram_join._linked_rows(docs, classes, classes.select("node", F.lit(1).cast("long").alias("label")))
    got = profile.select("doc_id", "cls").join(classes.select("cls", "k"), "cls").join(found, "cls", "left")
    got = got.select("doc_id", F.coalesce("n_links", F.lit(0)) + F.col("k") - 1)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows)


def test_links_of_documents(spark):
    rows = near_copies()[:5]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (200, None), (201, "alone here"), (None, rows[1][1]), (1, "one id twice")]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), count_links=True)
    assert sorted(map(tuple, found.select("doc_id", "n_links").collect()), key=repr) == brute_links(rows)
