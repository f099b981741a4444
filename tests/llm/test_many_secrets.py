"""Spans of texts with very many matches, and values of few owners that many repositories hold."""

import re

from pyspark.sql import functions as F

from leadspark.llm import secrets as S


def brute(text):
    out = []
    for k, (name, pattern, group, least) in enumerate([("assign", S.ASSIGN, 2, 8), ("access", S.ACCESS, 0, 16), ("hex", S.HEX, 0, 32)]):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_spans_of_many_matches(spark):
    few = "é token=abcdefgh12 password: 'qqqqqqqqq' " + "0123456789abcdef" * 2 + " AKIA" + "A" * 12 + " secret=abc"
    texts = ["", few, few * 8 + "é", ("0123456789abcdef" * 2 + " é ") * 5000, "token=aaaaaaaa " * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", S.render(S.base_spans(F.col("text"))).alias("spans"))
    assert {r.id: r.spans for r in rows.collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_repositories_count_too(spark):
    one, other = "k7Qz93mfTbX2pL8wRv4n", "Zq8Lm2Xc7Vb5Nk1Jh4Gf"
    rows = [(i, f"token={one}", f"team/{i}") for i in range(S.COPIED_REPOSITORIES)] + [(100, f"token={other}", "team/0"), (101, f"token={other}", "team/1")]
    found = {r.doc_id: (r.n_live, r.n_copied) for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i] == (0, 1) for i in range(S.COPIED_REPOSITORIES)) and found[100] == found[101] == (1, 0)
