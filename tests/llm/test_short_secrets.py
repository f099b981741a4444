"""Short values of one owner are redacted; the scan keeps the rule of its SQL."""

from leadspark.llm import secrets


def test_short_values_are_redacted(spark):
    texts = ["password: k7Qz93mfTb", "password: k7Qz93mfTb.", "token=abcdefghij", "token = changeme12", "secret=a1a1a1a1", "api_key: z8Xw41pq, end"]
    rows = [(i, t, "o/r") for i, t in enumerate(texts)] + [(10 + i, "passwd=c0mm0nPw77", f"o{i}/r") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    want = ["password: [SECRET]", "password: [SECRET]", texts[2], texts[3], texts[4], "api_key: [SECRET], end"]
    assert [got[i] for i in range(6)] == want and all(got[10 + i] == "passwd=c0mm0nPw77" for i in range(3))
    assert {r.n_live for r in secrets.scan(df).collect()} == {0}
