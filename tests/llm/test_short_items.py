"""Benchmark items of one to four words inside longer documents."""

import pyarrow as pa

from leadspark.llm import decontaminate as D


def test_short_items_in_longer_documents():
    items = D.Items([10, 11, 12, 13, 14], ["Alpha beta", "gamma", "one two three", "w x y z", "alpha, beta"])
    docs = ["see alpha-BETA here and alpha beta", "gamma", "two three", "ends with one", "two three w x y", "a b c d e one two three", "W x, y z", None, "z w x y"]
    found = sorted(D.find(items, pa.array(docs), 0.75))
    assert found == [(0, 0, 1.0, 1), (0, 4, 1.0, 1), (1, 1, 1.0, 0), (5, 2, 1.0, 5), (6, 3, 1.0, 0)]
