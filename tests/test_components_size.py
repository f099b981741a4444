"""What the optimiser thinks of a loop's results must not grow with the loop."""

from leadspark.operators.components import stars


def test_estimated_size_stays_small(spark):
    """A path of several rounds: the estimate had some hundred thousand digits, which doubled with every step and filled the driver."""
    df = spark.createDataFrame([(i + 1, i) for i in range(700)], "a long, b long").repartition(4)
    found, rounds = stars(df)
    assert rounds >= 2 and {(r.a, r.b) for r in found.collect()} == {(i, 0) for i in range(1, 701)}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63
