"""Resolution run by run against resolving all at once."""

import random

import pytest

from leadspark.operators import resolve as R
from leadspark.operators.run_index import RunIndex, resolve_runs

KIND = "record_id string, retrieved_at int, source_adapter string, source_record_id string, name string, phone string, address string, website string, city string, state string, latitude double, longitude double, rating double, reviews_count int, completeness double"


def records(n, seed):
    """Few names with slips, cities, phones and places, so that records meet by each kind of edge, and best names change as better records come."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(5, 14))).strip() + " x" for _ in range(n // 4)]
    rows = []
    for i in range(n):
        name = rng.choice(stems)
        if rng.random() < 0.5:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("abcxyz") + name[at + 1 :]
        phone = f"98{rng.randrange(n // 2):08d}" if rng.random() < 0.4 else None
        place = (round(20 + rng.randrange(6) * 0.004, 3), round(70 + rng.randrange(6) * 0.004, 3)) if rng.random() < 0.5 else (None, None)
        rows.append((f"r{i:05d}", i, "web_search", f"s{i}" if rng.random() < 0.9 else None, rng.choice((name, name, name.upper(), None)), phone, rng.choice((None, "A St")), rng.choice((None, "https://x.in")), rng.choice((None, "Goa", "Pune", "Goa")), None, *place, None, None, 0.5))
    return rows


@pytest.mark.parametrize(("n", "cuts", "seed"), [(150, (50, 51, 100), 1)])
def test_runs_give_the_partition_of_all(spark, tmp_path, n, cuts, seed):
    rows = records(n, seed)
    bounds = [0, *cuts, n]
    runs = [spark.createDataFrame(rows[a:b], KIND) for a, b in zip(bounds, bounds[1:], strict=False)]
    found = {r.record_id: r.root for r in resolve_runs(spark, [*runs, runs[0].limit(0)], str(tmp_path / "index"), buckets=4).collect()}
    whole = R.assign_clusters(R.with_index(spark.createDataFrame(rows, KIND), "retrieved_at", "record_id"))
    want = {r.record_id: r.root for r in whole.collect()}
    assert found == want and 1 < len(set(want.values())) < n


def test_a_run_that_fails_may_be_repeated(spark, tmp_path, monkeypatch):
    rows = records(60, 3)
    index = RunIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(spark.createDataFrame(rows[:40], KIND))
    before = index.clusters.manifest()["parts"]
    late = spark.createDataFrame(rows[40:], KIND)
    monkeypatch.setattr(index.clusters, "update", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        index.add(late)
    again = RunIndex(spark, str(tmp_path / "index"))
    assert again.runs == 1 and again.buckets == 4 and again.members().count() == 40 and again.clusters.manifest()["parts"] == before
    again.add(late)
    whole = R.assign_clusters(R.with_index(spark.createDataFrame(rows, KIND), "retrieved_at", "record_id"))
    assert {tuple(r) for r in again.members().select("record_id", "root").collect()} == {tuple(r) for r in whole.select("record_id", "root").collect()}
