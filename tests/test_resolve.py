"""Entity resolution against brute force in plain Python."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from leadspark.operators import components as components_module
from leadspark.operators import resolve as R
from leadspark.operators import similar
from leadspark.operators.components import components, stars
from leadspark.operators.similar import near_and_similar, similar_names


def grams(s):
    return {s[i : i + 2] for i in range(len(s) - 1)}


def dice(a, b):
    return 1.0 if a == b else 2 * len(grams(a) & grams(b)) / max(1, len(grams(a)) + len(grams(b)))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {frozenset(m for m in nodes if find(m) == find(n)) for n in nodes}


def random_names(n, seed):
    rng = random.Random(seed)
    stems = ["star hospital", "star hospitals", "city care clinic", "city care clinics", "om bakery", "sunrise hotel", "sunrise hotels"]
    return ["".join(c if rng.random() > 0.05 else rng.choice("abc") for c in rng.choice(stems)) for _ in range(n)]


def test_similar_names(spark):
    names = random_names(150, 1) + ["ab", "", "star hospital"]
    rows = [(i, f"b{i % 2}", n) for i, n in enumerate(names)]
    found = {(r.a, r.b) for r in similar_names(spark.createDataFrame(rows, "item long, block string, name string"), 0.85).collect()}
    want = {(x[0], y[0]) for x, y in combinations(rows, 2) if x[1] == y[1] and min(len(x[2]), len(y[2])) >= 3 and dice(x[2], y[2]) >= 0.85}
    assert found <= want and groups(found, range(len(rows))) == groups(want, range(len(rows)))


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_near_and_similar(spark):
    rng = random.Random(2)
    rows = [(i, n, 60 + rng.random() * 0.1, 20 + rng.random() * 0.1) for i, n in enumerate(random_names(200, 3))] + [(200, "om bakery", 0.0, 20.0), (201, "om bakery", None, 20.0)]
    found = {(r.a, r.b) for r in near_and_similar(spark.createDataFrame(rows, "item long, name string, latitude double, longitude double")).collect()}
    cell = lambda x: math.floor(x / 0.01)
    ok = [r for r in rows if r[2] and r[3]]
    want = {(x[0], y[0]) for x, y in combinations(ok, 2) if abs(cell(x[2]) - cell(y[2])) <= 1 and abs(cell(x[3]) - cell(y[3])) <= 1 and km(x[2:], y[2:]) <= 1 and dice(x[1], y[1]) >= 0.7}
    assert found == want and want


@pytest.mark.parametrize("limit", [similar.BROADCAST_CELLS, 0])
def test_names_on_one_point(spark, monkeypatch, limit):
    """A position that many names share: what meets stays near the number of pairs found; with and without a list of dense cells."""
    monkeypatch.setattr(similar, "BROADCAST_CELLS", limit)
    rng = random.Random(6)
    stems = random_names(100, 5)
    names = sorted({s[:i] + rng.choice("abcdef") + s[i + 1 :] for s in stems for _ in range(6) for i in [rng.randrange(len(s))]})
    rows = [(i, n, 20.0, 70.0) for i, n in enumerate(names)] + [(len(names) + i, n, 21.0 + i * 0.001, 70.0) for i, n in enumerate(stems[:40])]
    df = spark.createDataFrame(rows, "item long, name string, latitude double, longitude double")
    found = {(r.a, r.b) for r in near_and_similar(df).collect()}
    cell = lambda x: math.floor(x / 0.01)
    want = {(x[0], y[0]) for x, y in combinations(rows, 2) if abs(cell(x[2]) - cell(y[2])) <= 1 and km(x[2:], y[2:]) <= 1 and dice(x[1], y[1]) >= 0.7}
    assert found == want and want
    grams = similar.with_grams(df.select("item", "name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))
    stored, asking = similar.place_entries(grams, 0.7, dense=similar.dense_cells(grams))
    assert stored.join(asking, "key").count() <= 20 * len(want) + 9 * len(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, None), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.label for r in components(df, small=0).collect()}
    assert found == {r.node: r.label for r in components(df).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    for g in groups(real, {n for e in real for n in e}):
        assert {found[n] for n in g} == {min(g)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("edges", "most"), [([(i, i + 1) for i in range(2000)], 4), ([(0, i) for i in range(1, 3000)], 0), ([(2999, i) for i in range(2999)], 1), (list(combinations(range(60), 2)), 1)])
def test_stars(spark, edges, most):
    """Paths take a third of the rounds that following labels takes, whose rounds are the logarithm of their length; stars and cliques one at most."""
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long").repartition(4)
    found, rounds = stars(df)
    assert rounds <= most and {(r.a, r.b) for r in found.collect()} == {(n, 0) for e in edges for n in e if n}


def test_no_driver_above_the_checked_size(spark, monkeypatch):
    monkeypatch.setattr(components_module, "_small_components", lambda pairs: pytest.fail("solved at the driver"))
    found = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), small=39)
    assert {(r.node, r.label) for r in found.collect()} == {(i, 0) for i in range(41)}


FIELDS = "idx long, record_id string, source_adapter string, source_record_id string, name string, phone string, address string, website string, city string, state string, latitude double, longitude double, rating double, reviews_count int, completeness double"


def test_clusters_and_companies(spark):
    rows = [
        (0, "r0", "a", "1", "Star", "9876543210", None, None, "Goa", None, None, None, None, 7, 0.5),
        (1, "r1", "b", "2", "Star Hotel", "+91 9876543210", "x", "https://s.com", "Goa", "Goa", 15.0, 74.0, 4.0, 9, 0.9),
        (2, "r2", "c", "3", "Star Hotel", None, None, None, "Goa", None, None, None, 3.0, 1, 0.3),
        (3, "r3", "a", "4", "Star Hotel", "1111111111", None, None, "Delhi", None, None, None, None, None, 0.4),
        (4, "r4", "a", "5", "Zed", None, None, None, None, None, None, None, None, None, 0.2),
    ]
    assigned = R.assign_clusters(spark.createDataFrame(rows, FIELDS))
    assert {r.record_id: r.root for r in assigned.collect()} == {"r0": 0, "r1": 0, "r2": 0, "r3": 3, "r4": 4}
    found = R.clusters(assigned)
    first = found.where("root = 0").head()
    assert (first.best_name, first.best_phone, first.rating, first.review_count, first.latitude, first.first_record, first.size, first.entity_id) == ("Star Hotel", "+91 9876543210", 4.0, 9, 15.0, "r0", 3, "entity_0")
    companies, links = R.upsert_companies(found)
    by_name = {r.name: r for r in companies.collect()}
    assert set(by_name) == {"Star Hotel", "Zed"} and by_name["Star Hotel"].phone == "+91 9876543210" and links.count() == 3
    apart, _ = R.upsert_companies(found, key=("name", "city"))
    assert apart.count() == 3
    again, _ = R.upsert_companies(found, companies.withColumn("phone", F.lit("old")))
    assert {r.phone for r in again.collect()} == {"old"} and again.count() == 2


def test_index_follows_order(spark):
    df = spark.createDataFrame([(i * 7 % 50, f"x{i}") for i in range(50)], "k int, v string")
    rows = R.with_index(df, "k").collect()
    assert all(r.idx == r.k for r in rows)


def test_unused_rules(spark):
    df = spark.createDataFrame([("A Clinic", "+91 98765 43210", None, "p"), ("A Clinic", None, "https://www.a-b.com/x", "p"), ("A Clinic", None, None, "p"), (None, None, None, "p")], "n string, p string, w string, x string")
    keys = [r[0] for r in df.select(R.entity_key(*[F.col(c) for c in "npwx"])).collect()]
    assert keys[:3] == ["phone:9876543210", "name:a|domain:abcom", "name:a"] and len(keys[3]) == 32
    one = lambda **k: {c: F.lit(k.get(c)).cast("double" if c in ("latitude", "longitude") else "string") for c in ("name", "phone", "website", "latitude", "longitude")}
    same = lambda a, b: spark.range(1).select(R.same_entity(one(**a), one(**b))).head()[0]
    assert same({"phone": "12345"}, {"phone": "1 2345"}) and same({"name": "Star"}, {"name": "Star Two"}) and not same({"name": "Om"}, {"name": "Star"})
    assert same({"name": "abcd", "latitude": 1.0, "longitude": 1.0}, {"name": "abcx", "latitude": 1.0001, "longitude": 1.0})
    fields = "key string, idx long, source string, name string, address string, phone string, website string, email string, industry string, opening_hours string, city string, state string, pin_code string, maps_url string, source_url string, latitude double, longitude double, rating double, reviews_count int"
    blank = [None] * 11
    rows = [("k", 0, "s1", "A", *blank, 0.0, 1.0, 3.0, 5), ("k", 1, "s2", "B", *blank, 2.0, 2.0, 4.0, 4)]
    m = R.merge_records(spark.createDataFrame(rows, fields)).head()
    assert (m["name"], m.latitude, m.longitude, m.rating, m.reviews_count, m.sources, m.field_sources["rating"]) == ("A", 2.0, 1.0, 4.0, 5, ["s1", "s2"], "s2")
