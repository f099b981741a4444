"""Names of cells that lie next to one another but out of reach are not brought together, and none within reach are lost."""

import random

import pytest

from leadspark.operators import similar
from leadspark.operators.similar import near_and_similar
from tests.test_resolve import combinations, dice, km, math, random_names


@pytest.mark.parametrize("meet", [similar.MEET, 400, 0])
def test_all_pairs_within_reach(spark, monkeypatch, meet):
    """With all, some and no cells small enough for all their names to meet; also near the pole and south of the equator."""
    monkeypatch.setattr(similar, "MEET", meet)
    rng = random.Random(8)
    corners = [(60.0, 20.0), (-0.02, -0.02), (89.99, 5.0), (-33.0, 150.0)]
    rows = [(i, n, la + rng.randrange(12) * 0.004 * (la < 89), lo + rng.randrange(12) * 0.004) for i, n in enumerate(random_names(240, 9)) for la, lo in [corners[i % 4]]]
    found = [(r.a, r.b) for r in near_and_similar(spark.createDataFrame(rows, "item long, name string, latitude double, longitude double")).collect()]
    cell = lambda x: math.floor(x / 0.01)
    first = {}
    for r in rows:
        first.setdefault(r[1:], r[0])
    ok = [r for r in rows if r[2] and r[3]]
    kept = [r for r in ok if first[r[1:]] == r[0]]
    want = {(x[0], y[0]) for x, y in combinations(kept, 2) if abs(cell(x[2]) - cell(y[2])) <= 1 and abs(cell(x[3]) - cell(y[3])) <= 1 and km(x[2:], y[2:]) <= 1 and dice(x[1], y[1]) >= 0.7}
    want |= {(first[r[1:]], r[0]) for r in ok if first[r[1:]] != r[0]}
    assert len(found) == len(set(found)) and set(found) == want and want


def test_cells_out_of_reach(spark):
    """Places 1.2 km apart in neighbouring cells: each name went to nine cells, with some fifteen entries in each of them."""
    rows = [(i, "star hospital", 10 + i * 0.013, 70 + j * 0.011, int((10 + i * 0.013) // 0.01), int((70 + j * 0.011) // 0.01)) for i in range(6) for j in range(6)]
    links = similar._cells(spark.createDataFrame(rows, "item long, name string, lat double, lon double, gx long, gy long"), 1.0).collect()
    assert len(links) == 36 and all((r.gx, r.gy) == (r.tx, r.ty) for r in links)
