"""Bigram similarity of names, and joins by it inside blocks.

Dice similarity of bigram sets of n and m bigrams is 2 c / (n + m).  For a threshold t two sets of
n <= m bigrams share c >= t (n + m) / 2 of them, so, in any common order, they share k of
the smaller one's first n - t n + k and of the larger one's first m - t / (2 - t) m + k.
Bigrams are far too common to be looked up singly, so combinations of k of these first ones
are, rarest bigrams first: the smaller side is stored under its few combinations, the larger
side asks for its own.  A pair whose k-th shared bigram stands too late to leave room
for c is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the counts that order bigrams: so many rows are broadcast, at any size of the input.
GRAM_BUCKETS = 1 << 16


def bigrams(x: Column) -> Column:
    """The distinct pairs of neighbouring characters; empty for fewer than two."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))
    return F.when(F.length(x) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def dice(x: Column, y: Column) -> Column:
    """1 for equal non-empty strings, else the Dice similarity of their bigrams; 0 if one has none."""
    a, b = bigrams(x), bigrams(y)
    both = F.size(F.array_intersect(a, b))
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _code(gram: Column) -> Column:
    """A bigram as a number."""
    return F.shiftleft(F.ascii(gram).cast("long"), 21) + F.ascii(F.substr(gram, F.lit(2))).cast("long")


def _coded(rows: DataFrame) -> DataFrame:
    """(item, gram, bucket) of each distinct bigram of a name, as a number."""
    return rows.select("item", F.explode(F.transform(bigrams(F.col("name")), _code)).alias("gram")).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, seen): how often bigrams of rows(item, name) fall into each bucket, at most GRAM_BUCKETS rows."""
    return _coded(rows).groupBy("bucket").agg(F.count("*").alias("seen"))


def with_grams(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """rows(item, name, ...) with `grams`, the name's distinct bigrams as numbers, rarest first, and their number `n`.

    The order comes from counts in a table of fixed size, by default of these rows; bigrams that share a bucket only
    share its count.  Any order is right that all rows of a join have in common.  Names without a bigram go.
    """
    each = _coded(rows)
    if seen is None:
        counted = each.join(F.broadcast(each.groupBy("bucket").agg(F.count("*").alias("seen"))), "bucket")
    else:
        counted = each.join(F.broadcast(seen), "bucket", "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
    ordered = counted.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("seen", "gram"))).alias("x"))
    return rows.join(ordered.select("item", F.col("x.gram").alias("grams"), F.size("x").alias("n")), "item")


def _entries(block: list[str], prefix: Column, k: int) -> Column:
    """(key, place) of each combination of k of the first `prefix` bigrams, within a block; place is that of its last bigram.  A name of fewer than k bigrams has one entry, of them all."""
    grams = F.slice("grams", F.lit(1), prefix)
    if k == 1:
        return F.transform(grams, lambda g, i: F.struct(F.xxhash64(*block, g).alias("key"), (i + 1).alias("place")))
    pairs = F.flatten(F.transform(grams, lambda g, j: F.transform(F.slice(grams, F.lit(1), j), lambda f: F.struct(F.xxhash64(*block, f, g).alias("key"), (j + 1).alias("place")))))
    return F.when(F.col("n") >= 2, pairs).otherwise(F.transform(grams, lambda g: F.struct(F.xxhash64(*block, g).alias("key"), F.lit(1).alias("place"))))


def candidates(stored: DataFrame, asking: DataFrame, threshold: float, k: int, more: Column | None = None) -> DataFrame:
    """(a, b) from stored(key, place, n, item, ...) and asking(key, place, n, item, ...): pairs that may reach the threshold, the smaller item first."""
    x, y = (t.select("key", *[F.col(c).alias(f"{c}_{v}") for c in t.columns if c != "key"]) for t, v in ((stored, "x"), (asking, "y")))
    share = F.ceil((F.col("n_x") + F.col("n_y")) * F.lit(threshold / 2) - F.lit(1e-9))
    smaller = (F.col("n_x") < F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("item_x") < F.col("item_y"))
    left = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    fits = smaller & (share <= F.col("n_x")) & (left + F.least(F.lit(k), F.col("n_x")) >= share)
    pairs = x.join(y, "key").where(fits if more is None else fits & more)
    return pairs.select(F.least("item_x", "item_y").alias("a"), F.greatest("item_x", "item_y").alias("b")).distinct()


def verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose bigrams, from grams(item, grams, n), reach the threshold; only ids were exchanged so far."""
    x, y = (grams.select(F.col("item").alias(v), F.col("grams").alias(f"g{v}"), F.col("n").alias(f"n{v}")) for v in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(x, "a").join(y, "b").where(2.0 * both / (F.col("na") + F.col("nb")) >= threshold).select("a", "b")


def name_entries(names: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(stored, asking) entries (key, place, n, item) of names(item, block, grams, n), for candidates() with pairs of bigrams."""
    side = lambda share: names.select("item", "n", F.inline(_entries(["block"], F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)).cast("int") + 2, 2)))
    return side(threshold), side(threshold / (2 - threshold))


def similar_names(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of items of rows(item long, block, name) whose names reach the threshold within one block, a < b.

    Names shorter than three characters and null blocks match nothing.  Equal names of a block are tied to the
    least item first; of different names only pairs that share a combination of two
    bigrams and fit in size are compared.  A block of many names is dealt out by these combinations.
    """
    rows = rows.select("item", "block", "name").where("length(name) >= 3 and block is not null")
    one = rows.groupBy("block", "name").agg(F.min("item").alias("least"))
    equal = rows.join(one, ["block", "name"]).where("item <> least").select(F.col("least").alias("a"), F.col("item").alias("b"))
    names = with_grams(one.select(F.col("least").alias("item"), "block", "name")).select("item", "block", "grams", "n").checkpoint()
    pairs = candidates(*name_entries(names, threshold), threshold, 2)
    return equal.unionByName(verified(pairs, names, threshold))


def near_by(km: float) -> Column:
    """Whether the two sides of candidates() lie within `km`."""
    return haversine_km(F.col("lat_x"), F.col("lon_x"), F.col("lat_y"), F.col("lon_y")) <= km


#: Names in a cell and those around it, up to which all of them are tested for distance; in denser cells pairs of bigrams choose.
DENSE = 64
#: Dense cells up to which their list is broadcast; beyond, all cells count as dense.
BROADCAST_CELLS = 200_000


def _around(gx: str = "gx", gy: str = "gy") -> Column:
    return F.explode(F.array(*[F.struct((F.col(gx) + i).alias("gx"), (F.col(gy) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def place_entries(names: DataFrame, threshold: float, cell: float = 0.01, dense: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored, asking) entries (key, place, n, lat, lon, item) of names(item, lat, lon, grams, n), for candidates() with pairs of bigrams; stored in the cells around too.

    With dense(gx, gy), names in other cells have the cell alone as their key, so that all of them meet.
    """
    gx, gy = (F.floor(F.col(c) / F.lit(cell)).cast("long").alias(g) for c, g in (("lat", "gx"), ("lon", "gy")))
    own = names.select("item", "lat", "lon", "grams", "n", gx, gy)
    there = own.withColumn("c", _around()).select("item", "lat", "lon", "grams", "n", "c.gx", "c.gy")
    out = []
    for rows, share in ((there, threshold), (own, threshold / (2 - threshold))):
        entries = _entries(["gx", "gy"], F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)).cast("int") + 2, 2)
        if dense is not None:
            rows = rows.join(F.broadcast(dense.withColumn("dense", F.lit(True))), ["gx", "gy"], "left")
            entries = F.when(F.col("dense"), entries).otherwise(F.array(F.struct(F.xxhash64("gx", "gy").alias("key"), F.lit(0).alias("place"))))
        out.append(rows.select("item", "n", "lat", "lon", F.inline(entries)))
    return out[0], out[1]


def dense_cells(names: DataFrame, cell: float = 0.01) -> DataFrame | None:
    """(gx, gy) of the cells that, with those around, hold more than DENSE of names(lat, lon); None if there are too many to broadcast."""
    gx, gy = (F.floor(F.col(c) / F.lit(cell)).cast("long").alias(g) for c, g in (("lat", "gx"), ("lon", "gy")))
    near = names.groupBy(gx, gy).agg(F.count("*").alias("n")).select("n", _around().alias("c")).groupBy("c.gx", "c.gy").agg(F.sum("n").alias("n"))
    found = near.where(F.col("n") > DENSE).select("gx", "gy").checkpoint()
    return found if found.count() <= BROADCAST_CELLS else None


#: Pairs of a cell's own names and those within reach of it, up to which all of them meet: a test of bits takes some nanoseconds, an entry in
#: a shuffle about a microsecond, and a name has some fifty of these.
MEET = 2000 * 2000


def _cells(names: DataFrame, km: float) -> DataFrame:
    """links(gx, gy, tx, ty, dense): each cell of names(gx, gy, lat, lon) and the cells, itself or next to it, whose names may be within `km` of its own.

    The boxes around the names of two cells are compared, so no pair is lost; dense tells that more than MEET pairs would meet in (tx, ty).
    """
    box = names.groupBy("gx", "gy").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.count("*").alias("own")).checkpoint()
    there = box.select(F.col("gx").alias("tx"), F.col("gy").alias("ty"), *[F.col(c).alias(f"t{c}") for c in ("s", "n", "w", "e", "own")])
    met = box.withColumn("c", _around()).withColumns({"tx": F.col("c.gx"), "ty": F.col("c.gy")}).drop("c").join(there, ["tx", "ty"])
    apart = lambda low, high, tlow, thigh: F.radians(F.greatest(F.lit(0.0), tlow - high, low - thigh)) / 2
    up, along = apart(*map(F.col, ("s", "n", "ts", "tn"))), apart(*map(F.col, ("w", "e", "tw", "te")))
    slim = lambda a, b: F.least(F.cos(F.radians(a)), F.cos(F.radians(b)))  # noqa: E731  between latitudes of one cell, away from the poles, the cosine is least at an end
    h = F.sin(up) * F.sin(up) + slim("s", "n") * slim("ts", "tn") * F.sin(along) * F.sin(along)
    near = F.lit(6371.0) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h)) <= km * (1 + 1e-9) + 1e-9
    polar = F.greatest(*[F.abs(c) for c in ("s", "n", "ts", "tn")]) > 89
    links = met.where(near | polar)
    reach = links.groupBy("tx", "ty").agg((F.sum("own") * F.max("town") > MEET).alias("dense"))
    return links.join(reach, ["tx", "ty"]).select("gx", "gy", "tx", "ty", "dense").checkpoint()


def _bits(half: int) -> Column:
    """64 of 128 bits, of which each bigram sets one."""
    return F.expr(f"aggregate(grams, 0L, (s, g) -> s | CASE WHEN pmod(xxhash64(g), 128) DIV 64 = {half} THEN shiftleft(1L, CAST(pmod(xxhash64(g), 64) AS INT)) ELSE 0L END)")


def _all_meet(names: DataFrame, links: DataFrame, threshold: float, km: float) -> DataFrame:
    """(a, b) of names(item, name, lat, lon, gx, gy, new) that are near and alike, one of them new; all of a cell meet all within its reach.

    A bit that only one of two sets has stands for a bigram that only this one has, so bits rule most pairs out before distance and bigrams are looked at.
    """
    each = names.select("name").distinct().select("name", F.transform(bigrams(F.col("name")), _code).alias("grams")).withColumns({"n": F.size("grams"), "bits0": _bits(0), "bits1": _bits(1)})
    with_bits = names.join(each.checkpoint(), "name").drop("name")
    x = with_bits.join(links, ["gx", "gy"]).drop("gx", "gy").withColumnsRenamed({"tx": "gx", "ty": "gy"})
    x, y = (t.select("gx", "gy", *[F.col(c).alias(f"{c}_{v}") for c in ("item", "new", "lat", "lon", "n", "bits0", "bits1", "grams")]) for t, v in ((x, "x"), (with_bits, "y")))
    share = F.ceil((F.col("n_x") + F.col("n_y")) * F.lit(threshold / 2) - F.lit(1e-9))
    smaller = (F.col("n_x") < F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("item_x") < F.col("item_y"))
    only_x = sum((F.bit_count(F.col(f"bits{i}_x").bitwiseAND(F.bitwise_not(f"bits{i}_y"))) for i in (0, 1)), F.lit(0))
    both = F.size(F.array_intersect("grams_x", "grams_y"))
    alike = (F.col("new_x") | F.col("new_y")) & smaller & (F.col("n_x") - only_x >= share) & near_by(km) & (2.0 * both / (F.col("n_x") + F.col("n_y")) >= threshold)
    return x.join(y, ["gx", "gy"]).where(alike).select(F.least("item_x", "item_y").alias("a"), F.greatest("item_x", "item_y").alias("b"))


def _dealt(names: DataFrame, links: DataFrame, threshold: float, km: float) -> DataFrame:
    """(a, b) as from _all_meet(), for links to dense cells: the names are dealt out by pairs of their rarest bigrams."""
    ends = links.select("gx", "gy").unionByName(links.select(F.col("tx").alias("gx"), F.col("ty").alias("gy"))).distinct()
    grams = with_grams(names.join(ends, ["gx", "gy"], "left_semi")).select("item", "lat", "lon", "gx", "gy", "grams", "n").checkpoint()
    there = grams.join(links, ["gx", "gy"]).drop("gx", "gy").withColumnsRenamed({"tx": "gx", "ty": "gy"})
    own = grams.join(links.select(F.col("tx").alias("gx"), F.col("ty").alias("gy")).distinct(), ["gx", "gy"])
    side = lambda rows, share: rows.select("item", "n", "lat", "lon", F.inline(_entries(["gx", "gy"], F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)).cast("int") + 2, 2)))
    pairs = candidates(side(there, threshold), side(own, threshold / (2 - threshold)), threshold, 2, near_by(km))
    found, new = verified(pairs, grams, threshold), names.where("new")
    one = found.join(new.select(F.col("item").alias("a")), "a", "left_semi")
    return one.unionByName(found.join(new.select(F.col("item").alias("a")), "a", "left_anti").join(new.select(F.col("item").alias("b")), "b", "left_semi")).select("a", "b")


def in_cells(rows: DataFrame, cell: float = 0.01) -> DataFrame:
    """rows(lat, lon, ...) with their cell (gx, gy)."""
    return rows.withColumns({g: F.floor(F.col(c) / F.lit(cell)).cast("long") for c, g in (("lat", "gx"), ("lon", "gy"))})


def cells_around(rows: DataFrame) -> DataFrame:
    """(gx, gy) of the cells of rows(gx, gy) and those next to them."""
    return rows.select("gx", "gy").distinct().select(_around().alias("c")).select("c.gx", "c.gy").distinct()


def near_names(names: DataFrame, threshold: float, km: float = 1.0) -> DataFrame:
    """(a, b) of a checkpointed names(item, name, lat, lon, gx, gy, new) within `km` and alike, at least one of them new, a < b."""
    links = _cells(names, km)
    found, dense = _all_meet(names, links.where("not dense"), threshold, km), links.where("dense")
    return found.unionByName(_dealt(names, dense, threshold, km)) if dense.limit(1).count() else found


def near_and_similar(rows: DataFrame, threshold: float = 0.70, cell: float = 0.01, km: float = 1.0) -> DataFrame:
    """(a, b) of items of rows(item long, name, latitude, longitude) within `km` of each other and with similar names, a < b.

    Only pairs in the same or neighbouring cells of a grid in degrees count, so away from the
    equator some pairs that are near but more than one cell apart are left out.  Rows of the same
    name and position are tied to the least item first.  A cell's names meet all names in the cells within reach
    of it; those of a dense one, such as a position that very many share, are dealt out by pairs of their rarest bigrams.
    """
    rows = rows.select("item", "name", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")).where("length(name) >= 3 and lat <> 0 and lon <> 0 and not isnan(lat) and not isnan(lon)")
    one = rows.groupBy("name", "lat", "lon").agg(F.min("item").alias("least"))
    equal = rows.join(one, ["name", "lat", "lon"]).where("item <> least").select(F.col("least").alias("a"), F.col("item").alias("b"))
    names = in_cells(one.select(F.col("least").alias("item"), "name", "lat", "lon"), cell).withColumn("new", F.lit(True)).checkpoint()
    return equal.unionByName(near_names(names, threshold, km))
