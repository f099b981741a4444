"""Resolution run by run: a stored index of all records so far, and the changes that a new run makes to it.

Exact keys, entries of names, names at places, and edges are only ever added, a folder for each run.  What
they point to moves on: clusters of exact keys merge and their best names change, so an entry or edge counts only if the
cluster's version it was made for is still the current one.  A new run

1. looks its keys up and finds which clusters of exact keys grow or merge, from its own edges alone;
2. merges the best name and city of these, which takes no look at their records, as the best of parts is the best of all;
3. compares the names that are new or have changed, and the places of the new records, with the index and one another;
4. solves the components again that these clusters or edges belong to, and no others.

The result is the partition that assign_clusters() makes of all records at once.  The current clusters are a snapshot table
of buckets, of which a run rewrites those it touches, and its commit makes the run count; a run that fails before it leaves all as it
was and may be repeated.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import match_name, or_null, strip
from ..sources.snapshots import Snapshots, bucket
from .components import components, ensure_checkpoint_dir, star_edges
from .resolve import FIRST_FIELDS, FUZZY, SPATIAL, _fill, city_block, record_keys, with_index, with_keys
from .similar import candidates, cells_around, gram_counts, in_cells, name_entries, near_names, verified, with_grams

#: Columns of the tables that a run adds to; `part` is a bucket of the column that a table is looked up by.
TABLES = {
    "records": "idx long, record_id string, first long",
    "keys": "key string, first long",
    "grams": "item long, version int, grams array<long>, n int",
    "names_stored": "item long, n int, key long, place int",
    "names_asking": "item long, n int, key long, place int",
    "places": "item long, first long, name string, lat double, lon double, gx long, gy long",
    "alike": "a long, version_a int, b long, version_b int",
    "near": "a long, b long",
}
LOOKED_UP_BY = {"keys": "key", "names_stored": "key", "names_asking": "key", "grams": "item", "places": "gx"}
_BEST = "name string, name_fill int, name_idx long, city string, city_fill int, city_idx long"
CURRENT = f"first long, root long, version int, {_BEST}"


class RunIndex:
    """The index at `path`; its buckets are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        ensure_checkpoint_dir(spark)
        self.spark, self.path = spark, path
        self.clusters = Snapshots(spark, f"{path}/clusters")
        note = self.clusters.manifest()["note"]
        self.runs, self.size, self.buckets = note.get("runs", 0), note.get("records", 0), note.get("buckets", buckets)

    def _table(self, name: str, among: DataFrame | None = None) -> DataFrame:
        """The rows of all runs that count; with `among`, from the buckets alone that hold its values of the column that the table is looked up by."""
        kind = TABLES[name]
        if not self.runs:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(f"{kind}, run int, part int").parquet(f"{self.path}/{name}").where(F.col("run") < self.runs)
        if among is not None:
            by = LOOKED_UP_BY[name]
            parts = [r[0] for r in among.select(self._part(by)).distinct().collect()]  # at most `buckets`
            rows = rows.where(F.col("part").isin(parts))
        return rows.drop("run", "part")

    def _part(self, by: str):
        return F.pmod(F.xxhash64(by), F.lit(self.buckets)).cast("int").alias("part")

    def _add(self, name: str, rows: DataFrame) -> None:
        by = LOOKED_UP_BY.get(name)
        part = self._part(by) if by else F.lit(0).alias("part")
        rows.select("*", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/run={self.runs}")

    def _moved(self) -> DataFrame:
        """(first, now): clusters of exact keys that went into others."""
        if not self.runs:
            return self.spark.createDataFrame([], "first long, now long")
        return self.spark.read.schema("first long, now long").parquet(f"{self.path}/moved/run={self.runs - 1}")

    def _order(self, name: str, rows: DataFrame) -> DataFrame:
        """The order of bigrams, which the first run that has names fixes."""
        path = f"{self.path}/{name}"
        if not self.runs:
            gram_counts(rows).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("bucket long, seen long").parquet(path)

    def _current(self, among: DataFrame | None = None) -> DataFrame:
        """Current clusters of exact keys; with among(first), from the buckets alone that hold these."""
        parts = None if among is None else self._buckets(among)
        return self.clusters.read(self.runs, parts) if self.runs else self.spark.createDataFrame([], CURRENT)

    def _buckets(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(bucket(F.col("first"), self.buckets)).distinct().collect()]  # at most `buckets`

    def members(self) -> DataFrame:
        """(record_id, idx, root) of all records; root is the least idx of a record's cluster."""
        first = self._table("records").join(self._moved(), "first", "left").withColumn("first", F.coalesce("now", "first")).drop("now")
        return first.join(self._current().select("first", "root"), "first").select("record_id", "idx", "root")

    def add(self, cleaned: DataFrame) -> int:
        """Resolve a run's cleaned records with all before them; the number of runs.

        Records count by retrieval after all earlier runs' ones.  A run without records changes nothing.
        """
        new = with_index(cleaned, "retrieved_at", "record_id").withColumn("idx", F.col("idx") + F.lit(self.size))
        new = with_keys(new).withColumn("fill", _fill(FIRST_FIELDS)).checkpoint()
        n = new.count()
        if not n:
            return self.runs
        moved = self._moved()
        now = lambda t: t.join(moved, "first", "left").withColumn("first", F.coalesce("now", "first")).drop("now")

        # 1. clusters of exact keys
        keys = record_keys(new).checkpoint()
        held = now(self._table("keys", keys).join(keys.select("key").distinct(), "key")).checkpoint()
        known = keys.join(held, "key").select(F.col("idx").alias("a"), F.col("first").alias("b"))
        fresh = keys.join(held, "key", "left_anti").checkpoint()
        label = components(known.unionByName(star_edges(fresh))).checkpoint()
        new = new.join(label.withColumnRenamed("node", "idx"), "idx", "left").withColumn("first", F.coalesce("label", "idx")).drop("label").checkpoint()
        hit = label.where(F.col("node") < self.size).select(F.col("node").alias("first"), "label").checkpoint()
        went = hit.where("first <> label").select("first", F.col("label").alias("now"))
        onward = went.select(F.col("first").alias("now"), F.col("now").alias("next"))
        moved = moved.join(onward, "now", "left").select("first", F.coalesce("next", "now").alias("now")).unionByName(went).checkpoint()
        self._add("records", new.select("idx", "record_id", "first"))
        places = self._place_keys(new)
        place_held = now(self._table("keys", places).join(places.select("key").distinct(), "key")).checkpoint()
        place_fresh = places.join(place_held, "key", "left_anti").groupBy("key").agg(F.min_by("first", "idx").alias("first"), F.min("idx").alias("idx")).checkpoint()
        of_first = new.select("idx", "first")
        self._add("keys", fresh.join(of_first, "idx").groupBy("key").agg(F.min("first").alias("first")).unionByName(place_fresh.select("key", "first")))

        # 2. their best names and cities
        own = new.select("first", "fill", "idx", *[or_null(strip(F.col(f))).alias(f) for f in ("name", "city")])
        parts = own.select("first", F.lit(None).cast("int").alias("version"), F.lit(None).cast("long").alias("own"), *[x for f in ("name", "city") for x in (F.col(f), F.when(F.col(f).isNotNull(), F.col("fill")).alias(f"{f}_fill"), F.when(F.col(f).isNotNull(), F.col("idx")).alias(f"{f}_idx"))])
        before = self._current(hit).join(hit, "first").checkpoint()
        old = before.select(F.col("label").alias("first"), "version", F.col("first").alias("own"), *[f"{f}{x}" for f in ("name", "city") for x in ("", "_fill", "_idx")])
        top = lambda f: F.max_by(F.struct(f, f"{f}_fill", f"{f}_idx"), F.when(F.col(f).isNotNull(), F.struct(f"{f}_fill", -F.col(f"{f}_idx")))).alias(f"best_{f}")
        merged = parts.unionByName(old).groupBy("first").agg(top("name"), top("city"), F.max(F.when(F.col("own") == F.col("first"), F.struct("version", "name", "city"))).alias("was"))
        same = F.col("was").isNotNull() & match_name(F.col("best_name.name")).eqNullSafe(match_name(F.col("was.name"))) & city_block(F.col("best_city.city")).eqNullSafe(city_block(F.col("was.city")))
        changed = merged.select("first", F.when(same, F.col("was.version")).otherwise(self.runs).cast("int").alias("version"), "best_name.*", "best_city.*").checkpoint()

        # 3. names and places that are alike
        alike, near = self._alike(changed, hit), self._near(new, place_fresh, places.join(place_held.withColumnRenamed("first", "b"), "key").select("idx", "b"), places)
        self._add("alike", alike)
        self._add("near", near)

        # 4. components of what has changed
        current = self._current().join(hit.select("first"), "first", "left_anti").unionByName(changed.withColumn("root", F.lit(None).cast("long")))
        to = lambda t, c: t.join(moved.select(F.col("first").alias(c), "now"), c, "left").withColumn(c, F.coalesce("now", c)).drop("now")
        ends = alike.select("a", "b").unionByName(to(to(near, "a"), "b"))
        ends = ends.select(F.col("a").alias("first")).unionByName(ends.select(F.col("b").alias("first"))).distinct()
        roots = before.select("root").unionByName(current.join(ends, "first").select("root")).where("root is not null").distinct().checkpoint()
        open_ = current.join(roots, "root", "left_semi").unionByName(current.where("root is null")).select("first", "version", *[c for c in changed.columns if c not in ("first", "version")]).checkpoint()
        version = lambda c: open_.select(F.col("first").alias(c), F.col("version").alias(f"version_{c}"))
        named = self._table("alike").unionByName(alike).join(version("a"), ["a", "version_a"]).join(version("b"), ["b", "version_b"]).select("a", "b")
        placed = to(to(self._table("near").unionByName(near), "a"), "b").join(version("a"), "a", "left_semi")
        root = components(named.unionByName(placed)).withColumnRenamed("node", "first")
        rows = open_.join(root, "first", "left").withColumn("root", F.coalesce("label", "first")).select(*[c.split()[0] for c in CURRENT.split(", ")]).checkpoint()
        moved.write.mode("overwrite").parquet(f"{self.path}/moved/run={self.runs}")

        gone = rows.select("first").unionByName(hit.select("first")).distinct().checkpoint()
        kept = lambda old: rows if old is None else old.join(gone, "first", "left_anti").unionByName(rows)
        self.clusters.update(self._buckets(gone), kept, bucket(F.col("first"), self.buckets), {"runs": self.runs + 1, "records": self.size + n, "buckets": self.buckets})
        self.runs, self.size = self.runs + 1, self.size + n
        return self.runs

    def _alike(self, changed: DataFrame, hit: DataFrame) -> DataFrame:
        """(a, version_a, b, version_b) of current clusters whose best names are alike, one of them new or changed; adds the entries of these."""
        rows = changed.where(F.col("version") == self.runs).select(F.col("first").alias("item"), city_block(F.col("city")).alias("block"), match_name(F.col("name")).alias("name")).where("length(name) >= 3 and block is not null").checkpoint()
        names = with_grams(rows, self._order("name_order", rows)).select("item", "block", "grams", "n").checkpoint()
        stored, asking = (x.checkpoint() for x in name_entries(names, FUZZY))
        pairs = candidates(stored, asking.unionByName(self._table("names_asking", stored)), FUZZY, 2).unionByName(candidates(self._table("names_stored", asking), asking, FUZZY, 2)).distinct().checkpoint()
        self._add("names_stored", stored)
        self._add("names_asking", asking)
        own = names.select("item", F.lit(self.runs).alias("version"), "grams", "n")
        self._add("grams", own)
        met = pairs.select(F.col("a").alias("first")).unionByName(pairs.select(F.col("b").alias("first"))).distinct().checkpoint()
        valid = self._current(met).join(hit, "first", "left_anti").select("first", "version").unionByName(changed.select("first", "version")).join(met, "first", "left_semi")
        valid = valid.select(F.col("first").alias("item"), "version").checkpoint()
        grams = self._table("grams", valid).unionByName(own).join(valid, ["item", "version"]).checkpoint()
        version = lambda c: valid.select(F.col("item").alias(c), F.col("version").alias(f"version_{c}"))
        return verified(pairs, grams.select("item", "grams", "n"), FUZZY).join(version("a"), "a").join(version("b"), "b").select("a", "version_a", "b", "version_b").checkpoint()

    @staticmethod
    def _place_keys(new: DataFrame) -> DataFrame:
        """(idx, first, key, name, lat, lon) of the records that have a name and a place; records of equal ones share a key."""
        rows = new.select("idx", "first", F.col("name_key").alias("name"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))
        rows = rows.where("length(name) >= 3 and lat <> 0 and lon <> 0 and not isnan(lat) and not isnan(lon)")
        return rows.withColumn("key", F.concat_ws("|", F.lit("g:"), "lat", "lon", "name")).checkpoint()

    def _near(self, new: DataFrame, fresh: DataFrame, equal: DataFrame, places: DataFrame) -> DataFrame:
        """(a, b) of clusters of exact keys with records that are near and alike, one of them new; adds the new names and places."""
        own = in_cells(places.join(fresh.select("idx"), "idx", "left_semi").select(F.col("idx").alias("item"), "first", "name", "lat", "lon")).checkpoint()
        cells = cells_around(own).checkpoint()
        old = self._table("places", cells).join(cells, ["gx", "gy"], "left_semi")
        there = own.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False))).checkpoint()
        self._add("places", own)
        first = lambda c: there.select(F.col("item").alias(c), F.col("first").alias(f"first_{c}"))
        found = near_names(there, SPATIAL).join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
        of_first = new.select("idx", F.col("first").alias("a"))
        tied = equal.join(of_first, "idx").select("a", "b")
        twins = places.join(fresh.select("key", F.col("first").alias("b")), "key").select(F.col("first").alias("a"), "b")
        return found.unionByName(tied).unionByName(twins).where("a <> b").distinct().checkpoint()


def resolve_runs(spark: SparkSession, runs: Iterable[DataFrame], path: str, buckets: int = 256) -> DataFrame:
    """(record_id, idx, root) after adding the cleaned records of each run to the index at `path`; see RunIndex."""
    index = RunIndex(spark, path, buckets)
    for cleaned in runs:
        index.add(cleaned)
    return index.members()
