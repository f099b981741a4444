"""Entity resolution: cleaned records to clusters, and clusters to companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_name, compact_phone, country, full, group_key, match_name, nonzero, or_null, standard_phone, strip, url_domain
from .components import components, ensure_checkpoint_dir, star_edges
from .similar import near_and_similar, similar_names

FUZZY, SPATIAL = 0.85, 0.70
TEXT_FIELDS = ["name", "phone", "address", "website", "city", "state"]


def with_index(records: DataFrame, *order: str) -> DataFrame:
    """records with idx, a number that follows the order of the given columns, 0 first.

    Rows are sorted by ranges and counted by range, so that no task sees them all; the
    checkpoint between keeps numbers the same in retries.  Rows of equal order columns follow
    one another in any order.
    """
    ensure_checkpoint_dir(records.sparkSession)
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    rows = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    each = rows.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = each.select("__part", "__first", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__base"))
    out = rows.join(F.broadcast(base), "__part")
    return out.withColumn("idx", F.col("__at") - F.col("__first") + F.col("__base")).drop("__part", "__at", "__first", "__base")


FIRST_FIELDS = ["name", "phone", "address", "website", "city"]


def _fill(fields: list[str]) -> Column:
    return sum((F.when(full(strip(F.col(f))), 1).otherwise(0) for f in fields), F.lit(0))


def best(field: str) -> Column:
    """The trimmed value of the row with most fields filled, the earliest of equals; blanks do not count."""
    value = or_null(strip(F.col(field)))
    return F.max_by(value, F.when(value.isNotNull(), F.struct(F.col("fill"), -F.col("idx"))))


def with_keys(records: DataFrame) -> DataFrame:
    """records with what they are compared by, made once."""
    return records.withColumns({"name_key": match_name(F.col("name")), "city_key": group_key(F.col("city")), "phone_key": standard_phone(F.col("phone"))})


def record_keys(records: DataFrame) -> DataFrame:
    """(idx, key) of with_keys(): phone, name and city, source record id."""
    keys = F.array(
        F.concat(F.lit("p:"), "phone_key"),
        F.when(F.length("name_key") >= 3, F.concat(F.lit("n:"), "name_key", F.lit("|"), "city_key")),
        F.when(full(F.col("source_record_id")), F.concat(F.lit("s:"), F.col("source_record_id"))),
    )
    return records.select("idx", F.explode(F.array_compact(keys)).alias("key"))


def key_edges(records: DataFrame) -> DataFrame:
    """(a, b) between records that share a phone, a name and city, or a source record id."""
    if "name_key" not in records.columns:
        records = with_keys(records)
    return star_edges(record_keys(records))


def labelled(records: DataFrame, edges: DataFrame) -> DataFrame:
    """records with `root`, the least idx of their component."""
    found = components(edges).select(F.col("node").alias("idx"), F.col("label").alias("root_"))
    return records.join(found, "idx", "left").withColumn("root", F.coalesce("root_", "idx")).drop("root_")


def city_block(city: Column) -> Column:
    """The block in which names are compared: a city, or one block for all names without."""
    return F.when(group_key(city) == "", "_unknown_").otherwise(group_key(city))


def assign_clusters(records: DataFrame) -> DataFrame:
    """cleaned records(idx, name, phone, address, website, city, state, latitude, longitude, rating, reviews_count, source_record_id, completeness, ...) with `root`.

    Exact keys make first clusters.  Their best names are compared within the clusters' best city
    (clusters without one form a block of their own), and records by position and name; all
    edges together make the final clusters.
    """
    ensure_checkpoint_dir(records.sparkSession)
    records = with_keys(records).checkpoint()
    exact = key_edges(records).checkpoint()
    first = labelled(records.withColumn("fill", _fill(FIRST_FIELDS)), exact)
    of = first.groupBy("root").agg(best("name").alias("name"), best("city").alias("city"))
    fuzzy = similar_names(of.select(F.col("root").alias("item"), city_block(F.col("city")).alias("block"), match_name(F.col("name")).alias("name")), FUZZY)
    spatial = near_and_similar(records.select(F.col("idx").alias("item"), F.col("name_key").alias("name"), "latitude", "longitude"), SPATIAL)
    return labelled(records, exact.unionByName(fuzzy).unionByName(spatial)).drop("name_key", "city_key", "phone_key")


def clusters(assigned: DataFrame) -> DataFrame:
    """One row for each root of assign_clusters(), with the best value of each field, its first record and its size.

    Who belongs to a cluster is members(), a row for each record, as a cluster may be of any size.
    """
    rows = assigned.withColumn("fill", _fill(FIRST_FIELDS))
    some = sum((F.when(full(F.col(f)), 1).otherwise(0) for f in ("name", "phone", "address", "website")), F.lit(0))
    here = nonzero(F.col("latitude")) & nonzero(F.col("longitude"))
    place = F.max_by(F.struct("latitude", "longitude"), F.when(here, F.struct(some, -F.col("idx"))))
    reviews = F.when(F.col("reviews_count") != 0, F.col("reviews_count"))
    rated = F.min_by(F.struct("rating", reviews.alias("reviews")), F.when(F.col("rating").isNotNull(), F.col("idx")))
    out = rows.groupBy("root").agg(
        *[best(f).alias(f"best_{f}") for f in TEXT_FIELDS],
        place.alias("place"), rated.alias("rated"), F.max("completeness").alias("completeness"),
        F.array_sort(F.collect_set("source_adapter")).alias("source_adapters"), F.min_by("record_id", "idx").alias("first_record"), F.count("*").alias("size"),
    )
    out = out.select("root", *[f"best_{f}" for f in TEXT_FIELDS], F.col("place.latitude").alias("latitude"), F.col("place.longitude").alias("longitude"), F.col("rated.rating").alias("rating"), F.col("rated.reviews").alias("review_count"), "completeness", "source_adapters", "first_record", "size")
    return with_index(out, "root").withColumnRenamed("idx", "entity_no").withColumn("entity_id", F.concat(F.lit("entity_"), F.col("entity_no").cast("string")))


def members(assigned: DataFrame) -> DataFrame:
    """(root, record_id, idx, duplicate): the records of each cluster; all but its first are duplicates of that one."""
    return assigned.select("root", "record_id", "idx", (F.col("idx") != F.col("root")).alias("duplicate"))


def company_key(key: tuple[str, ...] = ("name",)) -> Column:
    """The id of a company with the columns of its key."""
    return F.md5(F.concat_ws("|", *[F.lower(strip(F.coalesce(F.col(k), F.lit("")))) for k in key]))


def company_name(best_name: Column) -> Column:
    """What a company is called whose cluster's best name is given."""
    return strip(F.coalesce(or_null(best_name), F.lit("Unknown")))


def upsert_companies(found: DataFrame, existing: DataFrame | None = None, key: tuple[str, ...] = ("name",)) -> tuple[DataFrame, DataFrame]:
    """(companies, links) from clusters() and the companies so far.

    Clusters whose best names are equal but for case are one company, whatever their city
    (key=("name", "city") keeps cities apart).  The earliest row decides name, domain, country and
    completeness; other fields take the first value that is there, existing companies first.
    links has root and company_id, a hash of the key.  `existing` has the columns of the result.
    """
    name = company_name(F.col("best_name"))
    fields = ["phone", "website", "address", "city", "state", "latitude", "longitude", "rating", "review_count"]
    new = found.select(
        "root", name.alias("name"), url_domain(F.col("best_website")).alias("domain"), country(F.col("best_phone"), F.col("best_city"), F.col("best_state")).alias("country"), F.col("completeness").alias("completeness_score"),
        *[F.col(f"best_{f}").alias(f) for f in ("phone", "website", "address", "city", "state")], "latitude", "longitude", "rating", "review_count",
        F.struct(F.lit(1).alias("late"), F.col("root").alias("at")).alias("turn"),
    )
    if existing is not None:
        old = existing.select(F.lit(None).cast("long").alias("root"), "name", "domain", "country", "completeness_score", *fields, F.struct(F.lit(0).alias("late"), F.xxhash64("company_id").alias("at")).alias("turn"))
        new = new.unionByName(old)
    new = new.withColumn("company_id", company_key(key))
    truthy = lambda f: full(F.col(f)) if f in ("phone", "website", "address", "city", "state") else nonzero(F.col(f))
    first = lambda f: F.min_by(F.col(f), F.col("turn")).alias(f)
    companies = new.groupBy("company_id").agg(*[first(f) for f in ("name", "domain", "country", "completeness_score")], *[F.min_by(F.col(f), F.when(truthy(f), F.col("turn"))).alias(f) for f in fields])
    return companies, new.where("root is not null").select("root", "company_id")


def entity_key(name: Column, phone: Column, website: Column, payload: Column) -> Column:
    """A one-column identity: phone of eight digits or more, name with domain, name, or the payload's digest."""
    p, n = compact_phone(phone), compact_name(name)
    host = F.regexp_extract(strip(F.lower(F.coalesce(website, F.lit("")))), r"https?://(?:www\.)?([^/]+)", 1)
    d = F.regexp_replace(host, "[^a-z0-9]", "")
    return F.when(F.length(p) >= 8, F.concat(F.lit("phone:"), p)).when((n != "") & (d != ""), F.concat(F.lit("name:"), n, F.lit("|domain:"), d)).when(n != "", F.concat(F.lit("name:"), n)).otherwise(F.md5(payload))


def same_entity(a: dict[str, Column], b: dict[str, Column], radius: float = 0.0005) -> Column:
    """Whether two records are one business: equal phones, a name within the other, equal domains, or near and alike in letters."""
    pa, pb = compact_phone(a["phone"]), compact_phone(b["phone"])
    na, nb = compact_name(a["name"]), compact_name(b["name"])
    host = lambda w: F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(w, F.lit(""))), r"https?://(?:www\.)?([^/]+)", 1), "[^a-z0-9]", "")
    da, db = host(a["website"]), host(b["website"])
    letters = lambda n: F.array_distinct(F.split(n, ""))
    alike = F.size(F.array_intersect(letters(na), letters(nb))) / F.greatest(F.size(letters(na)), F.lit(1)) > 0.5
    there = nonzero(a["latitude"]) & nonzero(a["longitude"]) & nonzero(b["latitude"]) & nonzero(b["longitude"])
    near = F.sqrt(F.pow(a["latitude"] - b["latitude"], 2) + F.pow(a["longitude"] - b["longitude"], 2)) < radius
    named = (na != "") & (nb != "")
    return ((pa != "") & (pa == pb)) | (named & (F.contains(na, nb) | F.contains(nb, na))) | ((da != "") & (da == db)) | F.coalesce(there & near & named & alike, F.lit(False))


def merge_records(records: DataFrame, key: str = "key") -> DataFrame:
    """One row for each key of records(key, idx, source, payload fields): the first value that is there, with where it came from.

    rating and reviews_count take the largest value; `sources` lists all sources, sorted.
    """
    texts = ["name", "address", "phone", "website", "email", "industry", "opening_hours", "city", "state", "pin_code", "maps_url", "source_url"]
    numbers, largest = ["latitude", "longitude"], ["rating", "reviews_count"]
    there = {f: full(F.col(f)) for f in texts} | {f: nonzero(F.col(f)) for f in numbers + largest}
    early = {f: F.when(ok, F.col("idx")) for f, ok in there.items()}
    late = {f: F.when(there[f], F.struct(F.col(f), -F.col("idx"))) for f in largest}
    pick = [F.min_by(F.col(f), early[f]).alias(f) for f in texts + numbers] + [F.max_by(F.col(f), late[f]).alias(f) for f in largest]
    origin = [F.min_by("source", early[f]) for f in texts + numbers] + [F.max_by("source", late[f]) for f in largest]
    pairs = F.create_map(*[x for f, o in zip(texts + numbers + largest, origin, strict=True) for x in (F.lit(f), o)])
    out = records.groupBy(key).agg(*pick, F.array_sort(F.collect_set("source")).alias("sources"), pairs.alias("field_sources"))
    return out.withColumn("field_sources", F.map_filter("field_sources", lambda k, v: v.isNotNull()))


def first_seen(records: DataFrame, key: Column, order: str = "seq") -> DataFrame:
    """The earliest row of each key; rows with a null key go."""
    w = Window.partitionBy("__key").orderBy(order)
    return records.withColumn("__key", key).where("__key is not null").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__key")
