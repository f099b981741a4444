"""Row filters of a search: does a record fit the location and the category?"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import full, nonzero, strip


def text_of(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def fits_location(r: dict[str, Column], city: str | None, state: str | None) -> Column:
    """Whether the payload columns r fit the city and state searched for; r has name, phone, address, city, state, latitude, longitude, source_url, maps_url and metadata (as text)."""
    if not city and not state:
        return F.lit(True)
    city, state = (city or "").lower().strip(), (state or "").lower().strip()
    here = nonzero(r["latitude"]) & nonzero(r["longitude"])
    empty = ~(full(r["name"]) | full(r["phone"]) | full(r["address"]) | here)
    text = text_of(r["address"], r["city"], r["state"], r["name"], r["source_url"], r["maps_url"], r["metadata"])
    if not city:
        return ~empty & (F.contains(text, F.lit(state)) if state else F.lit(False))
    own = strip(F.lower(r["city"]))
    shared = F.arrays_overlap(F.split(own, r"\s+"), F.array(*[F.lit(w) for w in city.split()]))
    alike = full(own) & (F.contains(own, F.lit(city)) | F.contains(F.lit(city), own) | shared)
    near = F.lit(False)
    if city in C.CITY_POSITIONS:
        lat, lon = C.CITY_POSITIONS[city]
        near = here & (F.sqrt(F.pow(r["latitude"] - lat, 2) + F.pow(r["longitude"] - lon, 2)) < C.LOCATION_RADIUS_DEGREES)
    keep = F.when(empty, False).when(F.contains(text, F.lit(city)), True).when(F.coalesce(alike, F.lit(False)), True)
    if state:
        keep = keep.when(F.contains(text, F.lit(state)), True)
    return keep.when(F.coalesce(near, F.lit(False)), True).when(full(r["city"]), False).otherwise(full(r["address"]) | full(r["phone"]) | here)


def city_positions(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(city, latitude, longitude): the known cities as a dimension, in lower case; `more` adds to them and wins over them."""
    known = spark.createDataFrame([(c, lat, lon, 1) for c, (lat, lon) in C.CITY_POSITIONS.items()], "city string, latitude double, longitude double, late int")
    if more is not None:
        known = known.unionByName(more.select(F.lower("city").alias("city"), "latitude", "longitude", F.lit(0).alias("late")))
    return known.groupBy("city").agg(*[F.min_by(c, "late").alias(c) for c in ("latitude", "longitude")])


def with_position(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """rows with a position: their own if they have one, else their city's from city_positions()."""
    own = nonzero(F.col("latitude")) & nonzero(F.col("longitude"))
    at = cities.select(F.col("city").alias("__city"), F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"))
    out = rows.join(at, F.lower(strip(F.col("city"))) == F.col("__city"), "left")
    return out.withColumns({"latitude": F.when(own, F.col("latitude")).otherwise(F.col("__lat")), "longitude": F.when(own, F.col("longitude")).otherwise(F.col("__lon"))}).drop("__city", "__lat", "__lon")


def forms(word: str) -> list[str]:
    """The word, its singular if it looks like a plural, and plurals if it does not end in s."""
    out = [word]
    if word.endswith("ies") and len(word) > 4:
        out.append(word[:-3] + "y")
    elif word.endswith("es") and len(word) > 3:
        out.append(word[:-2])
    elif word.endswith("s") and not word.endswith("ss") and len(word) > 3:
        out.append(word[:-1])
    return out if word.endswith("s") else [*out, word + "s", word + "es", word + "ies"]


def category_pattern(category: str) -> str | None:
    """One regular expression for all forms of the category's telling words; null if it has none."""
    words = sorted(set(re.findall("[a-z]{3,}", category.lower())) - set(C.GENERIC_CATEGORY_WORDS))
    if not words:
        return None
    every = sorted({f for w in words for f in forms(w)})
    long, short = [f for f in every if len(f) >= 3], [f for f in every if len(f) < 3]
    # a form of three letters or more counts as a run of letters too, a shorter one only as a whole word
    tests = [rf"(?<![a-z])(?:{'|'.join(long)})(?![a-z])"] if long else []
    tests += [rf"(?U)\b(?:{'|'.join(short)})\b"] if short else []
    return "|".join(f"(?:{t})" for t in tests)


def fits_category(name: Column, industry: Column, address: Column, city: Column, category: str | None) -> Column:
    """Whether a record may belong to the category; kept unless something speaks against it."""
    if not category:
        return F.lit(True)
    pattern = category_pattern(category)
    if pattern is None:
        return F.lit(True)
    wanted = category.lower().strip()
    trade = strip(F.lower(F.coalesce(industry, F.lit(""))))
    text = text_of(name, F.when(trade != wanted, industry), address, city)
    name = strip(F.coalesce(name, F.lit("")))
    low = F.lower(name)
    # one pattern each, as long literal arrays make code too large to compile; words are runs of three letters or more
    word = lambda ws: rf"(?<![a-z])(?:{'|'.join(re.escape(w) for w in ws)})(?![a-z])"
    generic = lambda ws: low.rlike("[a-z]{3}") & low.rlike(rf"^(?:[^a-z]|(?<![a-z])[a-z]{{1,2}}(?![a-z])|{word(ws)})*+$")
    conflict = trade.isin(C.INDUSTRY_CONFLICTS.get(wanted, [])) & (trade != "") & (trade != wanted)
    other_trade = low.rlike(word(sorted({w for t, ws in C.TRADE_WORDS.items() if t != wanted for w in ws if " " not in w})))
    stamped = (trade == wanted) & (name != "") & (other_trade | generic(C.GENERIC_NAME_WORDS + C.GENERIC_NAME_WORDS_STAMPED))
    bare = (trade == "") & (name != "") & generic(C.GENERIC_NAME_WORDS)
    return F.when(strip(text) == "", True).when(text.rlike(pattern), True).otherwise(~(conflict | stamped | bare))
