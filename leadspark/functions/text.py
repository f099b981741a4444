"""Cleaning and matching of names, phones, URLs and addresses, as Columns.

Everything is built in, but for Unicode NFKC, which has no built-in form: only rows
with a character beyond ASCII go to its Arrow UDF.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import constants as C


def lit_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def alternatives(texts: list[str]) -> str:
    """A pattern for any of the texts; one such test compiles to far less code than a test for each."""
    return "|".join(dict.fromkeys(re.escape(t) for t in texts))


def full(x: Column) -> Column:
    """Whether a string is neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def nonzero(x: Column) -> Column:
    """Whether a number is neither null nor zero."""
    return F.coalesce(x != 0, F.lit(False))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(x: Column) -> Column:
    """Runs of any white space become one space, none at the ends."""
    return F.btrim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def with_normal_form(rows: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """rows with the NFKC form of each text under its new name.

    Rows without a character beyond ASCII are in this form already and pass by; the others
    form a branch of their own that alone goes to Python, all texts in one call.
    """
    names = list(texts)

    @F.pandas_udf(StructType([StructField(n, StringType()) for n in names]))  # a type object, as parsing a name needs a session
    def normal(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({n: x.astype(object).where(x.isna(), x.str.normalize("NFKC")) for n, x in zip(names, columns, strict=True)})

    beyond = reduce(lambda a, b: a | b, (F.coalesce(x.rlike(r"[^\x00-\x7F]"), F.lit(False)) for x in texts.values()))
    plain = rows.where(~beyond).withColumns(texts)
    other = rows.where(beyond).withColumn("__nfkc", normal(*texts.values())).select("*", *[F.col("__nfkc")[n].alias(n) for n in names]).drop("__nfkc")
    return plain.unionByName(other)


def title(x: Column) -> Column:
    """Each run of cased letters starts with a capital; what follows an apostrophe or digit starts a run."""
    parts = F.regexp_extract_all(x, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def trailing_cities() -> str:
    """One pattern for a tail of cities that removing each listed city in turn, once, would take off.

    Going back from the end of a name, such a tail names cities in list order.
    """
    return "(?i)" + "".join(rf"(?:,\s*{c}\s*)?" for c in reversed(C.TRAILING_CITIES)) + "$"


def standard_name(name: Column) -> Column:
    """Of a name in its normal form, see with_normal_form()."""
    first = strip(F.regexp_replace(collapse(strip(name)), r"(?s)\s*[|\-].*$", ""))
    return or_null(title(strip(F.regexp_replace(first, trailing_cities(), ""))))


def match_name(name: Column) -> Column:
    """The key that names are compared by; empty for a null name."""
    first = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?sU)\s*[|\-:].*$", "")
    plain = collapse(F.regexp_replace(first, r"(?U)[^a-z0-9\s]", ""))
    return F.btrim(reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), C.NAME_SUFFIXES, plain))


def group_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def standard_phone(phone: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(phone, r"(?U)\D", ""), "^0+", "")
    n = F.length(digits)
    return (
        F.when((n == 12) & digits.startswith("91"), F.concat(F.lit("+"), digits))
        .when(n == 10, F.concat(F.lit("+91"), digits))
        .when(phone.startswith("+"), F.when(n >= 10, F.concat(F.lit("+"), digits)))
        .when(n >= 10, F.concat(F.lit("+91"), F.right(digits, F.lit(10))))
    )


def display_phone(phone: Column) -> Column:
    return F.concat(F.lit("0"), F.right(standard_phone(phone), F.lit(10)))


def standard_url(url: Column) -> Column:
    url = or_null(strip(url))
    low = F.lower(url)
    with_scheme = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))
    out = F.rtrim(F.regexp_replace(with_scheme, "(?i)^http://", "https://"), F.lit("/"))
    out = F.regexp_replace(out, r"(?U)[?&]utm_\w+=[^&]*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[?&]ref=[^&]*", ""), r"\?$", "")
    return F.when(~(F.contains(low, F.lit("bing.com/ck")) | F.contains(low, F.lit("google.com/url"))), out)


def standard_state(state: Column) -> Column:
    state = or_null(strip(state))
    known = lit_map({s.lower(): s for s in C.STATES})
    return F.coalesce(F.try_element_at(lit_map(C.STATE_CODES), F.upper(state)), F.try_element_at(known, F.lower(state)), title(state))


def standard_address(address: Column) -> Column:
    """Of an address in its normal form, see with_normal_form()."""
    words = reduce(lambda x, w: F.regexp_replace(x, rf"(?U)\b{w[0]}\b", w[1]), C.ADDRESS_WORDS.items(), or_null(strip(address)))
    return collapse(words)


def standard_city(city: Column) -> Column:
    city = or_null(strip(city))
    return F.coalesce(F.try_element_at(lit_map(C.CITY_ALIASES), F.lower(city)), title(city))


def completeness(name: Column, phone: Column, address: Column, website: Column, city: Column, latitude: Column, longitude: Column, rating: Column) -> Column:
    has = {"name": full(name), "phone": full(phone), "address": full(address), "website": full(website), "city": full(city), "position": nonzero(latitude) & nonzero(longitude), "rating": rating.isNotNull()}
    points = reduce(lambda a, b: a + b, (F.when(has[k], w).otherwise(0) for k, w in C.COMPLETENESS.items()))
    return points / F.lit(100.0)


def payload_completeness(present: list[Column]) -> Column:
    """Per cent of the given payload fields that are there, to one decimal; a zero counts as there."""
    n = reduce(lambda a, b: a + b, (F.when(p, 1).otherwise(0) for p in present))
    return F.bround(n / F.lit(float(len(present))) * 100, 1)


def url_host(url: Column) -> Column:
    """The part of a URL between // and the next slash, or else its path."""
    scheme = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
    host = F.regexp_extract(url, scheme + r"//([^/?#]*)", 1)
    return F.when(host != "", host).otherwise(F.regexp_extract(url, scheme + r"(?://)?([^?#]*)", 1))


def url_domain(url: Column) -> Column:
    return or_null(F.lower(F.regexp_replace(url_host(or_null(url)), r"^www\.", "")))


def country(phone: Column, city: Column, state: Column) -> Column:
    phone, city, state = F.coalesce(strip(phone), F.lit("")), F.lower(F.coalesce(city, F.lit(""))), F.lower(F.coalesce(state, F.lit("")))
    states = [s.lower() for s in C.STATES]
    out = F.when(phone.startswith("+91") | phone.startswith("91"), "India")
    for prefix, name in C.PHONE_COUNTRIES.items():
        out = out.when(phone.startswith(prefix), name)
    out = out.when(state.isin(states) | city.isin(states), "India")
    for name, cities in C.COUNTRY_CITIES.items():
        out = out.when(city.isin(cities), name)
    return out.otherwise("Unknown")


def address_parts(address: Column) -> Column:
    """struct(city, state, pin_code) read from a comma-separated address."""
    address = F.coalesce(address, F.lit(""))
    parts = F.transform(F.split(address, ","), strip)
    states = [s.lower() for s in C.STATES]
    last = F.element_at(parts, -1)
    word = lambda p: p.rlike(r"^[A-Za-z\s]+$") & (F.length(p) > 2) & ~F.lower(strip(p)).isin(states)
    second = F.try_element_at(parts, F.lit(-2))
    other = F.get(F.filter(F.reverse(parts), lambda p: word(p) & (F.lower(p) != "india")), F.lit(0))
    return F.struct(
        F.when(F.coalesce(word(second), F.lit(False)), second).otherwise(other).alias("city"),
        F.when((F.size(parts) > 1) & F.lower(last).isin(states), last).alias("state"),
        or_null(F.regexp_extract(address, r"(?U)\b(\d{6})\b", 1)).alias("pin_code"),
    )


def phones_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?:\+?\d{1,4}[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}"), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.regexp_replace(p, "[^0-9+]", "")), lambda p: F.length(p) >= 10)


def directory_name(name: Column) -> Column:
    """A listing name without what a directory appends to it; empty if little is left."""
    out = strip(F.regexp_replace(name, r"(?i)\s*[-–|]\s*(?:JustDial|India|list|directory).*$", ""))
    return F.when(F.length(out) > 2, out).otherwise("")


def snippet_name(title_: Column) -> Column:
    """The business name in a search result's title, or null for lists, articles and the like."""
    name = strip(title_)
    low = F.lower(name)
    bad = low.rlike(f"^(?:{alternatives(C.SKIP_PREFIXES)})|{alternatives(C.SKIP_PHRASES + C.SKIP_WORDS)}")
    out = strip(F.regexp_replace(name, r"(?i)\s*[-–|]\s*(?:India|list|directory|contact|guide|article).*$", ""))
    return F.when(~bad & F.length(name).between(3, 100) & (F.length(out) > 2), out)


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def key_hint(secret: Column) -> Column:
    return F.concat(F.lit("****"), F.right(secret, F.lit(4)))


def compact_phone(phone: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")
    return F.when(digits.startswith("91") & (F.length(digits) > 10), F.substr(digits, F.lit(3))).otherwise(digits)


def compact_name(name: Column) -> Column:
    n = group_key(name)
    out = F.when(F.lit(False), n)
    for s in C.BUSINESS_ENDINGS:
        out = out.when(n.endswith(s), F.substring(n, F.lit(1), F.length(n) - len(s)))
    return out.otherwise(n)


def listing_key(name: Column, phone: Column) -> Column:
    """The key that one source's listings are made distinct by."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")
    return F.md5(F.when(F.length(digits) >= 8, F.concat(F.lit("p:"), digits)).otherwise(F.concat(F.lit("n:"), group_key(name))))


def source_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.md5(joined), 1, 16))


def listing_fields(text: Column, href: Column) -> Column:
    """struct of what a map listing's lines and link say: rating, reviews_count, category, address, phone, opening_hours, position."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    number = F.filter(lines, lambda x: x.rlike(r"^[\d.]+$"))
    rest = F.filter(lines, lambda x: ~x.rlike(r"^[\d.]+$"))
    dotted = F.transform(F.filter(rest, lambda x: x.rlike("[·•⋅]")), lambda x: F.filter(F.transform(F.split(x, r"\s*[·•⋅]\s*"), strip), lambda p: F.length(p) > 1))
    is_hours = lambda p: F.lower(p).rlike("open|close")
    timed = F.filter(dotted, lambda ps: F.exists(ps, is_hours))
    plain = F.get(F.filter(dotted, lambda ps: ~F.exists(ps, is_hours) & (F.size(ps) > 0)), F.lit(0))
    hours_parts = F.flatten(timed)
    dotted_phone = F.filter(hours_parts, lambda p: ~is_hours(p) & p.rlike(r"^[\d\s\-+()]{7,}$"))
    bare_phone = F.filter(rest, lambda x: ~x.rlike("[·•⋅]") & x.rlike(r"^\+?\d[\d\s\-()]{6,}$"))
    address = F.array_join(F.filter(F.slice(plain, 2, 1000), lambda p: ~p.rlike(r"^[\s\d\W]+$")), ", ")
    reviews = F.filter(lines, lambda x: x.rlike(r"^[\d,]+\s*[Rr]eview"))
    at = r"!3d([-\d.]+)!4d([-\d.]+)"
    return F.struct(
        F.get(F.reverse(number), F.lit(0)).try_cast("double").alias("rating"),
        F.replace(F.regexp_extract(F.get(reviews, F.lit(0)), r"^([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("int").alias("reviews_count"),
        F.when(F.length(F.get(plain, F.lit(0))) < 50, F.get(plain, F.lit(0))).alias("category"),
        or_null(strip(F.regexp_replace(address, r"(?U)^[^\w\d]+", ""))).alias("address"),
        F.coalesce(F.get(F.reverse(dotted_phone), F.lit(0)), F.get(bare_phone, F.lit(0))).alias("phone"),
        F.get(F.reverse(F.filter(hours_parts, is_hours)), F.lit(0)).alias("opening_hours"),
        F.regexp_extract(href, at, 1).try_cast("double").alias("latitude"),
        F.regexp_extract(href, at, 2).try_cast("double").alias("longitude"),
    )
