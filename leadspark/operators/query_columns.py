"""Reading of a column of search texts: the rules of query_text, as Columns, for logs of many searches.

Each function takes a text Column and gives what its namesake in query_text gives for one text, in
built-in expressions.  A null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import or_null, strip


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(x: Column) -> Column:
    return F.filter(F.split(strip(x), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _cut(x: Column, prepositions: list[str], before: bool) -> Column:
    """What stands before, or after, the first preposition in list order that occurs; null if none does.  After it something must stand."""
    found = F.lit(None).cast("string")
    for p in reversed(prepositions):
        at = F.instr(F.lower(x), p)
        after = strip(F.substr(x, at + len(p)))
        hit = (at > 0) if before else (at > 0) & (after != "")
        found = F.when(hit, strip(F.substr(x, F.lit(1), at - 1)) if before else after).otherwise(found)
    return found


def split_category(x: Column) -> Column:
    """The category by a preposition or else a dash, or the whole text."""
    first = F.regexp_extract(x, r"(?iU)^(.+?)\s+(?:in|near|around|at|of)\s+(.+)$", 1)
    second = F.regexp_extract(x, r"(?U)^(.+?)\s*-\s*(.+)$", 1)
    return strip(F.when(first != "", first).when(second != "", second).otherwise(x))


def split_location(x: Column, location: Column | None = None) -> Column:
    """The location by a preposition or else a dash, or an empty text; one given apart wins."""
    first = F.regexp_extract(x, r"(?iU)^(.+?)\s+(?:in|near|around|at|of)\s+(.+)$", 2)
    second = F.regexp_extract(x, r"(?U)^(.+?)\s*-\s*(.+)$", 2)
    own = F.when(first != "", strip(first)).otherwise(strip(second))
    return own if location is None else F.coalesce(F.when(location != "", strip(location)), own)


def _city(words: Column) -> Column:
    """struct(lo, hi) of the words that are a known city: the shortest city at the end, or else the shortest at the start."""
    n = F.size(words)
    spans = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct((n - k).alias("lo"), n.alias("hi")))
    starts = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(F.lit(0).alias("lo"), k.alias("hi")))
    text = lambda s: F.lower(F.array_join(F.slice(words, s["lo"] + 1, s["hi"] - s["lo"]), " "))
    found = F.get(F.filter(F.concat(spans, starts), lambda s: text(s).isin(list(C.CITY_POSITIONS))), F.lit(0))
    return F.when(n >= 2, found)


def location_of(x: Column) -> Column:
    """What follows a comma, or a preposition, or is a known city at either end; null if nothing is."""

    def read(q: Column) -> Column:
        comma = F.instr(q, ",")
        listed = F.regexp_replace(strip(F.substr(q, comma + 1)), "[.;:]+$", "")
        placed = F.regexp_replace(_cut(q, C.RICH_PREPOSITIONS, before=False), "[.,;:]+$", "")
        city = _let(_words(q), lambda w: _let(_city(w), lambda s: F.when(s.isNotNull(), F.array_join(F.slice(w, s["lo"] + 1, s["hi"] - s["lo"]), " "))))
        return F.when((comma > 0) & (F.length(listed) > 1), listed).otherwise(F.coalesce(placed, city))

    return _let(strip(x), read)


def category_of(x: Column) -> Column:
    """What precedes a comma, or a preposition, or is left without a known city at either end."""

    def read(q: Column) -> Column:
        comma = F.instr(q, ",")
        listed = strip(F.substr(q, F.lit(1), comma - 1))
        rest = lambda w, s: F.array_join(F.concat(F.slice(w, F.lit(1), s["lo"]), F.slice(w, s["hi"] + 1, F.size(w))), " ")
        bare = _let(_words(q), lambda w: _let(_city(w), lambda s: F.when(s.isNotNull(), rest(w, s))))
        return F.when((comma > 0) & (listed != ""), listed).otherwise(F.coalesce(_cut(q, C.RICH_PREPOSITIONS, before=True), bare, q))

    return _let(strip(x), read)


def qualifiers_of(category: Column) -> Column:
    """The qualifying words, by list of patterns and then by place, each once."""
    found = [F.regexp_extract_all(F.lower(category), F.lit(f"(?U){p}"), F.lit(1)) for p in C.QUALIFIERS]
    return F.array_distinct(F.flatten(F.array(*found)))


def bare_category(category: Column) -> Column:
    """The category up to a preposition, without trailing one-word states."""
    before = lambda p: lambda c: F.when(F.instr(F.lower(c), p) > 0, strip(F.substr(c, F.lit(1), F.instr(F.lower(c), p) - 1))).otherwise(c)
    cat = strip(category)
    for p in C.RICH_PREPOSITIONS:
        cat = _let(cat, before(p))
    states = [s.lower() for s in C.STATES]

    def without(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(~F.lower(w).isin(states), i + 1).otherwise(0)), lambda i: i > 0)
        return F.array_join(F.slice(words, F.lit(1), F.coalesce(F.array_max(places), F.lit(0))), " ")

    return _let(_words(cat), without)


def _distinct_by_lower(texts: Column) -> Column:
    """The trimmed non-empty texts, of those that are equal but for case the first."""
    kept = F.filter(F.transform(texts, strip), lambda t: F.coalesce(t != "", F.lit(False)))
    low = lambda a: F.transform(a, lambda t: F.lower(t))
    return _let(kept, lambda a: F.filter(a, lambda t, i: F.array_position(low(a), F.lower(t)) == i + 1))


def variations(category: Column, location: Column) -> Column:
    """The ways to search for a category at a place, with the singular or plural of its first word."""
    place = lambda *parts: F.when(location != "", F.concat(*parts))
    placed = F.array(place(category, F.lit(" in "), location), place(category, F.lit(" "), location), place(location, F.lit(" "), category), category)
    first = F.get(_words(category), F.lit(0))
    one = F.when((F.length(first) > 3) & ~first.endswith("ss"), F.substr(first, F.lit(1), F.length(first) - 1))
    other = F.when(first.endswith("s"), one).otherwise(F.concat(first, F.lit("s")))
    lower = first.rlike(r"^\p{Ll}") & (F.length(first) > 2)
    at = F.instr(category, first)
    swapped = F.when(lower & other.isNotNull(), F.concat(F.substr(category, F.lit(1), at - 1), other, F.substr(category, at + F.length(first))))
    return _distinct_by_lower(F.array_append(placed, swapped))


def scopes(location: Column) -> Column:
    """The location whole, its city, and its city with the next part, at most three and each once; one empty text without a location."""

    def read(raw: Column) -> Column:
        parts = F.transform(F.split(raw, ","), strip)
        second = F.get(parts, F.lit(1))
        more = F.when(second != "", F.concat(F.get(parts, F.lit(0)), F.lit(" "), second))
        return F.array_distinct(F.array_compact(F.array(raw, F.get(parts, F.lit(0)), more)))

    return _let(F.coalesce(strip(location), F.lit("")), lambda raw: F.when(raw == "", F.array(F.lit(""))).otherwise(read(raw)))


def interpret(x: Column, location: Column | None = None) -> Column:
    """struct(text, category, location, qualifiers, variations, scopes) of a search text."""

    def read(text: Column) -> Column:
        where = location_of(text) if location is None else F.coalesce(or_null(location), location_of(text))
        raw = category_of(text)
        found = lambda s: variations(s["category"], F.coalesce(s["where"], F.lit("")))
        every = lambda s: F.when(F.exists(found(s), lambda v: F.lower(v) == F.lower(text)), found(s)).otherwise(F.concat(F.array(text), found(s)))
        basis = F.struct(bare_category(raw).alias("category"), where.alias("where"), qualifiers_of(raw).alias("qualifiers"))
        return _let(basis, lambda s: F.struct(text.alias("text"), s["category"].alias("category"), s["where"].alias("location"), s["qualifiers"].alias("qualifiers"), every(s).alias("variations"), scopes(s["where"]).alias("scopes")))

    return _let(strip(x), read)


def either_case(pattern: Column) -> Column:
    """A pattern that matches letters in either case; the s of a word of more than three letters may be absent at its end."""
    marked = F.regexp_replace(pattern, r"(?<!\p{L})(\p{L}{3,}s)(?!\p{L})", "$1\u0000")
    each = F.transform(F.split(marked, ""), lambda c: F.when(c.rlike(r"^\p{L}$"), F.concat(F.lit("["), F.upper(c), F.lower(c), F.lit("]"))).when(c == "\u0000", "?").otherwise(c))
    return F.array_join(each, "")


def name_group(query: Column) -> Column:
    """The search, up to a preposition, in lower case: what a name is looked up by."""
    low = strip(F.lower(query))
    return F.coalesce(_cut(low, [" in ", " near ", " around ", " at ", " of "], before=True), low)
