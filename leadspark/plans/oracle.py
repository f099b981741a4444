"""DuckDB SQL for the results of the queries, built from expressions of its own over the derived rows."""

from __future__ import annotations

from functools import reduce

from .. import constants as C
from .derived import raw_sql


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lst(xs: list[str]) -> str:
    return "(" + ", ".join(map(q, xs)) + ")"


def case_map(x: str, values: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {other} END"


def rep(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, {q(flags)})"


def collapse(x: str) -> str:
    return f"trim({rep(x, '[ ]+', ' ')})"


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(p[1:1]) || lower(p[2:])), '')"


def std_name(x: str) -> str:
    first = f"trim({rep(collapse(x), '(?s)[ ]*[|-].*$')})"
    cut = reduce(lambda y, c: f"trim({rep(y, ',[ ]*' + c + '$', '', 'gi')})", C.TRAILING_CITIES, first)
    return f"nullif({title(cut)}, '')"


def match_name(x: str) -> str:
    first = rep(f"lower(coalesce({x}, ''))", "(?s)[ ]*[|:-].*$")
    plain = collapse(rep(first, "[^a-z0-9 ]"))
    return "trim(" + reduce(lambda y, s: f"replace({y}, {q(s)}, '')", C.NAME_SUFFIXES, plain) + ")"


def key(x: str) -> str:
    return rep(f"lower(coalesce({x}, ''))", "[^a-z0-9]")


def std_phone(x: str) -> str:
    d = rep(rep(x, "[^0-9]"), "^0+")
    return f"CASE WHEN length({d}) = 12 AND starts_with({d}, '91') THEN '+' || {d} WHEN length({d}) = 10 THEN '+91' || {d} WHEN starts_with({x}, '+') THEN CASE WHEN length({d}) >= 10 THEN '+' || {d} END WHEN length({d}) >= 10 THEN '+91' || right({d}, 10) END"


def std_url(x: str) -> str:
    u = f"CASE WHEN starts_with({x}, 'http://') OR starts_with({x}, 'https://') THEN {x} ELSE 'https://' || {x} END"
    u = f"rtrim({rep(u, '^http://', 'https://', 'i')}, '/')"
    u = rep(rep(rep(u, r"[?&]utm_\w+=[^&]*"), "[?&]ref=[^&]*"), r"\?$")
    return f"CASE WHEN NOT contains(lower({x}), 'bing.com/ck') AND NOT contains(lower({x}), 'google.com/url') THEN {u} END"


def std_address(x: str) -> str:
    return collapse(reduce(lambda y, w: rep(y, rf"\b{w[0]}\b", w[1]), C.ADDRESS_WORDS.items(), f"nullif(trim({x}), '')"))


def std_city(x: str) -> str:
    return case_map(f"lower({x})", C.CITY_ALIASES, title(x))


def std_state(x: str) -> str:
    return case_map(f"upper({x})", C.STATE_CODES, case_map(f"lower({x})", {s.lower(): s for s in C.STATES}, title(x)))


def full(x: str) -> str:
    return f"coalesce({x} <> '', false)"


def num(x: str) -> str:
    return f"coalesce({x} <> 0, false)"


def points(*terms: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in terms)


def domain(x: str) -> str:
    return f"nullif(lower({rep(f'''regexp_extract({x}, '^https://([^/?#]*)', 1)''', '^www[.]')}), '')"


def country(phone: str, city: str, state: str) -> str:
    p, c, s = f"coalesce({phone}, '')", f"lower(coalesce({city}, ''))", f"lower(coalesce({state}, ''))"
    states = lst([x.lower() for x in C.STATES])
    out = f"CASE WHEN starts_with({p}, '+91') OR starts_with({p}, '91') THEN 'India' "
    out += " ".join(f"WHEN starts_with({p}, {q(k)}) THEN {q(v)}" for k, v in C.PHONE_COUNTRIES.items())
    out += f" WHEN {s} IN {states} OR {c} IN {states} THEN 'India' "
    return out + " ".join(f"WHEN {c} IN {lst(v)} THEN {q(k)}" for k, v in C.COUNTRY_CITIES.items()) + " ELSE 'Unknown' END"


_W = C.COMPLETENESS
_DONE = points((full("name"), _W["name"]), (full("phone"), _W["phone"]), (full("address"), _W["address"]), (full("website"), _W["website"]), (full("city"), _W["city"]), (f"{num('latitude')} AND {num('longitude')}", _W["position"]), ("rating IS NOT NULL", _W["rating"]))
_NOTE = lambda f: f"CASE WHEN raw_{f} IS DISTINCT FROM {f} THEN '{f}: ''' || coalesce(raw_{f}, 'None') || ''' -> ''' || coalesce({f}, 'None') || '''' END"
_TEXT = ["name", "phone", "website", "address", "city", "state"]

RAW = f"raw AS MATERIALIZED ({raw_sql()})"
CLEANED = f"""{RAW}, cleaned0 AS MATERIALIZED (
  SELECT id AS record_id, source_adapter, source_record_id, minutes, email, maps_url, industry AS raw_industry, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, CAST(rating AS DOUBLE) AS rating, reviews_count,
    {', '.join(f'{f} AS raw_{f}' for f in _TEXT)}, {std_name('name')} AS name, {std_phone('phone')} AS phone, {std_url('website')} AS website, {std_address('address')} AS address, {std_city('city')} AS city, {std_state('state')} AS state FROM raw
), cleaned AS MATERIALIZED (
  SELECT *, ({_DONE}) / 100.0 AS completeness, row_number() OVER (ORDER BY minutes, record_id) - 1 AS idx,
    list_filter([{', '.join(map(_NOTE, _TEXT))}], lambda x: x IS NOT NULL) AS changes FROM cleaned0
)"""

BIGRAMS = lambda x: f"CASE WHEN length({x}) >= 2 THEN list_distinct(list_transform(range(1, length({x})), lambda i: {x}[i:i + 1])) ELSE [] END"
DICE = lambda a, b, na, nb: f"CASE WHEN {na} = {nb} THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
KM = "6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))"

KEY_EDGES = f"""keyed AS MATERIALIZED (
  SELECT idx, 'p:' || phone AS key FROM (SELECT idx, {std_phone('phone')} AS phone FROM cleaned) WHERE phone IS NOT NULL
  UNION ALL SELECT idx, 'n:' || m || '|' || c FROM (SELECT idx, {match_name('name')} AS m, {key('city')} AS c FROM cleaned) WHERE length(m) >= 3
  UNION ALL SELECT idx, 's:' || source_record_id FROM cleaned WHERE source_record_id <> ''
), exact AS MATERIALIZED (
  SELECT DISTINCT idx AS a, b FROM keyed JOIN (SELECT key, min(idx) AS b FROM keyed GROUP BY key) USING (key) WHERE idx <> b
)"""


def closure(name: str, edges: str) -> str:
    """Least node reached from each node of edges(a, b)."""
    return f"""{name}_both AS MATERIALIZED (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), {name}_reach AS (
  SELECT a, b FROM {name}_both UNION SELECT r.a, e.b FROM {name}_reach r JOIN {name}_both e ON r.b = e.a
), {name} AS MATERIALIZED (SELECT a AS node, least(a, min(b)) AS label FROM {name}_reach GROUP BY a)"""


_FILL = " + ".join(f"CASE WHEN coalesce(trim({f}) <> '', false) THEN 1 ELSE 0 END" for f in ("name", "phone", "address", "website", "city"))
BEST = lambda f: f"arg_max(nullif(trim({f}), ''), CASE WHEN nullif(trim({f}), '') IS NOT NULL THEN ({_FILL}) * 1000000000::BIGINT - idx END)"

CLUSTERS = f"""{CLEANED}, {KEY_EDGES}, {closure('first_', 'exact')}, firsts AS MATERIALIZED (
  SELECT root, {BEST('name')} AS name, {BEST('city')} AS city FROM (SELECT c.*, coalesce(f.label, c.idx) AS root FROM cleaned c LEFT JOIN first_ f ON f.node = c.idx) GROUP BY root
), named AS MATERIALIZED (
  SELECT *, {BIGRAMS('m')} AS g FROM (SELECT root, {match_name('name')} AS m, CASE WHEN {key('city')} = '' THEN '_unknown_' ELSE {key('city')} END AS block FROM firsts) WHERE length(m) >= 3
), fuzzy AS MATERIALIZED (
  SELECT x.root AS a, y.root AS b FROM named x JOIN named y ON x.block = y.block AND x.root < y.root WHERE {DICE('x.g', 'y.g', 'x.m', 'y.m')} >= 0.85
), placed AS MATERIALIZED (
  SELECT *, {BIGRAMS('m')} AS g, CAST(floor(latitude / 0.01) AS BIGINT) AS gx, CAST(floor(longitude / 0.01) AS BIGINT) AS gy
  FROM (SELECT idx, {match_name('name')} AS m, latitude, longitude FROM cleaned WHERE latitude <> 0 AND longitude <> 0) WHERE length(m) >= 3
), near_ AS (
  SELECT x.idx AS a, y.idx AS b, x.m AS xm, y.m AS ym, x.g AS xg, y.g AS yg, pow(sin(radians(y.latitude - x.latitude) / 2), 2) + cos(radians(x.latitude)) * cos(radians(y.latitude)) * pow(sin(radians(y.longitude - x.longitude) / 2), 2) AS h
  FROM placed x JOIN placed y ON x.idx < y.idx AND abs(x.gx - y.gx) <= 1 AND abs(x.gy - y.gy) <= 1
), spatial AS MATERIALIZED (SELECT a, b FROM near_ WHERE {KM} <= 1.0 AND {DICE('xg', 'yg', 'xm', 'ym')} >= 0.70
), every_edge AS MATERIALIZED (SELECT * FROM exact UNION SELECT * FROM fuzzy UNION SELECT * FROM spatial), {closure('final_', 'every_edge')}, assigned AS MATERIALIZED (
  SELECT c.*, coalesce(f.label, c.idx) AS root FROM cleaned c LEFT JOIN final_ f ON f.node = c.idx
), clusters AS MATERIALIZED (
  SELECT root, {', '.join(f'{BEST(f)} AS best_{f}' for f in ('name', 'phone', 'address', 'website', 'city', 'state'))},
    arg_max({{'a': latitude, 'o': longitude}}, CASE WHEN {num('latitude')} AND {num('longitude')} THEN ({points(*[(full(f), 1) for f in ('name', 'phone', 'address', 'website')])}) * 1000000000::BIGINT - idx END) AS place,
    arg_min({{'r': rating, 'n': CASE WHEN reviews_count <> 0 THEN reviews_count END}}, CASE WHEN rating IS NOT NULL THEN idx END) AS rated,
    max(completeness) AS completeness, array_to_string(list_sort(list(DISTINCT source_adapter)), ',') AS source_adapters, arg_min(record_id, idx) AS first_record, count(*) AS size
  FROM assigned GROUP BY root
)"""

_STATUS = "CASE WHEN {0} THEN 'INVALID' WHEN score >= 4 THEN 'VALID' WHEN score >= 2 THEN 'UNKNOWN' ELSE 'INVALID' END"
_HOST = rep("lower(regexp_extract(website, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))", "^www[.]")
_NOISE = " OR ".join(f"coalesce(regexp_matches(trim(lower(name)), {q(p)}), false)" for p in C.NOISE_NAMES)
_EMAIL = f"CASE WHEN NOT {full('trim(email)')} THEN 'NOT_AVAILABLE' WHEN NOT regexp_matches(lower(trim(email)), {q(C.EMAIL)}) THEN 'INVALID' WHEN split_part(lower(trim(email)), '@', 2) IN {lst(C.DISPOSABLE_DOMAINS)} THEN 'INVALID' ELSE 'UNKNOWN' END"
_INFER = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(name), {q(p)}) THEN {q(i)} END" for p, i in C.NAME_INDUSTRIES) + ")"
_KNOWN = " OR ".join(f"starts_with(lower(industry), {q(k)})" for k in C.RECOGNISED_INDUSTRIES)

#: Every cleaned record as a company of its own, and what the later stages make of it.
COMPANIES = f"""{CLEANED}, companies AS MATERIALIZED (
  SELECT md5(record_id) AS company_id, coalesce(name, 'Unknown') AS name, phone, website, address, city, state, {country('phone', 'city', 'state')} AS country, latitude, longitude, rating, reviews_count AS review_count, source_adapter, email AS raw_email, raw_phone, maps_url FROM cleaned
), checks AS MATERIALIZED (
  SELECT company_id, {_EMAIL.replace('email', 'raw_email')} AS email_status,
    CASE WHEN NOT {full('phone')} THEN 'NOT_AVAILABLE' WHEN regexp_matches(phone, '^([+]91)?[0-9]{{10}}$') THEN 'VALID' ELSE 'INVALID' END AS phone_status,
    CASE WHEN NOT {full('website')} THEN 'NOT_AVAILABLE' WHEN {_HOST} = '' THEN 'INVALID' WHEN {_HOST} IN {lst(C.NOISE_DOMAINS)} THEN 'INVALID' ELSE 'VALID' END AS website_status, {_NOISE} AS noise,
    {points(("length(trim(name)) > 1", 1), (full('phone'), 1), (full('address'), 1), (full('city'), 1), (f"{num('latitude')} AND {num('longitude')}", 1), (full('website'), 1))} AS fields_present,
    {points((full('phone'), 2), (full('address'), 1), (full('city'), 1), (f"{num('latitude')} AND {num('longitude')}", 2), (full('website'), 1), ("rating IS NOT NULL", 1), ("true", 1))} AS score FROM companies
), checks2 AS (SELECT *, {_STATUS.format("noise OR fields_present < 2")} AS business_existence_status FROM checks
), validations AS MATERIALIZED (
  SELECT company_id, email_status, phone_status, website_status, business_existence_status,
    CASE WHEN business_existence_status = 'INVALID' THEN 'INVALID' WHEN email_status = 'VALID' OR phone_status = 'VALID' OR website_status = 'VALID' THEN 'VALID' ELSE 'UNKNOWN' END AS overall_status FROM checks2
), enrichments AS MATERIALIZED (
  SELECT company_id, {_INFER} AS industry, CASE WHEN contains(raw_email, '@') THEN lower(trim(raw_email)) END AS email, trim(raw_phone) AS phones, maps_url AS google_maps_url FROM companies
), factors AS (
  SELECT company_id, CASE WHEN NOT {full('industry')} THEN 0.5 WHEN {_KNOWN} THEN 1.0 ELSE 0.7 END AS industry_score, 0.5 AS size_score,
    CASE WHEN {full('city')} AND latitude IS NOT NULL THEN 1.0 WHEN {full('city')} THEN 0.7 WHEN latitude IS NOT NULL THEN 0.5 WHEN {full('address')} THEN 0.3 ELSE 0.0 END AS location_score, 0.5 AS technology_score,
    round_even(({points((full('phone'), 1), (full('website'), 1), (full('email'), 1), (full('address'), 1), ("rating IS NOT NULL", 1), ("review_count IS NOT NULL", 1))}) / 8.0, 2) AS data_quality_score,
    CASE overall_status WHEN 'VALID' THEN 1.0 WHEN 'UNKNOWN' THEN 0.5 ELSE 0.0 END AS validation_score FROM companies JOIN enrichments USING (company_id) JOIN validations USING (company_id)
), scores AS MATERIALIZED (
  SELECT *, round(20 * industry_score + 10 * size_score + 15 * location_score + 10 * technology_score + 25 * data_quality_score + 20 * validation_score, 2) AS total_score FROM factors
)"""
