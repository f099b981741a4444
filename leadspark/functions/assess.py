"""Validation statuses, enrichment from names and pages, and score factors, as Columns."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import alternatives, collapse, full, nonzero, or_null, strip

VALID, INVALID, UNKNOWN, NOT_AVAILABLE = "VALID", "INVALID", "UNKNOWN", "NOT_AVAILABLE"


def email_domain(email: Column) -> Column:
    return F.split(F.lower(strip(email)), "@")[1]


def email_status(email: Column, has_mx: Column) -> Column:
    """has_mx says whether the domain has a mail server; null where nobody looked."""
    e = F.lower(strip(email))
    return (
        F.when(~full(e), NOT_AVAILABLE)
        .when(~e.rlike(C.EMAIL), INVALID)
        .when(F.get(F.split(e, "@"), F.lit(1)).isin(C.DISPOSABLE_DOMAINS), INVALID)
        .when(has_mx, VALID)
        .when(~has_mx, INVALID)
        .otherwise(UNKNOWN)
    )


def phone_status(phone: Column) -> Column:
    p = strip(phone)
    return F.when(~full(p), NOT_AVAILABLE).when(p.rlike(r"(?U)^(\+91)?\d{10}$"), VALID).otherwise(INVALID)


def website_host(website: Column) -> Column:
    """The lower-case host with port, without www.; empty if the URL has no scheme or host."""
    host = F.regexp_extract(strip(website), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def website_status(website: Column, resolves: Column, unknown: str = VALID) -> Column:
    """resolves says whether the host has an address; `unknown` is the status where nobody looked."""
    w = strip(website)
    low = F.lower(w)
    return (
        F.when(~full(w), NOT_AVAILABLE)
        .when(F.regexp_extract(w, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1) == "", INVALID)
        .when(website_host(w).isin(C.NOISE_DOMAINS), INVALID)
        .when(F.contains(low, F.lit("bing.com/ck")) | F.contains(low, F.lit("google.com/url")), INVALID)
        .when(resolves, VALID)
        .when(~resolves, INVALID)
        .otherwise(unknown)
    )


def points(*terms: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n in terms))


def existence(name: Column, phone: Column, address: Column, city: Column, latitude: Column, longitude: Column, website: Column, rating: Column, adapters: Column) -> Column:
    """struct(status, score, fields_present) of how much speaks for a real business."""
    low = strip(F.lower(name))
    noise = full(name) & low.rlike("|".join(C.NOISE_NAMES))
    position = nonzero(latitude) & nonzero(longitude)
    named = F.coalesce(F.length(strip(name)) > 1, F.lit(False))
    fields = points((named, 1), (full(phone), 1), (full(address), 1), (full(city), 1), (position, 1), (full(website), 1))
    known = F.size(F.array_except(F.coalesce(adapters, F.array().cast("array<string>")), F.array(F.lit("unknown"))))
    score = points((full(phone), 2), (full(address), 1), (full(city), 1), (position, 2), (full(website), 1), (rating.isNotNull(), 1), (known == 1, 1), (known >= 2, 3))
    status = F.when(noise | (fields < 2), INVALID).when(score >= 4, VALID).when(score >= 2, UNKNOWN).otherwise(INVALID)
    return F.struct(status.alias("status"), score.alias("score"), fields.alias("fields_present"))


def overall_status(email: Column, phone: Column, website: Column, exists: Column) -> Column:
    some = (email == VALID) | (phone == VALID) | (website == VALID)
    return F.when(exists == INVALID, INVALID).when(some, VALID).otherwise(UNKNOWN)


def by_label(pairs: list[tuple[str, str]]) -> list[tuple[list[str], str]]:
    """Neighbours of one label together, in order: the first hit has the same label, with fewer tests."""
    return [([p for p, _ in group], label) for label, group in groupby(pairs, key=lambda x: x[1])]


def industry_of_name(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike("(?iu)" + "|".join(f"(?:{p})" for p in ps)), industry) for ps, industry in by_label(C.NAME_INDUSTRIES)])


def first_match(text: Column, pattern: str, group: int) -> Column:
    return or_null(F.regexp_extract(text, pattern, group))


def page_facts(html: Column) -> Column:
    """struct of title, description, social_links, founded_year, company_size, email and industry of a page's HTML.

    Tags are read by patterns.  Text for years and sizes is what remains of the first 5000
    characters once tags, scripts and styles are gone.
    """
    page_title = collapse(first_match(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    meta = lambda name: or_null(collapse(F.coalesce(first_match(html, rf"(?i)<meta\s+name=[\"']{name}[\"']\s+content=[\"']([^\"']+)", 1), first_match(html, rf"(?i)<meta\s+content=[\"']([^\"']+)[\"']\s+name=[\"']{name}[\"']", 1))))
    about = first_match(html, r"(?is)<(?:div|section|p|article)[^>]*(?:id=[\"']about(?:-us)?[\"']|class=[\"'][^\"']*about[^\"']*[\"'])[^>]*>(.*?)</(?:div|section|p|article)>", 1)
    bare = lambda x: collapse(F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " "))
    body = F.substring(bare(html), 1, 5000)
    link = lambda p: F.regexp_replace(first_match(html, f"(?i){p}", 0), r"[/]+$", "")
    socials = F.map_filter(F.create_map(*[x for k, p in C.SOCIAL_LINKS.items() for x in (F.lit(k), link(p))]), lambda k, v: v.isNotNull())
    year = lambda p: F.when(first_match(body, f"(?i){p}", 1).cast("int").between(1900, 2026), first_match(body, f"(?i){p}", 1))
    noise = lambda e: F.lower(e).rlike(alternatives(C.PAGE_EMAIL_NOISE))
    emails = F.filter(F.regexp_extract_all(html, F.lit(C.PAGE_EMAIL), F.lit(0)), lambda e: ~noise(e))
    words = F.concat_ws(" ", F.lower(F.coalesce(page_title, F.lit(""))), F.lower(F.coalesce(meta("keywords"), F.lit(""))))
    return F.struct(
        or_null(page_title).alias("title"),
        F.coalesce(meta("description"), or_null(F.substring(bare(about), 1, 500))).alias("description"),
        F.when(F.size(socials) > 0, socials).alias("social_links"),
        F.coalesce(*[year(p) for p in C.FOUNDED_YEARS]).alias("founded_year"),
        F.coalesce(*[strip(first_match(body, f"(?i){p}", 0)) for p in C.COMPANY_SIZES]).alias("company_size"),
        F.get(emails, F.lit(0)).alias("email"),
        F.coalesce(*[F.when(words.rlike(alternatives(ks)), v) for ks, v in by_label(C.PAGE_INDUSTRIES)]).alias("industry"),
    )


def _decimal(x: str | float) -> Column:
    return F.lit(x).cast("decimal(3,2)")


def industry_score(industry: Column) -> Column:
    low = strip(F.lower(industry))
    known = low.rlike(f"^(?:{alternatives(C.RECOGNISED_INDUSTRIES)})")  # the sub-categories all start with a recognised industry
    return F.when(~full(industry), _decimal("0.5")).when(known, _decimal("1")).otherwise(_decimal("0.7"))


def size_score(size: Column) -> Column:
    return F.when(full(strip(size)), _decimal("1")).otherwise(_decimal("0.5"))


def location_score(city: Column, latitude: Column, longitude: Column, address: Column) -> Column:
    here, position = full(strip(city)), latitude.isNotNull() & longitude.isNotNull()
    return F.when(here & position, _decimal("1")).when(here, _decimal("0.7")).when(position, _decimal("0.5")).when(full(strip(address)), _decimal("0.3")).otherwise(_decimal("0"))


def technology_score(technologies: Column) -> Column:
    return F.when(F.size(technologies) > 0, _decimal("1")).otherwise(_decimal("0.5"))


def quality_score(phone: Column, website: Column, email: Column, address: Column, description: Column, social_links: Column, rating: Column, review_count: Column) -> Column:
    some_links = F.coalesce(F.size(social_links) > 0, F.lit(False))
    n = points((full(phone), 1), (full(website), 1), (full(email), 1), (full(address), 1), (full(description), 1), (some_links, 1), (rating.isNotNull(), 1), (review_count.isNotNull(), 1))
    return F.bround(n / F.lit(8.0), 2).cast("decimal(3,2)")


def validation_score(status: Column) -> Column:
    return F.when(status == VALID, _decimal("1")).when(status == UNKNOWN, _decimal("0.5")).otherwise(_decimal("0"))


def total_score(factors: dict[str, Column]) -> Column:
    """The weighted sum in per cent, exact in decimals."""
    return reduce(lambda a, b: a + b, (factors[k] * F.lit(w) for k, w in C.SCORE_WEIGHTS.items())).cast("decimal(5,2)")


def tier(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 35, "medium").when(score.isNotNull(), "low")


def scoring_formula() -> Column:
    weights = F.create_map(*[x for k, w in C.SCORE_WEIGHTS.items() for x in (F.lit(k), F.lit(w / 100))])
    return F.struct(F.lit(C.SCORE_VERSION).alias("version"), weights.alias("weights"), F.lit("total = sum(factor * weight) * 100").alias("formula"))
