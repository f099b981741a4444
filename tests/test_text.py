"""Cleaning functions against cases with known results."""

import pytest
from pyspark.sql import functions as F

from leadspark.functions import assess as A
from leadspark.functions import text as T


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


CASES = {
    "standard_name": [("Life Hospitals | Orthopedic", "Life Hospitals"), ("Aayush Hospitals, Eluru", "Aayush Hospitals"), ("Coca-Cola", "Coca"), ("men's 3d", "Men'S 3D"), ("  ", None), (None, None), ("", None), ("fine  café", "Fine Café"), ("A, delhi, eluru", "A"), ("A, eluru, delhi", "A, Eluru"), ("| x", None)],
    "match_name": [("Coffee House", "ffee house"), (None, ""), ("Star Pvt. Ltd.", "star"), ("A: b", "a"), ("Café X", "caf x")],
    "standard_phone": [("095151 15103", "+919515115103"), ("+91 95151 15103", "+919515115103"), ("919515115103", "+919515115103"), ("+44 20 7930 4832", "+442079304832"), ("+65 6123 4567", "+916561234567"), ("12345", None), ("", None), (None, None), ("+12345", None), ("12345678901234", "+915678901234")],
    "standard_url": [("http://x.com/", "https://x.com"), ("x.com?utm_source=a&b=1", "https://x.com&b=1"), ("https://www.bing.com/ck/a", None), (" ", None), ("https://x.com?ref=1", "https://x.com"), (None, None)],
    "standard_state": [("ap", "Andhra Pradesh"), ("TAMIL nadu", "Tamil Nadu"), ("north goa", "North Goa"), (None, None), (" ", None)],
    "standard_city": [("bombay", "Mumbai"), ("new york", "New York"), ("", None)],
    "standard_address": [("1 St  Rd", "1 Street Road"), ("1 st", "1 st"), (None, None), ("Stone Dr", "Stone Drive")],
    "compact_phone": [("+91 95151 15103", "9515115103"), ("9112345678", "9112345678"), (None, "")],
    "compact_name": [("Star Care Clinic", "starcare"), ("ABC", "abc")],
    "snippet_name": [("Top 10 cafes", None), ("Star Cafe - India", "Star Cafe"), ("ab", None), ("A blog", None), (None, None)],
    "directory_name": [("Star | JustDial", "Star"), ("A - India", "")],
    "url_domain": [("https://www.X.com/a", "x.com"), (None, None), ("https://x.com:80?q", "x.com:80")],
    "slug": [(" Solar Panels & Co ", "solar-panels-co")],
    "key_hint": [("abcdefgh", "****efgh")],
}


@pytest.mark.parametrize("name", CASES)
def test_text(spark, name):
    given, expected = zip(*CASES[name], strict=True)
    assert apply(spark, getattr(T, name), given) == list(expected)


def test_normal_form(spark):
    rows = spark.createDataFrame([(0, "ﬁne  café", None), (1, "plain", "ａ １"), (2, None, None), (3, "A", "b")], "i int, n string, a string")
    got = T.with_normal_form(rows, {"x": F.col("n"), "y": F.col("a")}).orderBy("i").collect()
    assert [(r.x, r.y) for r in got] == [("fine  café", None), ("plain", "a 1"), (None, None), ("A", "b")] and got[0].n == "ﬁne  café"


def test_address_parts(spark):
    cases = {"123 MG Road, Bangalore, Karnataka": ("Bangalore", "Karnataka", None), "123 MG Road, Bangalore, Karnataka 560001": ("Bangalore", None, "560001"), "London UK": ("London UK", None, None), "": (None, None, None), "1 A St, London, UK": ("London", None, None)}
    found = apply(spark, T.address_parts, list(cases))
    assert [tuple(x) for x in found] == list(cases.values())


def test_phones_in_text(spark):
    assert apply(spark, T.phones_in, ["call 080 4965 3185 or 12", "x"]) == [["08049653185"], []]


def test_listing_fields(spark):
    text = "4.5\nRestaurant · 12 Main St\nOpen until 9 · 098765 43210\n1,204 Reviews"
    r = apply(spark, lambda v: T.listing_fields(v, F.lit("x!3d12.5!4d-7.25")), [text])[0]
    assert (r.rating, r.reviews_count, r.category, r.address, r.phone, r.opening_hours, r.latitude, r.longitude) == (4.5, 1204, "Restaurant", "12 Main St", "098765 43210", "Open until 9", 12.5, -7.25)


def test_country(spark):
    rows = [("+442079304832", None, None, "United Kingdom"), ("+14165550000", "toronto", None, "United States"), (None, "Toronto", None, "Canada"), (None, None, "Goa", "India"), ("919", None, None, "India"), (None, None, None, "Unknown")]
    df = spark.createDataFrame(rows, "p string, c string, s string, want string")
    assert df.where(T.country(F.col("p"), F.col("c"), F.col("s")) != F.col("want")).count() == 0


def test_statuses(spark):
    null = F.lit(None).cast("boolean")
    emails = {"": "NOT_AVAILABLE", "x": "INVALID", "a@mailinator.com": "INVALID", " A@b.co ": "UNKNOWN"}
    assert apply(spark, lambda v: A.email_status(v, null), list(emails)) == list(emails.values())
    assert apply(spark, lambda v: A.email_status(v, F.lit(True)), ["a@b.co"]) == ["VALID"]
    phones = {"+442079304832": "INVALID", "9876543210": "VALID", "+919876543210": "VALID", " ": "NOT_AVAILABLE", "+91987": "INVALID"}
    assert apply(spark, A.phone_status, list(phones)) == list(phones.values())
    sites = {"": "NOT_AVAILABLE", "x.com": "INVALID", "https://www.facebook.com/a": "INVALID", "https://x.com": "VALID", "https://x.com/?bing.com/ck": "INVALID"}
    assert apply(spark, lambda v: A.website_status(v, null), list(sites)) == list(sites.values())
    assert apply(spark, lambda v: A.website_status(v, F.lit(False)), ["https://x.com"]) == ["INVALID"]


def test_overall(spark):
    df = spark.createDataFrame([("VALID", "NOT_AVAILABLE", "UNKNOWN"), ("UNKNOWN", "VALID", "VALID"), ("INVALID", "VALID", "INVALID"), ("UNKNOWN", "UNKNOWN", "UNKNOWN")], "exists string, phone string, want string")
    na = F.lit("NOT_AVAILABLE")
    assert df.where(A.overall_status(na, F.col("phone"), na, F.col("exists")) != F.col("want")).count() == 0


def test_quality_score_rounds_to_even(spark):
    found = []
    for n in (1, 3, 5, 7):
        cols = [F.lit("x") if i < n else F.lit(None).cast("string") for i in range(5)]
        rest = [F.lit(1.0) if i < n - 5 else F.lit(None).cast("double") for i in range(2)]
        no_links = F.lit(None).cast("map<string,string>")
        found.append(float(spark.range(1).select(A.quality_score(*cols, no_links, *rest).alias("x")).head()[0]))
    assert found == [0.12, 0.38, 0.62, 0.88]


def test_industry_and_pages(spark):
    names = {"Star Eye Care": "Healthcare - Eye Care", "Blue Cafeteria": "Food & Beverage", "X": None, "City Hotel": "Hospitality"}
    assert apply(spark, A.industry_of_name, list(names)) == list(names.values())
    html = """<html><head><title> Star
    Clinic </title><meta name="description" content="We heal"></head><body>Founded in 1999. 50+ employees. <a href="https://www.facebook.com/star/">f</a> x@example.com info@star.in</body></html>"""
    f = apply(spark, A.page_facts, [html, None, ""])
    assert (f[0].title, f[0].description, f[0].founded_year, f[0].company_size, f[0].email, f[0].industry, f[0].social_links) == ("Star Clinic", "We heal", "1999", "50+ employees", "info@star.in", "Healthcare", {"facebook": "https://www.facebook.com/star"})
    assert f[1].title is None and f[1].social_links is None and f[2].email is None
