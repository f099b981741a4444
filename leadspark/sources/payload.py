"""The common payload of raw records, and each source's way to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import address_parts, full, or_null, source_id
from .. import constants as C

PAYLOAD = (
    "name string, address string, city string, state string, pin_code string, phone string, website string, email string, industry string, "
    "latitude double, longitude double, rating double, reviews_count int, opening_hours string, maps_url string, source_url string, "
    # what one source alone gives
    "phone_intl string, review_count int, business_status string, google_maps_url string, types array<string>, country string, "
    "metadata struct<extraction_method:string,search_query:string,extracted_at:string,source_type:string,maps_url:string,"
    "contributing_sources:array<string>,completeness_score:double,osm_type:string,osm_id:bigint,all_tags:map<string,string>,"
    "facebook_url:string,twitter_url:string,linkedin_url:string,instagram_url:string>"
)
RAW_RECORD = f"id string, organization_id string, pipeline_run_id string, source_adapter string, source_record_id string, status string, retrieved_at timestamp, company_id string, raw_data struct<{PAYLOAD.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int').replace(' array', ':array').replace(' struct', ':struct')}>"


def payload(**fields: Column) -> Column:
    """A payload struct; fields that are not given are null."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(PAYLOAD)
    meta = {k.removeprefix("m_"): v for k, v in fields.items() if k.startswith("m_")}
    inner = schema["metadata"].dataType
    one = lambda f, given: (given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
    filled = {f.name: one(f, fields) for f in schema if f.name != "metadata"}
    filled["metadata"] = F.struct(*[one(f, meta) for f in inner]).alias("metadata")
    return F.struct(*[filled[f.name] for f in schema])


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _provenance(df: DataFrame, key: str) -> Column:
    return F.col(f"_provenance.{key}") if "_provenance" in df.columns and key in df.schema["_provenance"].dataType.names else F.lit(None)


def _listing(df: DataFrame, prefix: str, method: str, url: str = "maps_url", split_address: bool = False, industry: str = "category", kind: str | None = None, positions: bool = True, constant_method: bool = False, named_id: bool = False) -> DataFrame:
    get = lambda n: _has(df, n)
    address = F.coalesce(get("address"), F.lit("")) if split_address else get("address")
    parts = address_parts(address)
    sid = F.concat(F.lit(prefix), F.substring(F.md5(F.concat(F.lit(prefix), F.coalesce(get("name"), F.lit("")))), 1, 16)) if named_id else source_id(prefix, get("name"), get(url))
    found = F.lit(method) if constant_method else F.coalesce(_provenance(df, "extraction_method"), F.lit(method))
    extra = {n: get(n) for n in ("latitude", "longitude", "rating", "reviews_count", "opening_hours", "maps_url")} if positions else {}
    source_url = F.coalesce(or_null(get("maps_url")), _provenance(df, "search_url")) if split_address else _provenance(df, "search_url") if named_id else get("source_url")
    place = {n: parts[n] for n in ("city", "state", "pin_code")} if split_address else {}
    return df.select(
        sid.alias("source_record_id"),
        payload(
            name=get("name"), address=address, phone=get("phone"), website=get("website"), industry=get(industry), source_url=source_url, **place, **extra,
            m_extraction_method=found, m_search_query=_provenance(df, "search_query"), m_extracted_at=_provenance(df, "extracted_at"),
            m_source_type=F.lit(kind) if kind else _provenance(df, "source_type"), **({"m_maps_url": get("maps_url")} if split_address else {}),
        ).alias("raw_data"),
    )


def from_google_maps_scraper(df: DataFrame) -> DataFrame:
    return _listing(df, "gmaps_scraper_", "google_maps_scraper", split_address=True)


def from_google_search(df: DataFrame) -> DataFrame:
    return _listing(df, "gmaps_", "google_maps", split_address=True)


def from_web_search(df: DataFrame) -> DataFrame:
    return _listing(df, "web_", "web_search", url="source_url", constant_method=True)


def from_indiamart(df: DataFrame) -> DataFrame:
    return _listing(df, "imart_", "indiamart", url="source_url", industry="product", kind="b2b_directory", positions=False)


def from_justdial(df: DataFrame) -> DataFrame:
    return _listing(df, "jd_", "justdial", kind="business_directory", positions=False, named_id=True)


def from_google_places(df: DataFrame) -> DataFrame:
    """Places of the API; it names the review count and the map link its own way and gives no metadata."""
    at = lambda path: F.col(path) if path.split(".")[0] in df.columns else F.lit(None)
    return df.select(
        F.coalesce(at("id"), F.lit("")).alias("source_record_id"),
        payload(
            name=F.coalesce(at("displayName.text"), F.lit("")), address=F.coalesce(at("formattedAddress"), F.lit("")), latitude=at("location.latitude"), longitude=at("location.longitude"), rating=at("rating"),
            review_count=at("userRatingCount"), website=at("websiteUri"), phone=at("nationalPhoneNumber"), phone_intl=at("internationalPhoneNumber"), business_status=at("businessStatus"), types=at("types"), google_maps_url=at("googleMapsUri"),
        ).alias("raw_data"),
    )


def from_openstreetmap(df: DataFrame) -> DataFrame:
    """Elements(type, id, lat, lon, center, tags): those with a name, one for each type and id."""
    tag = lambda *keys: F.coalesce(*[or_null(F.try_element_at("tags", F.lit(k))) for k in keys])
    address = F.array_join(F.array_compact(F.array(*[F.try_element_at("tags", F.lit(f"addr:{k}")) for k in ("housenumber", "street", "city", "state", "postcode")])), ", ")
    named = df.where(full(F.try_element_at("tags", F.lit("name")))).dropDuplicates(["type", "id"])
    ref = lambda sep: F.concat_ws(sep, F.coalesce("type", F.lit("node")), F.col("id").cast("string"))
    mid = lambda axis: F.coalesce(F.nullif(F.col(axis), F.lit(0.0)), F.col(f"center.{axis}")) if "center" in df.columns else F.col(axis)
    return named.select(
        F.concat(F.lit("osm_"), ref("_")).alias("source_record_id"),
        payload(
            name=tag("name"), address=address, city=F.try_element_at("tags", F.lit("addr:city")), state=F.try_element_at("tags", F.lit("addr:state")), pin_code=F.try_element_at("tags", F.lit("addr:postcode")),
            phone=tag("phone", "contact:phone"), website=tag("website", "contact:website"), email=tag("email", "contact:email"), industry=F.coalesce(tag("amenity", "shop", "office", "tourism"), F.lit("")),
            latitude=mid("lat"), longitude=mid("lon"), opening_hours=F.try_element_at("tags", F.lit("opening_hours")), source_url=F.concat(F.lit("https://www.openstreetmap.org/"), ref("/")),
            m_extraction_method=F.lit("openstreetmap"), m_osm_type=F.col("type"), m_osm_id=F.col("id"), m_all_tags=F.col("tags"),
        ).alias("raw_data"),
    )


NORMALISERS = {
    "google_places": from_google_places,
    "google_search": from_google_search,
    "google_maps_scraper": from_google_maps_scraper,
    "openstreetmap": from_openstreetmap,
    "web_search": from_web_search,
    "indiamart": from_indiamart,
    "justdial": from_justdial,
}
assert list(NORMALISERS) == C.SOURCES
