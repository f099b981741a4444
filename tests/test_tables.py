"""Sources, stages, read queries, sinks and the stream on small tables."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from leadspark import constants as C
from leadspark.plans import serve, stages, stats, write
from leadspark.plans.derived import RUN, raw_records
from leadspark.sources import listings, registry
from leadspark.sources.payload import NORMALISERS, PAYLOAD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return raw_records(spark, SF).where("pmod(xxhash64(id), 4) = 0").checkpoint()


@pytest.fixture(scope="module")
def tables(spark, raw):
    return stages.run_all(raw) | {"raw": raw}


def test_sources():
    assert registry.check_sources(["web_search", "justdial", "web_search"]) == ["web_search", "justdial"]
    for bad in ([], ["google_places"], ["x"]):
        with pytest.raises(ValueError):
            registry.check_sources(bad)
    with pytest.raises(ValueError):
        registry.open_source("google_places")
    assert registry.open_source("openstreetmap") is NORMALISERS["openstreetmap"]


def test_normalisers(spark):
    listing = [("Star", "1 A St, Eluru, Goa", "98", "https://m/1", 4.5, "cafe", ("m1", "q", "t", "u", "k"))]
    kind = "name string, address string, phone string, maps_url string, rating double, category string, _provenance struct<extraction_method:string,search_query:string,extracted_at:string,search_url:string,source_type:string>"
    df = spark.createDataFrame(listing, kind)
    r = NORMALISERS["google_search"](df).head()
    assert r.source_record_id.startswith("gmaps_") and (r.raw_data.city, r.raw_data.state, r.raw_data.industry, r.raw_data.metadata.extraction_method) == ("Eluru", "Goa", "cafe", "m1")
    assert {NORMALISERS[n](df).head().source_record_id.rsplit("_", 1)[0] for n in ("google_maps_scraper", "web_search", "indiamart", "justdial")} == {"gmaps_scraper", "web", "imart", "jd"}
    osm = spark.createDataFrame([("node", 7, 1.5, 2.5, {"name": "Om", "addr:city": "Goa", "shop": "bakery"}), ("node", 7, 1.5, 2.5, {"name": "Om"}), ("way", 8, 1.0, 1.0, {"shop": "x"})], "type string, id long, lat double, lon double, tags map<string,string>")
    rows = NORMALISERS["openstreetmap"](osm.limit(1)).collect()
    assert [(x.source_record_id, x.raw_data.name, x.raw_data.city, x.raw_data.industry, x.raw_data.latitude) for x in rows] == [("osm_node_7", "Om", "Goa", "bakery", 1.5)] and NORMALISERS["openstreetmap"](osm).count() == 1
    places = spark.createDataFrame([("p1", ("A", "en"), 5)], "id string, displayName struct<text:string,languageCode:string>, userRatingCount int")
    p = NORMALISERS["google_places"](places).head()
    assert (p.source_record_id, p.raw_data.name, p.raw_data.review_count, p.raw_data.reviews_count) == ("p1", "A", 5, None)
    assert len(PAYLOAD) > 0


def test_extract_goes_on_without_a_broken_source(spark):
    good = spark.createDataFrame([("Star Hospital", "x, Goa", "98", "https://m/1")], "name string, address string, phone string, maps_url string")
    bad = spark.createDataFrame([(1,)], "tags int")
    errors = []
    rows, counts = registry.extract({"google_search": good, "openstreetmap": bad}, "o", RUN, "hospitals", "Goa", None, errors=errors)
    assert len(errors) == 1 and rows.count() == 1 and {r.source_adapter: r.n_listings for r in counts.collect()} == {"google_search": 1}
    r = rows.head()
    assert r.status == "extracted" and r.raw_data.metadata.contributing_sources == ["google_search"] and registry.run_status(1, errors) == "completed" and registry.run_status(0, errors) == "failed"


def test_data_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"name": "A", "rating": 4.5}\n\n{"name": "B"}\n')
    listings.register(spark)
    rows = spark.read.format("lead_listings").option("path", str(tmp_path)).option("source", "web_search").load().orderBy("name").collect()
    assert [(r.source_adapter, r.name, r.rating) for r in rows] == [("web_search", "A", 4.5), ("web_search", "B", None)]


def test_fallback_and_dedupe(spark):
    a = spark.createDataFrame([], "name string, phone string, seq int")
    b = spark.createDataFrame([("A", "12345678", 1), ("B", "1234 5678", 2), ("A b", None, 3), ("a-B", "", 4)], "name string, phone string, seq int")
    assert registry.first_non_empty([a, b]).count() == 4
    assert sorted(r.seq for r in registry.listings(b).collect()) == [1, 3]
    assert sorted(r.seq for r in registry.named_listings(b, 2).collect()) == [3]


def test_stages_agree_in_size(tables):
    n = tables["companies"].count()
    assert n and all(tables[t].count() == n for t in ("validations", "enrichments", "scores"))
    assert tables["record_company"].count() == tables["raw"].count() == tables["clusters"].agg(F.sum("size")).head()[0]
    s = stats.score_stats(tables["scores"]).head()
    assert s.total == n and s.high + s.medium + s.low == n and 0 <= s.min_score <= s.avg_score <= s.max_score <= 100
    v = stats.validation_summary(tables["validations"]).head()
    assert v.overall_valid + v.overall_invalid + v.overall_unknown == n
    assert stats.enrichment_summary(tables["enrichments"]).head().enriched == n


def test_pages_and_conditional_joins(spark, tables):
    t = tables
    every = serve.scored_leads(t["companies"], t["enrichments"], t["validations"], t["scores"], limit=None).collect()
    two = serve.scored_leads(t["companies"], t["enrichments"], t["validations"], t["scores"], limit=5, offset=5).collect()
    assert [r.company_id for r in two] == [r.company_id for r in every[5:10]]
    none = t["enrichments"].limit(0)
    f = serve.Filters(has_email=False)
    assert serve.scored_leads(t["companies"], none, t["validations"], t["scores"], f).count() == 0
    with pytest.raises(ValueError):
        serve.page(t["companies"], 0)
    assert serve.Filters(min_score=1, has_phone=False, validation_status="valid", city="").applied() == {"min_score": 1, "has_phone": False, "validation_status": "VALID"}


def test_leads_without_scores_come_last(spark, tables):
    t = tables
    sources = serve.company_sources(t["record_company"], t["raw"])
    saved = spark.createDataFrame([], "company_id string, saved_count long")
    leads = serve.unified_leads(t["companies"], t["enrichments"], t["validations"], t["scores"].where("total_score > 70"), sources, saved)
    scores = [r.total_score for r in serve.list_leads(leads, limit=1000).collect()]
    assert scores[-1] is None and scores[0] is not None and not leads.where("is_saved").count()
    assert serve.run_companies(t["raw"], t["record_company"], "no-uuid") is None and serve.run_companies(t["raw"], t["record_company"], RUN).count() == t["companies"].count()


def test_new_leads(spark, tables):
    t = tables
    company = t["companies"].head().company_id
    runs = spark.createDataFrame([(RUN,)], "id string")
    leads = spark.createDataFrame([], "company_id string, pipeline_run_id string, raw_record_id string")
    asked = spark.createDataFrame([(company, RUN, None), ("nobody", RUN, None), (company, "norun", None), (company, RUN, "norecord")], "company_id string, pipeline_run_id string, raw_record_id string")
    args = (t["companies"], runs, t["raw"], t["record_company"], t["enrichments"], t["validations"], t["scores"])
    new, refused = serve.new_leads(asked, *args, leads)
    lead = new.collect()
    assert len(lead) == 1 and lead[0].enrichment_status == "completed" and {r.reason for r in refused.collect()} == {"company not found", "run not found", "record not found"}
    new2, refused2 = serve.new_leads(asked.limit(1), *args, new.select("company_id", "pipeline_run_id", "raw_record_id"))
    assert new2.count() == 0 and refused2.head().reason == "already saved"


def test_tenants_stay_apart(spark, tmp_path, tables):
    one = tables["scores"].limit(3)
    path = str(tmp_path / "scores")
    write.replace_tenant(one, "a", path)
    write.replace_tenant(one.limit(2), "b", path)
    write.replace_tenant(one.limit(1), "a", path)
    back = write.tenants(spark, path)
    assert stages.of_tenant(back, "a").count() == 1 == write.tenants(spark, path, "a").count() and stages.of_tenant(back, "b").count() == 2
    write.append_raw(tables["raw"].limit(2), str(tmp_path / "raw"))
    write.append_raw(tables["raw"].limit(2), str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 4


def read_csv(folder):
    name = next(f for f in os.listdir(folder) if f.startswith("part-"))
    with open(os.path.join(folder, name), newline="") as f:
        return list(csv.reader(f))


def test_exports(spark, tmp_path, tables):
    t = tables
    rows = serve.export_rows(t["companies"], t["enrichments"], t["validations"], t["scores"])
    audit = write.export_leads(rows, str(tmp_path / "leads"), {}, single=True)
    back = read_csv(tmp_path / "leads")
    assert back[0] == C.LEAD_CSV_COLUMNS and audit["record_count"] == len(back) - 1 == rows.count()
    odd = spark.createDataFrame([('a,"b"\nc', {"x": "ü"}, None)], "t string, m map<string,string>, n int")
    write.write_csv(odd, str(tmp_path / "odd"), single=True)
    assert read_csv(tmp_path / "odd")[1] == ['a,"b"\nc', json.dumps({"x": "ü"}, ensure_ascii=False, separators=(",", ":")), ""]
    assert write.export_raw(t["raw"], str(tmp_path / "raw")) == len(read_csv(tmp_path / "raw")) - 1
    with pytest.raises(LookupError):
        write.export_raw(t["raw"].limit(0), str(tmp_path / "none"))


def test_stream_merges_runs(spark, tmp_path, raw):
    from leadspark.streaming import ingest

    paths = [str(tmp_path / p) for p in ("in", "companies", "links", "state")]
    a, b = raw.where("source_adapter = 'openstreetmap'"), raw.where("source_adapter <> 'openstreetmap'")
    from leadspark.streaming import progress

    recorder = progress.record(spark, str(tmp_path / "progress"))
    a.coalesce(1).write.parquet(paths[0])
    first = ingest.start(spark, *paths)
    first.awaitTermination()
    b.coalesce(1).write.mode("append").parquet(paths[0])
    ingest.start(spark, *paths).awaitTermination()
    progress.stop(spark, recorder)
    seen = progress.progress(spark, str(tmp_path / "progress"), first.id).collect()
    assert {r.batch_id for r in seen} == {0, 1} and len({r.run for r in seen}) == 2 and all(r.n_rows > 0 and r.seconds > 0 for r in seen)
    links = spark.read.parquet(paths[2])
    assert links.select("record_id").distinct().count() == raw.count()
    now = ingest.latest(spark, paths[1], 10**9)
    assert now.count() == now.select("company_id").distinct().count() and links.join(now, "company_id", "left_anti").where("version = 1").count() == 0


def test_empty_tables(spark, raw):
    t = stages.run_all(raw.limit(0))
    assert all(t[k].count() == 0 for k in t) and stages.clean_summary(t["cleaned"], t["clusters"]).head().raw_records_read == 0
    assert stats.score_stats(t["scores"]).head().avg_score == 0


def test_a_source_of_ones_own_and_a_limit_of_time(spark):
    from leadspark.sources.payload import payload

    registry.register("own_list", lambda df: df.select(F.concat(F.lit("own_"), "n").alias("source_record_id"), payload(name=F.col("n"), phone=F.lit("1")).alias("raw_data")))
    try:
        rows = spark.createDataFrame([("b",), ("a",)], "n string")
        errors = []
        kept, _ = registry.extract({"own_list": rows}, "o", "r", "", None, None, errors=errors, seconds=60)
        assert {r.source_record_id for r in kept.collect()} == {"own_a", "own_b"} and not errors
        assert registry.open_source("own_list") is NORMALISERS["own_list"] and registry.listed(spark).where("name = 'own_list' and selectable").count() == 1
        with pytest.raises(ValueError):
            registry.register("own_list", lambda df: df)
    finally:
        del NORMALISERS["own_list"]
        registry.FREE.discard("own_list")


def test_an_emptied_tenant_has_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("x", 1)], "organization_id string, n int")
    for org in ("a b/c", "d"):
        write.replace_tenant(rows, org, path)
    write.replace_tenant(rows.limit(0), "a b/c", path)
    assert [tuple(r) for r in write.tenants(spark, path).select("n", "organization_id").collect()] == [(1, "d")]
