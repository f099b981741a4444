"""The driver's contract, with and without the training-data subpackage."""

import importlib
import re
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from leadspark.plans import queries as leads

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(leads.oracle_sql()) == set(leads.queries())


def test_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "leadspark.llm", None)
    fresh = importlib.reload(entry)
    assert set(fresh.queries()) == set(leads.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    import leadspark

    root = pathlib.Path(leadspark.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]


@pytest.mark.parametrize("name", ["clean_records", "match_keys", "location_filter", "category_filter", "entity_clusters", "scored_leads", "lead_list", "status_counts", "page_facts", "source_stats", "leads_in_full", "saved_leads", "refused_leads", "upserted", "validations_with_domains", "enrichments_with_pages", "interpreted_queries", "listings_google_search", "listings_openstreetmap", "extracted", "tenants_replaced", "export_record", "listing_texts"])
def test_queries_agree_with_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(chr(34) + x + chr(34) for x in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    one = lambda v: round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, int) else str(v)
    text = lambda rs: sorted(repr([one(v) for v in r]) for r in rs)
    assert text(df.select(*cols).collect()) == text(want)
