"""Every registered query against the plain SQL it must agree with."""

import math

import pytest

from conftest import SF_DIR
from forecourt.plans import registry

registry.load_all()


# Raw pages need a parser and a fitted forest its library: what they do is held against brute force in test_intervals.py,
# test_text.py and test_market.py, and against SQL on pages and forests that follow from tables.
WITHOUT_SQL = {
    "page_elements", "page_top_containers", "page_listings", "page_site_listings", "page_fallback_listings",
    "price_model_train", "price_model_predict", "good_deals",
}


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert name in WITHOUT_SQL and columns and rows
        return
    relation = oracle.execute(registry.ORACLES[name])
    names = [c[0] for c in relation.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["ad_id", "source_id", "anomaly_score", "reasons", "confidence"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
