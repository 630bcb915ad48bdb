from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog


def test_every_own_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["book_id"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["query_single", "query_and2", "query_and3", "query_or", "query_absent", "query_stopwords_only", "query_limit"])
def test_searches_go_over_the_index(spark, monkeypatch, name):
    built = []
    build = catalog.index.build_postings
    monkeypatch.setattr(catalog.index, "build_postings", lambda books: built.append(name) or build(books))
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns == ["book_id"] and built == [name]
