"""Queries with SQL against it, and the pipeline's stages on their own inputs."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from quillspark.llm import near_dedup, oracles, packing, queries, secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(oracles.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_every_document_once(spark, name):
    ids = {r["doc_id"] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = (docs, out.persist())
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = out
    before, after = kept["near_dedup"]
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == set(classes.values())
    before, after = kept["secret_scan"]
    assert after.count() == before.count()
    for r in after.collect():
        assert not secret_scan.scan_text(r["text"])[0] and (r["n_chars"] == len(r["text"]))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r["doc_id"] for r in after.collect()}


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pieces_carry_ids(spark):
    assert "ids binary" in packing.SCHEMA
