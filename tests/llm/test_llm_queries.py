"""Registered queries and the pipeline on the test tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from seatpool.llm import queries

RUN = queries.registered()


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = RUN[name](spark, sf_dir)
    cursor = connection.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    order = [columns.index(c) for c in found.columns]
    assert Counter(map(tuple, found.collect())) == Counter(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    before = ids
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= before
        docs, before = after, kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == before
