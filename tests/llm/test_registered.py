"""The registered queries on the smallest tables, against SQL where there is any; and the pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import queries
from tests.compare import duck, same_as_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same_as_sql(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_whole_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.queries()[name](spark, SF)
    assert found.select("doc_id").distinct().count() == docs.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, now, SF).cache()
        assert made.columns == columns
        assert made.select("doc_id").distinct().count() == made.count() <= now.count(), name
        now = made
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.count()
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]
