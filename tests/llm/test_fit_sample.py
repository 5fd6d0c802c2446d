"""The toxicity model is fitted in a task: the same model, and no texts at the driver."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import toxicity
from ledgerline.llm.queries import TOXICITY_SAMPLE, toxicity_model
from tests.llm.conftest import prose


@pytest.mark.parametrize("n", [0, 120])
def test_texts_stay_off_the_driver(spark, monkeypatch, n):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40) + (" vile filth" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    wanted = toxicity.fit(*toxicity.labelled_sample(docs, labels, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2, TOXICITY_SAMPLE))
    read, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: read.extend(self.columns) or collect(self))
    assert toxicity_model(docs, labels) == wanted
    assert "_text" not in read and ("vile" in wanted.terms) == (n > 0)
