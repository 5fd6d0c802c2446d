"""Steps of components leave no superseded tables."""

from __future__ import annotations

import glob

from ledgerline.llm.components import connected_components


def test_components_keep_their_last_table_only(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/ledgerline-*/edges"))
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(chain).collect()}
    assert found == {i: 0 for i in range(1, 21)}
    assert len(set(glob.glob(f"{folder}/ledgerline-*/edges")) - before) == 1
