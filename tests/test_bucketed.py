"""Merges into bucketed tables: results as in memory, and no shuffle of what is there."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.upsert import merge
from ledgerline.sources.bucketed import BucketedTable


@pytest.fixture(params=[False, True])
def table(spark, tmp_path, request):
    spark.sql("CREATE SCHEMA IF NOT EXISTS buckets")
    name = f"buckets.t{random.randrange(10**9)}"
    yield BucketedTable(spark, name, ("k", "part.no"), 4, str(tmp_path / "tables") if request.param else None)
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for v in BucketedTable(spark, name, ("k",), 4).versions():
        spark.sql(f"DROP TABLE {v}")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merges(spark, table):
    old = spark.range(200).select((F.col("id") % 50).cast("int").alias("k"), (F.col("id") % 4).alias("part.no"), F.col("id").cast("int").alias("v"), F.lit("o").alias("origin"))
    old = old.dropDuplicates(["k", "part.no"])
    n = old.count()
    assert not table.exists() and table.upsert(old.unionByName(old.limit(0))) == {"inserted": n, "updated": 0, "kept": 0}
    new = spark.createDataFrame([(1, 1, 0.5, "n", "x"), (1, 1, 0.25, "n", "y"), (999, 0, 7.5, "n", None)], "K long, `part.no` long, v double, origin string, `new col` string")
    wanted = rows(merge(old, new, ["k", "part.no"], [F.col("v").desc()]))
    made = table.upsert(new, [F.col("v").desc()])
    assert made == {"inserted": 1, "updated": 1, "kept": n - 1} and rows(table.read()) == wanted
    assert table.read().columns == ["k", "part.no", "v", "origin", "new col"] and dict(table.read().dtypes)["v"] == "double"
    for _ in range(2):
        assert table.upsert(new, [F.col("v").desc()]) == {"inserted": 0, "updated": 2, "kept": n - 1}
    assert len(table.versions()) == 2 and rows(table.read()) == wanted
    if table.folder:
        assert len(list(Path(table.folder).iterdir())) == 2
    with pytest.raises(Exception, match="a key is null"):
        table.upsert(spark.createDataFrame([(None, 1, 1.0)], "k int, `part.no` long, v double"))
    assert rows(table.read()) == wanted and len(table.versions()) == 2
    with pytest.raises(ValueError, match="column v is double and gets string"):
        table.upsert(spark.createDataFrame([(1, 1, "x")], "k int, `part.no` long, v string"))


def test_no_shuffle_of_the_stored_side(spark, table):
    """Under the stored table's scan there is no Exchange; the incoming rows have one, by the table's buckets."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table.upsert(spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("part.no"), F.lit(1).alias("v")))
        new = spark.range(90, 110).select(F.col("id").alias("k"), (F.col("id") % 3).alias("part.no"), F.lit(2).alias("v"))
        plan = table.merged(new)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    depth = lambda line: len(re.match(r"[\s:|+\-*()\d]*", line)[0])
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line)
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    assert any("FullOuter" in line for line in above) and not any("Exchange" in line for line in above[: next(i for i, line in enumerate(above) if "FullOuter" in line)])
    assert sum("Exchange hashpartitioning" in line for line in lines) <= 2 and "Bucketed: true" in plan
