"""Interleaved orders: the same rows, places in order of the columns, and files that can be skipped for each column."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import Lake
from ledgerline.sources.layout import files_touched, interleaved, with_interleaved_key


@pytest.fixture
def rows(spark):
    made = spark.range(4000).select((F.col("id") * 7919 % 4000).cast("int").alias("a"), F.format_string("k%05d", F.col("id") * 104729 % 4000).alias("b.c"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 500).cast("int")).alias("d"))
    odd = spark.createDataFrame([(None, None, None), (5, "", None)], "a int, `b.c` string, d date")
    return made.unionByName(odd)


def test_key(rows):
    """One column alone sorts as the column does; two columns take turns, whatever their types."""
    for c in ("a", "b.c", "d"):
        one = [r["k"] for r in with_interleaved_key(rows, [c], "k", 4).where(f"`{c}` is not null").orderBy(f"`{c}`").select("k").collect()]
        assert one == sorted(one) and len(set(one)) == 16
    keyed = with_interleaved_key(with_interleaved_key(with_interleaved_key(rows, ["a"], "x", 3), ["d"], "y", 3), ["a", "d"], "z", 3)
    pair = {(r["x"], r["y"], r["z"]) for r in keyed.select("x", "y", "z").collect()}
    spread = lambda v: sum((v >> b & 1) << 2 * b for b in range(3))
    assert all(z == spread(x) | spread(y) << 1 for x, y, z in pair) and len(pair) > 50
    with pytest.raises(ValueError, match="columns can be interleaved"):
        with_interleaved_key(rows, [], "k")
    with pytest.raises(ValueError, match="no order by"):
        with_interleaved_key(rows.withColumn("m", F.array("a")), ["m"], "k")


def test_files_are_skipped(spark, rows, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.replace(rows, "s", "t")
    ranges = [("a", 100, 150), ("b.c", "k01000", "k01050")]
    lake.cluster("s", "t", ["a", "b.c"], 16)
    plain = {r["column"]: (r["n_files"], r["n_touched"]) for r in files_touched(lake.read("s", "t"), ranges).collect()}
    lake.cluster("s", "t", ["a", "b.c"], 16, interleave=True)
    turned = {r["column"]: (r["n_files"], r["n_touched"]) for r in files_touched(lake.read("s", "t"), ranges).collect()}
    assert plain["b.c"][1] > 12 and turned["a"][1] <= 8 and turned["b.c"][1] <= 8 and turned["a"][0] == 16
    same = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert same(lake.read("s", "t")) == same(rows) == same(interleaved(rows, ["d"], 3)) and interleaved(rows.limit(0), ["a"], 3).count() == 0
    part = rows.withColumn("p", F.col("a") % 2)
    lake.replace_partitions(part, "b", "t", ["p"])
    lake.cluster("b", "t", ["a", "d"], 6, interleave=True)
    assert same(lake.read("b", "t").select("a", "`b.c`", "d", "p")) == same(part)
