"""Tables kept by partition, growing types, deletes, and merges of columns with awkward names."""

from __future__ import annotations

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.growth import wider
from ledgerline.operators.rows import latest_per_key
from ledgerline.operators.upsert import merge, merge_counts
from ledgerline.sources import Lake


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_null_partition(spark, lake):
    """A capture without a date is a partition like others: nothing of it is lost by a later load."""
    frame = lambda *values: spark.createDataFrame(values, "k int, d date, v string")
    one, two = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    up = lambda df: lake.upsert(df, "b", "t", ["k", "d"], partition="d")
    assert up(frame((1, None, "a"), (2, None, "b"), (1, one, "c"))) == {"inserted": 3, "updated": 0, "kept": 0}
    assert up(frame((3, None, "x"))) == {"inserted": 1, "updated": 0, "kept": 2}
    assert up(frame((2, None, "y"), (9, two, "z"))) == {"inserted": 1, "updated": 1, "kept": 2}
    assert rows(lake.read("b", "t"), "k", "d", "v") == sorted([(1, None, "a"), (2, None, "y"), (3, None, "x"), (1, one, "c"), (9, two, "z")], key=repr)
    plan = lake._touched(lake.read("b", "t"), frame((1, one, "q")), "d")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [d" in plan.replace("PartitionFilters: [(", "PartitionFilters: [").replace("isnotnull(", "")


def test_many_partitions_in_a_load(spark, lake, monkeypatch):
    monkeypatch.setattr("ledgerline.sources.lake.NAMED_PARTITIONS", 2)
    frame = spark.range(10).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id").cast("int")).alias("p"), F.lit("old").alias("v"))
    lake.upsert(frame, "b", "t", ["k", "p"], partition="p")
    made = lake.upsert(frame.where("k % 2 = 0").withColumn("v", F.lit("new")), "b", "t", ["k", "p"], partition="p")
    assert made == {"inserted": 0, "updated": 5, "kept": 0}
    assert rows(lake.read("b", "t"), "k", "p", "v") == sorted([(i, i or None, "old" if i % 2 else "new") for i in range(10)], key=repr)


def test_types_grow(spark, lake):
    """int, then long, then double by day reads back; a narrower load later fits in; other columns may come in between."""
    up = lambda schema, *values: lake.upsert(spark.createDataFrame(values, schema), "b", "t", ["k", "d"], partition="d")
    up("k int, d int, v int", (1, 1, 10), (2, 1, None))
    up("k int, d int, v long, `x.y` string", (1, 2, 1 << 40, "a"))
    up("k int, d int, V double", (1, 3, 0.5))
    up("k int, d int, v short", (1, 4, 7), (3, 1, 5))
    got = lake.read("b", "t")
    assert dict(got.dtypes)["v"] == "double" and got.columns == ["k", "d", "v", "x.y"]
    assert rows(got, "k", "d", "v", "`x.y`") == sorted([(1, 1, 10.0, None), (2, 1, None, None), (3, 1, 5.0, None), (1, 2, float(1 << 40), "a"), (1, 3, 0.5, None), (1, 4, 7.0, None)], key=repr)
    # The partition column grows, too: its values are names of folders.
    up("k int, d long, v int", (5, 1 << 40, 1))
    assert lake.read("b", "t").where(F.col("d") == 1 << 40).count() == 1 and lake.read("b", "t").count() == 7
    with pytest.raises(ValueError, match="column v is double and gets string"):
        up("k int, d int, v string", (1, 5, "soon"))
    frame = spark.createDataFrame([(1, 6, "1.5"), (2, 6, "soon"), (3, 6, None)], "k int, d int, v string")
    assert lake.upsert(frame, "b", "t", ["k", "d"], partition="d", batch_id="b1")["inserted"] == 2
    assert rows(lake.read("b", "t").where("d = 6"), "k", "v") == [(1, 1.5), (3, None)]
    held = lake.read("quarantine", "b_t").first()
    assert (held["k"], held["v"], held["quarantine_reason"], held["batch_id"]) == (2, "soon", "cast_failed_schema_drift", "b1")
    # A table of versions grows the same way.
    lake.upsert(spark.createDataFrame([(1, 1)], "k int, v int"), "s", "t", ["k"])
    lake.upsert(spark.createDataFrame([(2, 2.5)], "k long, v double"), "s", "t", ["k"])
    assert rows(lake.read("s", "t"), "k", "v") == [(1, 1.0), (2, 2.5)] and dict(lake.read("s", "t").dtypes) == {"k": "bigint", "v": "double"}


def test_wider():
    short, whole, long, real, double = T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
    assert wider(short, whole) == wider(whole, short) == whole and wider(long, short) == long
    assert wider(long, real) == wider(real, double) == double and wider(whole, T.NullType()) == wider(T.NullType(), whole) == whole
    assert wider(T.DecimalType(10, 2), whole) == T.DecimalType(12, 2) and wider(T.DecimalType(5, 4), T.DecimalType(9, 0)) == T.DecimalType(13, 4)
    assert wider(T.DecimalType(38, 0), T.DecimalType(38, 20)) == double and wider(T.DateType(), T.TimestampType()) == T.TimestampType()
    assert wider(T.StringType(), whole) is None and wider(T.BooleanType(), whole) is None and wider(T.DateType(), whole) is None


def test_delete_by_partition(spark, lake):
    """Deleted rows stay deleted over later loads; folders of partitions that lose all rows go, others are not written again."""
    frame = spark.createDataFrame([(k, p, f"{k}") for p in ("a", "b c/d", None, "e") for k in range(4)], "k int, p string, v string")
    lake.upsert(frame, "b", "t", ["k", "p"], partition="p")
    folder = lambda: {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (base / "b/t").iterdir() if p.is_dir()}
    from pathlib import Path

    base = Path(lake.root)
    before = folder()
    gone = (F.col("p") == "b c/d") | (F.col("p").isNull() & (F.col("k") < 2))
    assert lake.delete_where("b", "t", gone) == 10
    after = folder()
    assert sorted(before) == sorted(["p=a", "p=b c%2Fd", "p=__HIVE_DEFAULT_PARTITION__", "p=e"]) and len(after) == 3
    assert after["p=a"] == before["p=a"] and after["p=e"] == before["p=e"] and after["p=__HIVE_DEFAULT_PARTITION__"] != before["p=__HIVE_DEFAULT_PARTITION__"]
    made = lake.upsert(spark.createDataFrame([(0, None, "new"), (9, "b c/d", "new"), (1, "a", "new")], "k int, p string, v string"), "b", "t", ["k", "p"], partition="p")
    assert made == {"inserted": 2, "updated": 1, "kept": 5}
    wanted = [(k, p, f"{k}") for p in ("a", "e") for k in range(4) if (k, p) != (1, "a")] + [(2, None, "2"), (3, None, "3"), (0, None, "new"), (9, "b c/d", "new"), (1, "a", "new")]
    assert rows(lake.read("b", "t"), "k", "p", "v") == sorted(wanted, key=repr)
    lake.cluster("b", "t", ["v"], 3)
    assert rows(lake.read("b", "t"), "k", "p", "v") == sorted(wanted, key=repr)
    assert lake.delete_where("b", "t", F.lit(True)) == 0 and lake.read("b", "t").count() == 0
    assert lake.upsert(frame.limit(3), "b", "t", ["k", "p"], partition="p")["inserted"] == 3 and lake.read("b", "t").count() == 3
    with pytest.raises(ValueError, match="kept by partition"):
        lake.replace(frame, "b", "t")
    with pytest.raises(ValueError, match="kept by p"):
        lake.replace_partitions(frame, "b", "t", ["k"])
    lake.replace(frame, "s", "t")
    with pytest.raises(ValueError, match="has versions"):
        lake.upsert(frame, "s", "t", ["k", "p"], partition="p")


def test_layout_is_never_half_written(spark, lake):
    """The columns are in a numbered file that comes by rename; a file that is being written is not one of them."""
    lake.upsert(spark.createDataFrame([(1, 1)], "k int, p int"), "b", "t", ["k", "p"], partition="p")
    fs, at = lake._fs(f"{lake.path('b', 't')}/.columns-half")
    out = fs.create(at, True)
    out.write(bytearray(b'{"by": ["p"'))
    out.close()
    assert lake.read("b", "t").count() == 1
    for n in range(3):
        lake.upsert(spark.createDataFrame([(1, 1, n)], f"k int, p int, v{n} int"), "b", "t", ["k", "p"], partition="p")
    assert len(lake._listed(lake.path("b", "t"), "_columns-")) == 2 and lake.read("b", "t").columns == ["k", "p", "v0", "v1", "v2"]


def test_names(spark, lake):
    """Columns that the operators might use themselves, of another case, or with dots."""
    old = spark.createDataFrame([(1, "a", 7, "o", 1, "x"), (2, "b", 8, "p", 2, "y")], "K int, `a.b` string, _place int, _origin string, place int, origin string")
    new = spark.createDataFrame([(2, "c", 9, "q", 3, "z"), (3, "d", 10, "r", 4, "w"), (3, "e", 10, "r", 4, "w")], "k int, `A.B` string, _place int, _origin string, place int, ORIGIN string")
    made = merge(old, new, ["k"], [F.col("`a.b`").desc()])
    assert made.columns == old.columns
    assert sorted(tuple(r) for r in made.collect()) == [(1, "a", 7, "o", 1, "x"), (2, "c", 9, "q", 3, "z"), (3, "e", 10, "r", 4, "w")]
    assert tuple(merge_counts(old, new, ["k"]).first()) == (1, 1, 1)
    assert latest_per_key(new, ["K"]).columns == new.columns and latest_per_key(new, ["`a".replace("`", "") + ".b"]).count() == 3
    assert lake.upsert(old, "s", "t", ["k"])["inserted"] == 2 and lake.upsert(new, "s", "t", ["k"]) == {"inserted": 1, "updated": 1, "kept": 1}
    assert lake.read("s", "t").columns == old.columns
    with pytest.raises(ValueError, match="no column z"):
        merge(old, new, ["z"])
    money = spark.createDataFrame([(1, decimal.Decimal("1.50"))], "k int, v decimal(10,2)")
    assert merge(money, spark.createDataFrame([(2, 3)], "k int, v int"), ["k"]).where("k = 2").first()["v"] == decimal.Decimal("3.00")
