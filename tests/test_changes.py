"""Change feeds against comparing captures row by row, and documents kept as VARIANT."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.changes import capture_gaps, change_feed, latest_capture
from ledgerline.sources import Lake
from ledgerline.sources.payload import path_of, replayed, undeclared, with_payload


def test_change_feed(spark):
    """Null keys and values, columns with names of the operator's own, a map, late captures, and a capture without a date."""
    rng, start = random.Random(2), datetime.date(2024, 1, 1)
    days, rows = [None, *(start + datetime.timedelta(days=n) for n in (0, 1, 4, 5))], []
    for day in days:
        for k in [None, *range(12)]:
            if rng.random() < 0.8:
                rows.append((k, "x", day, rng.choice([None, 1, 2]), rng.choice(["a", None]), {"m": rng.randrange(2)}, rng.randrange(10**6)))
    frame = spark.createDataFrame(rows, "Key int, `k.2` string, captured date, old int, changed string, now_0 map<string,int>, loaded int").repartition(3)
    wanted = []
    for before, after in zip(days[1:], days[2:]):
        a, b = ({r[0]: r for r in rows if r[2] == day} for day in (before, after))
        for k in {*a, *b}:
            names = [n for n, i in (("old", 3), ("changed", 4), ("now_0", 5)) if k in a and k in b and a[k][i] != b[k][i]]
            if k not in a or k not in b or names:
                wanted.append((after, k, "inserted" if k not in a else "deleted" if k not in b else "changed", names, (after - before).days, a[k][3] if k in a else None, b[k][4] if k in b else None))
    found = change_feed(frame, ["key", "k.2", "captured"], "captured", ignore=["loaded"])
    assert found.columns == ["captured", "Key", "k.2", "change", "changed", "days", "old", "new"]
    got = [(r["captured"], r["Key"], r["change"], r["changed"], r["days"], r["old"]["old"] if r["old"] else None, r["new"]["changed"] if r["new"] else None) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and wanted
    assert [tuple(r) for r in capture_gaps(frame, "captured").collect()] == [(days[3], days[2], 3)]
    assert change_feed(frame.limit(0), ["key"], "captured").count() == 0 and change_feed(frame.where(F.col("captured") == start), ["key"], "captured").count() == 0


def test_payload(spark, tmp_path):
    docs = [{"id": 1, "status": "a", "it's": 3, "deep": {"x": [1, 2]}}, {"id": "two", "late": 1.5}, {"id": 3, "late": None, "ID": 9}, {"id": 4, "late": "soon"}, [1], 5]
    texts = [json.dumps(d) for d in docs] + ["{broken", None, ""]
    frame = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "n int, body string, raw_payload string")
    rows = with_payload(frame, "body", {"id": "bigint", "status": "string"}, broken="broken")
    assert rows.columns == ["n", "raw_payload", "broken", "id", "status", "raw_payload_"]
    got = {r["n"]: r for r in rows.select("n", "id", "status", "broken", F.col("raw_payload_").isNull().alias("none")).collect()}
    assert [got[i]["id"] for i in range(9)] == [1, None, 3, 4, None, None, None, None, None] and got[0]["status"] == "a"
    assert {i: got[i]["broken"] for i in got if got[i]["broken"] is not None} == {6: "{broken", 8: ""} and [i for i in got if got[i]["none"]] == [6, 7, 8]
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.upsert(rows, "b", "docs", ["n"])
    assert lake.upsert(rows, "b", "docs", ["n"]) == {"inserted": 0, "updated": 9, "kept": 0}
    held = lake.read("b", "docs")
    fields = {r["field"]: (r["n_rows"], r["kind"]) for r in undeclared(held, ["id", "status"], "raw_payload_").collect()}
    assert fields == {"it's": (1, "BIGINT"), "deep": (1, "OBJECT<x: ARRAY<BIGINT>>"), "late": (3, "VARIANT"), "ID": (1, "BIGINT")}
    more, drifted = replayed(held, {"late": "double", "it's": "int", "deep": "struct<x: array<int>>", "id": "string"}, "raw_payload_")
    out = {r["n"]: r for r in more.withColumn("drifted", drifted).select("n", "late", "it's", "deep", "id", "drifted").collect()}
    assert [out[i]["late"] for i in range(4)] == [None, 1.5, None, None] and out[0]["it's"] == 3 and out[0]["deep"]["x"] == [1, 2] and out[1]["id"] == "two"
    assert [i for i in sorted(out) if out[i]["drifted"]] == [3]
    with pytest.raises(ValueError, match="no path"):
        path_of("a\"'b")


def test_latest_capture_prunes(spark, tmp_path):
    """The subquery is a partition filter: of ten folders one is read."""
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = spark.range(1000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("d"))
    lake.replace_partitions(rows, "b", "t", ["d"])
    found = latest_capture(lake.read("b", "t"), "D", F.col("id") < 995)
    assert found.count() == 100 and found.select("d").distinct().count() == 1
    plan = latest_capture(lake.read("b", "t"), "d")
    assert plan.collect() and {str(r["d"]) for r in plan.collect()} == {"2024-01-10"}
    text = plan._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in text.splitlines() if "PartitionFilters" in line]
    assert any("Subquery" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in filters)
    assert latest_capture(lake.read("b", "t").limit(0), "d").count() == 0
