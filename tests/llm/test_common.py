from __future__ import annotations

import pytest

from ledgerline.llm.common import bitmap, discard, filtered, fresh_names, materialize, scratch_dir, stretches


class _Unset:
    """A session that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        applicationId = "app-test"
        master = "local[2]"


class _Cluster(_Unset):
    class sparkContext:
        applicationId = "app-cluster"
        master = "spark://host:7077"


def test_scratch(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(_Unset) == scratch_dir(_Unset) and scratch_dir(_Unset).startswith("/tmp/spark-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(_Cluster)
    table = materialize(spark.range(3), "x")
    discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(table.scratch)
    assert fresh_names(spark.sql("select 1 as a, 2 as B"), "a", "b", "c") == ["a_", "b_", "c"]
    assert materialize(spark.range(3), "x").count() == 3 and materialize(spark.range(0), "x").count() == 0


def test_stretches():
    assert [(s.start, s.stop) for s in stretches([3, 3, 9, 1, 1], 6)] == [(0, 2), (2, 3), (3, 5)]
    assert list(stretches([], 6)) == []


@pytest.mark.parametrize("keys", [[], [7], [-3, 7], [1 << 40, -(1 << 62), 0, 5, 6]])
@pytest.mark.parametrize("most", [1 << 26, 16])
def test_bitmap(spark, keys, most):
    """A filter misses none of its keys, passes hardly any other, and its two sides are all rows."""
    bits = bitmap(spark.createDataFrame([(k,) for k in keys], "k long"), most)
    rows = spark.createDataFrame([(k,) for k in [*keys, *range(1000, 1500)]], "k long")
    held, rest = ({r["k"] for r in filtered(rows, bits, wanted).collect()} for wanted in (True, False))
    assert set(keys) <= held and not held & rest and len(held | rest) == len(keys) + 500
    assert len(held) <= len(keys) + 20
