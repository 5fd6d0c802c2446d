"""Members whose 31-bit surrogate keys clash."""

from __future__ import annotations

import duckdb

from ledgerline.operators.audit import RunLog
from ledgerline.plans import layers, oracles, standard
from ledgerline.plans.star import Star
from ledgerline.sources.lake import Lake
from tests.compare import duck, same_as_sql

#: Customers whose md5 keys are equal; the merge has the first of each in the base alone, the second in the news alone or in both.
CLASHES = [(77122, 101736), (80575, 107531)]


def test_scd1_keeps_both(spark, tmp_path):
    source = "/root/testdata/sf0.001/customer.parquet"
    pick = ", ".join(f"({i}, {key})" for i, key in enumerate(k for pair in CLASHES for k in pair))
    duckdb.execute(f"COPY (SELECT c.* REPLACE (key AS c_custkey) FROM '{source}' c JOIN (VALUES {pick}) v(i, key) ON c.c_custkey = i + 1) TO '{tmp_path}/customer.parquet'")
    made = standard.scd1_dimension(spark, str(tmp_path))
    assert made.count() == 4 and made.select("customer_key").distinct().count() == 2
    same_as_sql(standard.scd1_dimension(spark, str(tmp_path)), duck(str(tmp_path)), oracles.oracle_sql()["scd1_dimension"])


def test_dimension_keeps_both(spark, tmp_path, monkeypatch):
    """A merge of the star loses no player, so that the grain check finds the clash."""
    players = spark.createDataFrame([(p, f"P{p}") for p in CLASHES[0]], "player_id long, player_name string")
    clash = lambda self: players.selectExpr("7 AS player_key", "*")
    monkeypatch.setattr(Star, "dim_player", clash)
    monkeypatch.setattr(layers, "TABLES", {"dim_player": (("player_key",), True)})
    lake = Lake(spark, str(tmp_path / "lake"))
    for t in ("matches", "teams", "scorers"):
        lake.replace(players, "silver", t)
    tables = layers.build_star(lake, RunLog(spark, "b", "FULL"), validate=False)
    assert {r["player_id"] for r in tables["dim_player"].collect()} == set(CLASHES[0])
    report = layers.validation_report(tables).where("check = 'grain' AND table = 'dim_player'").first()
    assert report["violations"] == 1
