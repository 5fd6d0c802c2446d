"""Rounds of components are small queries, and stars need none: large plans fill the driver's memory."""

from __future__ import annotations

from ledgerline.llm import components


def written(spark, monkeypatch, edges):
    """What connected_components finds, and the exchanges in the plan of each table that it writes."""
    plans, write = [], components.materialize

    def counted(df, name, tidy=False):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(df, name, tidy)

    monkeypatch.setattr(components, "materialize", counted)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    return {r["node"]: r["root"] for r in found.collect()}, plans


def test_plans_of_rounds_are_small(spark, monkeypatch):
    found, plans = written(spark, monkeypatch, [(i + 1, i) for i in range(20)])
    assert found == {i: 0 for i in range(1, 21)}
    assert len(plans) > 2 and max(plans) <= 10


def test_stars_are_left_as_they_are(spark, monkeypatch):
    """Links in either direction, repeated and to themselves, whose least nodes link to all others already."""
    found, plans = written(spark, monkeypatch, [(1, 2), (3, 1), (1, 3), (4, 4), (-5, 9)])
    assert found == {2: 1, 3: 1, 9: -5}
    assert len(plans) == 1
