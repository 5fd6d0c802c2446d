"""Days with many similar names: what exact names use up makes no pairs with those that are a little similar."""

from __future__ import annotations

import datetime

from ledgerline.operators import linkage


def test_pairs_stay_few(spark, monkeypatch):
    teams = [f"{a}{b}{a}{b}{a}{b}" for a, b in zip("abcdefghijkl", "mnopqrstuvwx")]
    games = [(h, a) for h in teams for a in teams if h != a]
    rows = [(d * len(games) + i, datetime.date(2024, 1, 1 + d), h, a) for d in range(5) for i, (h, a) in enumerate(games)]
    frame = spark.createDataFrame(rows, "id long, day date, home string, away string").repartition(3)
    counts, plain = [], linkage.kept

    def counted(df, name):
        made = plain(df, name)
        if name == "pairs":
            counts.append(made.count())
        return made

    monkeypatch.setattr(linkage, "kept", counted)
    source = linkage.Source(frame, "id", "day", ("home", "away"))
    found = {(r["left_id"], r["right_id"]) for r in linkage.link_records(source, source, 1, 0.5).collect()}
    assert found == {(i, i) for i, *_ in rows}
    assert max(counts) <= 8 * len(rows)
