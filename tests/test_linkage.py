"""Linking two sources, against going through all pairs in order."""

from __future__ import annotations

import datetime
import random
import re

import pytest

from ledgerline.operators.linkage import Source, link_records


def grams(names):
    found = set()
    for k, name in enumerate(names):
        text = re.sub(r"[\W_]+", " ", (name or "").lower()).strip()
        padded = f"#{text}#"
        if text:
            found |= {(k, padded[i : i + 3]) for i in range(max(1, len(padded) - 2))}
    return found


def plain_links(left, right, tolerance, least):
    """Pairs of records in order of score and ids of their classes, each taking what is left."""

    def classes(rows):
        out = {}
        for i, day, *names in rows:
            key = (day, tuple(re.sub(r"[\W_]+", " ", (n or "").lower()).strip() for n in names))
            if i is not None and day is not None and any(key[1]):
                out.setdefault(key, []).append(i)
        return {k: sorted(v) for k, v in out.items()}

    a, b = classes(left), classes(right)
    pairs = []
    for k, x in a.items():
        for j, y in b.items():
            g, h = grams(k[1]), grams(j[1])
            score = 2.0 * len(g & h) / (len(g) + len(h))
            if abs((k[0] - j[0]).days) <= tolerance and score >= least:
                pairs.append((-score, x[0], y[0], k, j))
    found, used = [], {}
    for score, _, _, k, j in sorted(pairs, key=lambda p: p[:3]):
        at, to = used.get(("l", k), 0), used.get(("r", j), 0)
        n = min(len(a[k]) - at, len(b[j]) - to)
        found += [(a[k][at + i], b[j][to + i], -score) for i in range(n)]
        used["l", k], used["r", j] = at + n, to + n
    return sorted(found)


@pytest.mark.parametrize("tolerance,least", [(0, 0.5), (1, 0.6), (2, 0.9)])
def test_links(spark, tolerance, least):
    """Other spellings, moved days, rows missing on a side, repeated rows, nulls, and chains of similar names."""
    rng, start = random.Random(tolerance), datetime.date(2024, 1, 1)
    towns = ["Northwick", "Southwick", "Eastvale", "Westvale", "Great Malbury", "Little Malbury", "Örebro", "St. Olaf", "X"]
    left, right = [], []
    for i in range(80):
        day, home, away = start + datetime.timedelta(days=rng.randrange(6)), rng.choice(towns), rng.choice(towns)
        if rng.random() < 0.9:
            left.append((i, day, f"{home} FC", away))
        if rng.random() < 0.9:
            change = [lambda t: t.upper(), lambda t: t.replace("wick", "wyck"), lambda t: f"AFC {t}", lambda t: t[:-1], lambda t: t]
            right.append((1000 - i, day + datetime.timedelta(days=rng.choice([0, 0, 1, -1, 2])), rng.choice(change)(home), rng.choice(change)(away)))
    left += [(None, start, "A", "B"), (500, None, "A", "B"), (501, start, None, ""), (502, start, None, "Solo Town"), (503, start, " - ", None)] + [(600 + k, start, "Twin", "Twin") for k in range(7)]
    right += [(2000 + k, start, "TWIN", "twin!") for k in range(5)] + [(2100, start, "Twin", "Twins"), (2101, start, "", "solo town"), (None, start, "Twin", "Twin")]
    make = lambda rows, names: spark.createDataFrame(rows, f"{names[0]} long, {names[1]} date, `{names[2]}` string, `{names[3]}` string").repartition(3)
    found = link_records(Source(make(left, ["class", "day", "home.team", "l"]), "class", "day", ("home.team", "l")), Source(make(right, ["id", "n", "grams", "first"]), "id", "n", ("grams", "first")), tolerance, least)
    got = sorted((r["left_id"], r["right_id"], r["score"]) for r in found.collect())
    assert got == plain_links(left, right, tolerance, least) and got
    assert len({g[0] for g in got}) == len({g[1] for g in got}) == len(got)
    nothing = make(left, ["class", "day", "home.team", "l"]).limit(0)
    assert link_records(Source(nothing, "class", "day", ("l",)), Source(nothing, "class", "day", ("l",))).count() == 0
    with pytest.raises(ValueError, match="similarity"):
        link_records(Source(nothing, "class", "day", ("l",)), Source(nothing, "class", "day", ("l",)), least=0)
