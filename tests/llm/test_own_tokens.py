"""Sets with too many tokens of their own make no pairs with a large group of near copies."""

from __future__ import annotations

import random

from ledgerline.llm import jaccard


def test_outliers_of_a_group_make_no_pairs(spark, monkeypatch):
    rng, base = random.Random(2), [f"w{i}" for i in range(400)]

    def edited(name: str, edits: int) -> str:
        words = list(base)
        for at in rng.sample(range(4, 396, 6), edits):
            words[at] = f"{name}x{at}"
        return " ".join(words)

    # 40 texts with 2 changed words are one group; 40 with 11 to 14 are under 0.8 to it, to each other and to the base.
    texts = [edited(f"a{i}", 2) for i in range(40)] + [edited(f"b{i}", 11 + i % 4) for i in range(40)]
    made, rest = [], jaccard._rest_pairs

    def counted(*given):
        made.append(rest(*given).count())
        return rest(*given)

    monkeypatch.setattr(jaccard, "_rest_pairs", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = [r["component_id"] for r in jaccard.jaccard_groups(frame).orderBy("doc_id").collect()]
    assert found == [0] * 40 + list(range(40, 80))
    assert made[0] < len(texts), made
