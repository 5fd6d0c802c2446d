"""Drawn sets are compared where signatures meet: pairs that are not similar are not shuffled."""

from __future__ import annotations

import random

from ledgerline.llm import jaccard


def shuffled(frame) -> int:
    """Rows that the shuffles of an executed plan without adaptive execution have written."""

    def walk(node) -> int:
        own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    frame.collect()
    return walk(frame._jdf.queryExecution().executedPlan())


def test_drawn_sets_are_compared_before_any_shuffle_of_pairs(spark, monkeypatch):
    rng, base = random.Random(4), [f"w{i}" for i in range(400)]

    def edited(name: str, edits: int) -> str:
        words = list(base)
        for at in rng.sample(range(4, 396, 6), edits):
            words[at] = f"{name}x{at}"
        return " ".join(words)

    # 30 texts with 2 changed words are one group; 20 with 8 are just under 0.8 to it.
    texts = [edited(f"a{i}", 2) for i in range(30)] + [edited(f"b{i}", 8) for i in range(20)]
    seen, drawn = [], jaccard._drawn_pairs

    def counted(left, asked, share):
        given = left.count() * (2 + jaccard.FIRST) + asked.selectExpr("coalesce(sum(size(leads)), 0) * 2").first()[0] + len(texts)
        seen.append((shuffled(drawn(left, asked, share)), given))
        return drawn(left, asked, share)

    monkeypatch.setattr(jaccard, "_drawn_pairs", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(frame).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and want[i] != want[j]:
                gone, kept = max(want[i], want[j]), min(want[i], want[j])
                want = [kept if w == gone else w for w in want]
    assert found == dict(enumerate(want))
    assert seen[0][0] > 0 and all(rows <= given for rows, given in seen), seen
