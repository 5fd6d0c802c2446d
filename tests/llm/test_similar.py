"""Near copies by Jaccard similarity, against comparing all texts with all."""

from __future__ import annotations

import random

import corpus_pipeline
from ledgerline.llm import similar
from tests.llm.conftest import prose


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(texts):
    """Number of the least text reachable, for each text."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (not a and not b) or (a and b and len(a & b) * 5 >= 4 * len(a | b))]
    for _ in links:
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return root


def planted(rng):
    """Texts with copies around the threshold, chains, a shared passage and a dense group."""
    made, passage = [], prose(rng, 40)
    for k in range(30):
        base = prose(rng, rng.randint(4, 150)).split()
        made.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            made.append(" ".join(copy))
        made.append(f"{' '.join(base[:20])} {passage}")
    chain = prose(rng, 60).split()
    for i in range(12):
        made.append(" ".join(chain[: 60 - i] + [f"tail{j}" for j in range(i)]))
    return made


def test_groups_are_exact(spark, texts):
    made = planted(random.Random(11)) + texts
    root = plain_roots(made)
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    kept = similar.drop_similar(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert similar.drop_similar(frame.limit(0)).count() == 0


def test_stage_drops_near_copies(spark):
    """Copies at similarity 0.8 and more go, also those that differ in more than 4 bits of a SimHash."""
    made = planted(random.Random(12))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_dedup(spark, frame, "")
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(set(plain_roots(made)))


def test_repeated_and_missing_ids(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(1, a), (2, b), (2, a), (2, b), (None, c), (None, c + " end"), (None, a), (None, c)]
    kept = [(r["doc_id"], r["text"]) for r in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 3 and (1, a) in kept and (2, b) in kept and sum(i is None for i, _ in kept) == 1
