"""The Jaccard join, hard negatives and resampling, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import jaccard, negatives, resample
from tests.llm.conftest import prose
from tests.llm.test_similar import plain_set, planted


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# --- 11 ---------------------------------------------------------------------------------------------------


def plain_groups(texts):
    """(number of the least text reachable, size of the set) of each text."""
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and len(a & b) * 100 >= 80 * len(a | b)]
    root, before = list(range(len(texts))), None
    while root != before:
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return list(zip(root, map(len, sets)))


@pytest.mark.parametrize("frequent,very", [(16, 256), (2, 100), (2, 4), (1, 2)])
def test_groups(spark, texts, frequent, very, monkeypatch):
    """Also where all tokens are frequent, so that signatures are pairs and triples alone."""
    for name, value in (("FREQUENT", frequent), ("VERY_FREQUENT", very), ("VERY_SHARE", 1 << 40), ("LOCAL", 1 if frequent < 16 else 3)):
        monkeypatch.setattr(jaccard, name, value)
    made = planted(random.Random(frequent + very)) + texts
    made += [" ".join(made[0].split()[:k]) for k in range(1, 12)]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    found = [(r["component_id"], r["n_shingles"]) for r in jaccard.jaccard_groups(frame).orderBy("doc_id").collect()]
    assert found == plain_groups(made)


def test_groups_of_odd_rows(docs, empty):
    """Null and repeated ids, and columns with names of the operator's own."""
    rows = rows_of(docs)
    plain = plain_groups([t for _, t in rows])
    least = {}
    for (i, _), (root, _) in zip(rows, plain):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    wanted = [(i, n, least[root] if n else i) for (i, _), (root, n) in zip(rows, plain)]
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in jaccard.jaccard_groups(docs).collect())
    assert jaccard.jaccard_groups(empty).collect() == []
    with pytest.raises(ValueError, match="0.8"):
        jaccard.jaccard_groups(docs, share=(1, 2))


def test_signatures_meet():
    """Similar sets share a signature, whatever tokens are frequent."""
    rng, levels = np.random.default_rng(4), jaccard._levels((4, 5))
    for n in [*range(4, 60), 100, 333, 1000, 4000]:
        for share in (0.0, 0.5, 0.9, 1.0):
            universe = rng.choice(1 << 60, 2 * n, replace=False)
            often = dict(zip(universe.tolist(), np.where(rng.random(2 * n) < share, rng.integers(1, 9, 2 * n), 0).tolist()))
            lost = n // 5 if rng.random() < 0.5 else n // 9
            # Of n tokens lost ones are missing, or replaced as far as the similarity allows.
            a, b = universe[:n], np.r_[universe[: n - lost], universe[n : n + (0 if lost > n // 9 else lost)]]
            assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            made = []
            for tokens in (np.sort(a), np.sort(b)):
                made.append(jaccard.signatures(tokens, np.array([often[t] for t in tokens.tolist()]), 5, (4, 5), levels))
            assert len(b) < 4 or len(np.intersect1d(*made)), (n, share)


# --- 12 ---------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=50):
    sound = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(sound):
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, other) for q, (j, other, w) in enumerate(sound) if q != k]
        for p, j, _ in sorted(s for s in scores if s[2] == label)[:5]:
            fits = sorted(s for s in scores if s[2] != label and -50 * p <= -100 * s[0] <= -95 * p)[:3]
            out += [(i, j, r + 1, x, -p, -s) for r, (s, x, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block,chunk,pack", [(16, 5, 4), (1024, 256, 256)])
def test_negatives(spark, block, chunk, pack, monkeypatch):
    """Repeated ids and rows, a vector that very many rows have, vectors of several lengths, nulls and infinities."""
    monkeypatch.setattr(negatives, "PACK_ZONES", pack)
    rng, rows = random.Random(3), []
    for i in range(500):
        v = [rng.uniform(-1, 1) + i % 3 for _ in range(rng.choice([5, 5, 5, 3, 0]))]
        if v and i % 29 == 0:
            v[0] = (float("nan"), None, float("inf"), -float("inf"))[i % 4]
        rows.append((None if i % 53 == 0 else i // 2 * 10, None if i % 43 == 0 else i % 3, None if i % 41 == 0 else v))
    rows += rows[100:160] + [(50, 1, [1.0, 2.0])] * 30 + [(60, 2, [1.0, 2.0])] * 30
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "v", "block", "chunk", "score")}).repartition(5)
    wanted = plain_negatives([(r["vec_id"], r["label"], r["embedding"]) for r in frame.collect()])
    found = negatives.mine_negatives(frame, F.col("vec_id") % 50 == 0, block_rows=block, chunk_anchors=chunk)
    assert sorted(tuple(r) for r in found.collect()) == wanted and wanted
    assert negatives.mine_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_zone_bounds():
    """Scores lie within their bounds, products are exact also beyond doubles, and the curve moves by one cell."""
    rng = np.random.default_rng(1)
    a, v = rng.integers(-300, 300, (20, 7)), rng.integers(-300, 300, (50, 7))
    low, high = negatives.bounds(a, v.min(0)[None, :], v.max(0)[None, :])
    scores = negatives.products(a, v)
    assert (low <= scores).all() and (scores <= high).all() and (scores == a @ v.T).all()
    big = np.array([[1 << 40, 1], [3, 5]])
    assert negatives.products(big, big)[0, 0] == (1 << 80) + 1
    cells = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    place = negatives.hilbert_index(cells, 3)
    assert sorted(place.tolist()) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


# --- 13 ---------------------------------------------------------------------------------------------------


def plain_resampled(rows, target, percent=10, longest=1):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    made = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for m in made for b in m[2]), Counter(b for x in target for b in features(x)[1])
    total, wanted = float(sum(s.values()) + 10_000), float(sum(t.values()) + 10_000)
    out = []
    for i, n_words, found in made:
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * total / ((s[b] + 1.0) * wanted))) for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("percent,chunk,longest", [(10, 1 << 18, 1), (50, 7, 1), (100, 3, 2)])
def test_resampling(spark, docs, empty, percent, chunk, longest):
    target = [prose(random.Random(k), 40) for k in range(5)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resample(docs, frame, percent=percent, chunk_rows=chunk, longest=longest)
    # Of rows with one id and one score any may come first: here these have equal values.
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_resampled(rows_of(docs), target, percent, longest)
    assert resample.resample(empty, frame).collect() == []
    assert resample.resample(docs, frame.limit(0)).count() == docs.count()


@pytest.mark.parametrize("chunk", [1, 5, 1000])
def test_radix_places(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice([None, -(1 << 63), (1 << 63) - 1, -1, 0, 1, rng.randrange(-9, 9)]), rng.choice([None, rng.randrange(-(1 << 62), 1 << 62), 5]), n) for n in range(60)]
    frame = spark.createDataFrame(rows, "a long, b long, n long").repartition(3)
    keys = [*resample.descending("a"), *resample.ascending("b"), *resample.ascending("n")]
    found = [r["n"] for r in resample.radix_places(frame, keys, chunk).orderBy("place").collect()]
    assert found == [n for _, _, n in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0, r[2]))]
    same = resample.radix_places(frame.select(F.lit(1).alias("x")), resample.ascending("x"), chunk)
    assert sorted(r["place"] for r in same.collect()) == list(range(60))
