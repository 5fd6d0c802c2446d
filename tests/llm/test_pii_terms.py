"""Words that give an identifier away, beside a plain count over all texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from ledgerline.llm import pii
from tests.llm.conftest import prose


def marked(spark, made, **options):
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    return {r["doc_id"]: [made[r["doc_id"]][s["start"] : s["end"]] for s in r["terms"]] for r in pii.find_personal_data(frame, **options).collect()}


def common_texts(n):
    """Texts of few different words, which stand in many of them."""
    rng = random.Random(21)
    words = sorted(set(prose(rng, 25).split()))
    return [" ".join(rng.choice(words) for _ in range(60)) for _ in range(n)]


def test_terms_beside_a_single_identifier(spark):
    made = common_texts(200)
    made[7] += " the zebrafish keeper wrote from one@mail.example"
    made += ["the keeper wrote from home"] * 30
    found = marked(spark, made)
    assert found.pop(7) == ["zebrafish"] and not any(found.values())


def plain_terms(made):
    """Revealing words of each text, each time they stand there, by counting all words with all identifiers."""
    found = [pii.identifiers(t) for t in made]
    entities = [{t[a:b] for _, a, b in fs} for t, fs in zip(made, found)]
    everywhere = Counter(w for t in made for w in set(re.findall(r"[^\W_]+", t.lower())))
    outside = [[m.group() for m in re.finditer(r"[^\W_]+", t) if len(m.group()) >= 3 and not any(m.start() < b and a < m.end() for _, a, b in fs)] for t, fs in zip(made, found)]
    n_entity = Counter(e for es in entities for e in es)
    n_both = Counter((e, w) for es, ws in zip(entities, outside) for e in es for w in {w.lower() for w in ws})

    def reveals(e, w):
        p = n_entity[e] / len(made)
        given = min(1.0, (n_both[e, w] + p) / (everywhere[w] + 1))
        return math.log(given / p) / -math.log(p) >= pii.DISCLOSURE

    return {i: [w for w in ws if any(reveals(e, w.lower()) for e in es)] for i, (es, ws) in enumerate(zip(entities, outside))}


def test_terms_of_whole_texts(spark):
    """Far from the identifier, and at each mention."""
    made = common_texts(200)
    made[3] = f"Zebrafish first. {made[3]} from one@mail.example {made[4]} and the zebrafish again"
    found = marked(spark, made)
    assert found.pop(3).count("zebrafish") == 1 and "Zebrafish" in marked(spark, made)[3] and not any(found.values())


def test_terms_against_a_plain_count(spark):
    rng = random.Random(22)
    made = [prose(rng, rng.randint(5, 80)) for _ in range(150)]
    people = [f"p{k}@mail.example" for k in range(6)]
    for _ in range(40):
        i, k = rng.randrange(len(made)), rng.randrange(6)
        made[i] = f"word{k} {made[i]} {people[k]} then {rng.choice(people)} and +49 30 1234567{k} trait{k}"
    made += [made[5], "", f"only {people[0]}"]
    assert marked(spark, made) == plain_terms(made)
