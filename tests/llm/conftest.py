from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


def prose(rng: random.Random, n: int) -> str:
    """n invented words, some in lines."""
    words = ["".join(rng.choice(["an", "re", "th", "ou", "it", "es", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.05 else " ") for w in words).strip()


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Odd and ordinary texts: null, empty, blank, short, repeated, near copies, long, many scripts."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 300)) for _ in range(40)]
    passage = prose(rng, 120)
    near = [b.replace(" ", " x ", 1) for b in base[:6]]
    inside = [f"{b[:150]} {passage} {b[150:400]}" for b in base[6:14]]
    odd = [None, "", " \n\t ", "a", "one two three", "A b C d", "!!! ... ###", "naïve Straße ΣΊΣΥΦΟΣ 日本語 и ещё", "x" * 2000, "ab " * 900, "\0\x85\x1c a", passage, passage[:380], passage + passage]
    return base + near + inside + odd + base[:5] + [base[0]] * 4 + [prose(rng, 6000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids; two rows without an id, one id twice, and columns that operators use themselves."""
    rows = [(None if i in (3, 8) else i if i != 9 else 10, t, "en" if i % 3 else None, "s0", 1, "k", i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, fp int")
    taken = ("key", "_key", "spans", "_spans", "name", "digest", "text_digest", "node", "root", "items", "n_hit", "found", "terms", "score", "predicted", "_id", "k1", "kept", "window", "size")
    return frame.withColumns({c: F.concat(F.lit(c), "fp") for c in taken}).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
