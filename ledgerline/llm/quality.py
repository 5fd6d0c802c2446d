"""Quality rules as a bitmask ledger, in DataFrame functions alone.

``ledger`` measures every text once and stores one failure bit for each rule
beside the measurements.  A policy is a versioned set of rules; applying one,
or asking what it would keep without one of its rules, is bit arithmetic on
the stored mask and never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: (name, failure condition) in bit order; bit i of the mask is rule i.  New rules go to the end, so stored masks stay valid.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 1 and 10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "2 * n_upper > n_letters"),
)
BASE = ("too_few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules: a document is kept if it breaks none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return rule_mask(self.rules)


def rule_mask(names: tuple[str, ...]) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[n] for n in names)


POLICIES: tuple[Policy, ...] = (
    Policy("base", 1, BASE),
    Policy("standard", 1, (*BASE, "short_words", "long_words", "symbols")),
    Policy("standard", 2, tuple(name for name, _ in RULES)),
)
CURRENT = POLICIES[-1]


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Number of words inside windows that occur twice or more.

    Windows are compared by a 64-bit hash.  Only a text with a repeated window
    sorts its (hash, place) pairs: equal neighbours are the repeated windows,
    and each covers the words up to the next one or its own end.
    """

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    def repeated(pairs: Column) -> Column:
        same = F.transform(pairs, lambda p, i: F.when((F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]), p["i"]))
        return _let(F.array_sort(F.filter(same, lambda x: x.isNotNull())), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, repeated))

    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, windows)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements) of every text; a null text has no words and no lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    letters = F.char_length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    upper = F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))
    n_words = lambda words: F.size(words).cast("long")

    def counts(words: Column) -> Column:
        return F.struct(n_words(words).alias("n_words"), _repeat_words(words).alias("n_repeat_words"))

    def line_counts(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    found = src.select(
        "doc_id",
        _let(words, counts).alias("w"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, line_counts).alias("l"),
        letters.cast("long").alias("n_letters"),
        upper.cast("long").alias("n_upper"),
    )
    return found.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_letters", "n_upper")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` with ``failed``: bit i set if the text breaks rule i.

    Each rule is evaluated once for each row, in one pass without a shuffle.
    Null and empty texts have measurements of zero; repeated rows stay; an
    empty table gives an empty ledger.
    """
    mask = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("failed", mask)


def apply_policy(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Ledger rows with ``base_failed`` and ``kept`` under ``policy``; base rules always count."""
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask).cast("long")) != 0
    base = hit(rule_mask(BASE))
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & ~hit(policy.mask))


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: documents that break it, that break it alone, and that stay without it.

    The ledger is first counted by mask, of which there are at most two to the
    number of rules; everything after works on those counts.
    """
    masks = entries.groupBy("failed").agg(F.count("*").alias("n"))
    rows = [(p.name, p.version, p.mask, r, rule_mask((r,))) for p in policies for r in p.rules]
    asked = entries.sparkSession.createDataFrame(rows, "policy string, version int, policy_mask long, rule string, rule_bit long")
    hit = F.col("failed").bitwiseAND(F.col("policy_mask"))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    paired = asked.join(masks, F.lit(True))  # both sides are bounded by the number of rules
    return paired.groupBy("policy", "version", "rule").agg(
        count(F.col("failed").bitwiseAND(F.col("rule_bit")) != 0).alias("n_failed"),
        count(hit == F.col("rule_bit")).alias("n_failed_alone"),
        count(hit == 0).alias("n_kept"),
        count(hit.bitwiseAND(F.bitwise_not("rule_bit")) == 0).alias("n_kept_without"),
    )
