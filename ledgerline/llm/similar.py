"""Near copies by exact Jaccard similarity of word shingles: SimHash trees first, prefix filtering for the rest.

A text is the set of its hashed shingles, in one order that holds for the whole
corpus: shingles that a sample shows in several texts (hot ones) come last.

1. Two sets of similarity ``share`` or more have ``_floor(n)`` shingles in
   common among the first ``prefix_length(n)`` of each, for the n of either.  A
   text with fewer shingles in its prefix that any other prefix has is done.
2. Of the texts left, whole sets are counted: one without a share of shingles
   that others have as well is done, too.  The rarest of these shingles, just
   so many that a partner must have one of them, are the text's keys.
3. The vantage-point trees of ``simhash`` propose pairs within a few bits.  64
   bits cannot reach all pairs of the similarity asked for, so each text is also
   compared with a few texts that share a key.  Each set has parity bits: a
   shingle flips one of them, so two sets differ in as many shingles as bits at
   least.  Pairs that these allow are compared on their whole sets, and the
   components of the links are groups.
4. Texts of different groups that share a key are compared as well.  A large
   group of copies makes few pairs, as inside a group none are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, discard, filtered, keep_least, map_batches, materialize
from .components import connected_components
from .simhash import link_fingerprints, majority

#: Similarity from which on two texts are near copies, as a fraction of whole numbers.
SHARE = (4, 5)
WORDS = 5
#: A prefix is longer than it has to be by n / SLACK, so that partners have several shingles of it in common.
SLACK = 20
#: Differing bits up to which the trees propose pairs.
RADIUS = 5
#: Texts whose shingles the order is taken from, and shingles that are told apart by it, at most.
ORDER_TEXTS, ORDER_SHINGLES = 4_000, 500_000
#: Orders in which keys choose the text that the others with the key are compared with.
LEADS = 4
#: Longs of parity bits of a set.
PARITY = 16
#: Tables of this module: their shuffles are large, and of no use once a table is written.
_kept = partial(materialize, tidy=True)
#: Sets that a task remembers, so that copies send their prefix once.
_REMEMBERED = 200_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``words`` words, sorted; a shorter text is one run, one without words has none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    starts = list(accumulate(map(len, tokens), lambda a, b: a + b + 1, initial=0))
    digests = [digest(joined[a : b - 1]) for a, b in zip(starts, starts[words:])] or [digest(joined)]
    return np.unique(np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64))


def prefix_length(n: int, share: tuple[int, int] = SHARE) -> int:
    """How many of n shingles, in the common order, make the prefix."""
    return n - -(-share[0] * n // share[1]) + -(-n // SLACK)


def _floor(n: Column, share: tuple[int, int]) -> Column:
    """Shingles that the prefix of a set of n and that of any partner have in common at least."""
    return F.ceil(n * share[0] / (share[1] * SLACK))


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least two sampled texts, sorted, and the number of texts of each."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(max(1, n // ORDER_TEXTS))) == 0).select("text")
    schema = T.StructType([T.StructField("s", T.ArrayType(T.LongType()))])
    each = map_batches(some, lambda b: {"s": [shingles(t, words) for t in set(b["text"])]}, schema)
    counted = each.select(F.explode("s").alias("s")).groupBy("s").count().where("count > 1")
    table = counted.orderBy(F.desc("count"), "s").limit(ORDER_SHINGLES).toPandas().sort_values("s")
    return table["s"].to_numpy(dtype=np.int64), table["count"].to_numpy(dtype=np.int64)


def _node(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes()), "big", signed=True)


_COUNTED = T.StructType([T.StructField("key", T.LongType()), T.StructField("often", T.LongType())])


def _splitter(common: np.ndarray, often: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, list[dict]]]:
    """A function from shingles to those that are not hot, and to the hot ones with their counts in the sample, least first."""

    def split(hashes: np.ndarray) -> tuple[np.ndarray, list[dict]]:
        if not len(common) or not len(hashes):
            return hashes, []
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, often[at], 0)
        by = np.argsort(rank, kind="stable")
        cold = int((rank == 0).sum())
        return hashes[by[:cold]], [{"key": int(h), "often": int(c)} for h, c in zip(hashes[by[cold:]], rank[by[cold:]])]

    return split


def _prefixes(docs: DataFrame, words: int, share: tuple[int, int], split) -> DataFrame:
    """(doc_id, digest, node, n, fp, keys, hot) of every row of (doc_id, text), written once.

    node is a hash of the set of n shingles, fp its SimHash; keys and hot are its
    prefix, hot shingles apart.  Of equal sets a task gives the prefix of the first.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("digest", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("hot", T.ArrayType(_COUNTED)),
    ])
    seen: set[int] = set()  # each task has its own copy

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in schema.names}
        for doc_id, digest, text in zip(batch["doc_id"], batch["digest"], batch["text"]):
            made = shingles(text, words)
            node, most = _node(made), prefix_length(len(made), share)
            cold, hot = ([], []) if node in seen else split(made)
            if len(seen) >= _REMEMBERED:
                seen.clear()
            seen.add(node)
            for name, value in zip(schema.names, (doc_id, digest, node, len(made), majority(made.astype(">i8").tobytes()), cold[:most], hot[: max(0, most - len(cold))])):
                out[name].append(value)
        return out

    return _kept(map_batches(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text"), run, schema), "prefixes")


def _candidates(held: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, n, fp) of the sets whose prefix has enough shingles that another prefix has."""
    entries = held.select("node", F.explode("keys").alias("key"))
    # Hot shingles are left out, so no key is that of a large part of all texts.
    same_key = Window.partitionBy("key")
    shared = entries.select("node", "key", F.min("node").over(same_key).alias("lead"), F.max("node").over(same_key).alias("last")).where("lead <> last")
    by_node = shared.groupBy("node").agg(F.count_distinct("key").alias("s"))
    nodes = held.where(F.size("keys") + F.size("hot") > 0).groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.max(F.size("hot")).alias("h"))
    found = nodes.join(by_node, "node", "left").where(F.coalesce("s", F.lit(0)) + F.col("h") >= _floor(F.col("n"), share))
    return _kept(found.select("node", "n", "fp"), "candidates")


def parity(hashes: np.ndarray) -> list[int]:
    """Bits that an odd number of the shingles fall on."""
    bits = np.bincount(hashes & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _sets(docs: DataFrame, held: DataFrame, nodes: DataFrame, words: int, split) -> DataFrame:
    """(node, parity, cold, hot) of ``nodes``, from one text of each: the shingles, hot ones apart."""
    who = _kept(held.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.xxhash64("doc_id", "digest")).alias("who")).select("who"), "who")
    keyed = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("who"), "text")
    some = filtered(keyed, bitmap(who)).join(who, "who", "left_semi").dropDuplicates(["who"]).select("text")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("parity", longs), T.StructField("cold", longs), T.StructField("hot", T.ArrayType(_COUNTED))])

    def run(batch: dict[str, list]) -> dict[str, list]:
        made = [shingles(t, words) for t in batch["text"]]
        cold, hot = zip(*map(split, made)) if made else ((), ())
        return {"node": [_node(m) for m in made], "parity": [parity(m) for m in made], "cold": cold, "hot": hot}

    made = _kept(map_batches(some, run, schema), "sets")
    discard(who)
    return made


def _ranked(sets: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, n, s, fp, parity, keys): s of the n shingles are shared with other candidates, keys are the rarest of these."""
    # One shuffle; hot shingles are left out here as well.
    entries = sets.select("node", F.explode("cold").alias("key"))
    counted = entries.withColumn("df", F.count("*").over(Window.partitionBy("key"))).where("df > 1")
    cold = counted.select("node", F.struct(F.lit(False).alias("hot"), "df", "key").alias("k"))
    by_node = cold.groupBy("node").agg(F.collect_list("k").alias("ks"))
    hot = F.transform("hot", lambda h: F.struct(F.lit(True).alias("hot"), h["often"].alias("df"), h["key"].alias("key")))
    own = sets.select("node", "parity", hot.alias("h"))
    ks = F.array_sort(F.concat(F.coalesce("ks", F.array().cast(own.schema["h"].dataType)), F.col("h")))
    whole = nodes.join(own, "node").join(by_node, "node", "left").select("node", "n", "fp", "parity", ks.alias("ks"))
    least = F.ceil(F.col("n") * share[0] / share[1]).cast("int")
    chosen = F.transform(F.slice("ks", F.lit(1), F.size("ks") - least + 1), lambda k: k["key"])
    return _kept(whole.where(F.size("ks") >= least).select("node", "n", F.size("ks").alias("s"), "fp", "parity", chosen.alias("keys")), "ranked")


def _tree_pairs(ranked: DataFrame) -> DataFrame:
    """(a, b) of the sets whose fingerprints the vantage-point trees link, and of those with one fingerprint."""
    least = _kept(ranked.groupBy("fp").agg(F.min("node").alias("lead")), "points")
    links = link_fingerprints(least.select("fp"), RADIUS)
    near = links.join(least.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return near.unionByName(ranked.join(least, "fp").select(F.col("lead").alias("a"), F.col("node").alias("b")))


def _lead_pairs(ranked: DataFrame) -> DataFrame:
    """(a, b): each set with one of those that have the key, for each of its keys; keys choose in LEADS different orders."""
    entries = ranked.select("node", F.explode("keys").alias("key"))
    lead = entries.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.pmod("key", F.lit(LEADS)))).alias("lead"), F.count("*").alias("df")).where("df > 1")
    return entries.join(lead, "key").select(F.col("lead").alias("a"), F.col("node").alias("b"))


def _rest_pairs(ranked: DataFrame, groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b) of sets in different groups that share a key, each found at the first key they share."""
    named = ranked.join(groups, "node", "left").select("node", "n", "s", "parity", "keys", F.coalesce("root", "node").alias("root"), F.posexplode("keys").alias("at", "key"))
    # A key whose texts are all in one group has nothing left to compare.
    mixed = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    left = _kept(named.join(mixed, "key").withColumn("before", F.slice("keys", F.lit(1), F.col("at"))).drop("keys", "at"), "left")
    other = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    first = ~F.arrays_overlap("a.before", "b.before")
    met = left.alias("a").join(left.alias("b"), (F.col("a.key") == F.col("b.key")) & other & _plausible("a.", "b.", share) & first)
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _plausible(one: str, two: str, share: tuple[int, int]) -> Column:
    """Whether sizes, shared shingles and parity bits, in columns with these prefixes, allow two sets to be similar."""
    p, q = share
    total = F.col(f"{one}n") + F.col(f"{two}n")
    differ = sum((F.bit_count(F.col(f"{one}parity")[i].bitwiseXOR(F.col(f"{two}parity")[i])) for i in range(1, PARITY)), F.bit_count(F.col(f"{one}parity")[0].bitwiseXOR(F.col(f"{two}parity")[0])))
    return (total * p <= F.least(f"{one}s", f"{two}s") * (p + q)) & (differ * (p + q) <= total * (q - p))


def _confirmed(pairs: DataFrame, ranked: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose whole sets are similar, each once."""
    p, q = share
    once = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = lambda name: ranked.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "s", "parity")))
    asked = _kept(once.join(one("a"), "a").join(one("b"), "b").where(_plausible("a_", "b_", share)).select("a", "b"), "asked")
    side = lambda name, k: sets.select(F.col("node").alias(name), F.concat("cold", F.transform("hot", lambda h: h["key"])).alias(k))
    # |x & y| / |x | y| >= p / q, in whole numbers.
    similar = F.size(F.array_intersect("x", "y")) * (p + q) >= (F.size("x") + F.size("y")) * p
    return _kept(asked.join(side("a", "x"), "a").join(side("b", "y"), "b").where(similar).select("a", "b"), "links")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, digest, root) for every row: rows share a root if a chain of near copies joins their texts.

    Near copies are texts whose sets of shingles have Jaccard similarity of at
    least share[0] / share[1]; sets and shingles are told apart by 64-bit hashes.
    Null and empty texts and those without words are copies of each other; long
    texts are compared whole; repeated rows have one root; an empty table gives
    no rows.  digest is the hash of the text.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    split = _splitter(*_common(src, words))
    held = _prefixes(src, words, share, split)
    nodes = _candidates(held, share)
    sets = _sets(src, held, nodes, words, split)
    ranked = _ranked(sets, nodes, share)
    links = _confirmed(_tree_pairs(ranked).unionByName(_lead_pairs(ranked)), ranked, sets, share)
    first = connected_components(links)
    more = _confirmed(_rest_pairs(ranked, first, share), ranked, sets, share)
    roots = connected_components(first.toDF("a", "b").unionByName(more))
    discard(nodes, sets, ranked, links, more)
    return held.select("doc_id", "digest", "node").join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of smallest id; columns unchanged, as in ``keep_least``."""
    return keep_least(docs, similar_groups(docs, id_col, text_col, **options), id_col, text_col)
