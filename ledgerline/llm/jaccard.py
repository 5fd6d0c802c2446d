"""N-gram Jaccard self-join by prefixes of token combinations, exact.

A text is its set of hashed shingles (tokens).  Tokens have classes: rare ones,
and two classes of frequent ones.  All tokens have one order, rare ones first.

A token of class k takes part in signatures of k tokens: a rare token is one
by itself, frequent tokens only in pairs or triples, and only with tokens of
the same small bucket.  A set of n tokens may have up to n - ceil(share * n)
that a similar set lacks, and each of these spoils at most one of the votes of
a prefix: a bucket of p tokens of class k has p - k + 1.  So the prefix grows
until it has one vote more, and two similar sets have a signature in common.
Buckets depend on a level of the size, so that a bucket has a few tokens of a
prefix in small and large sets; a set signs for its level and the next, as a
similar one is at most one level away.

Sets are compared with the least set of each signature first, then with a few
sets drawn from those of a signature and the one with the least share of tokens
of its own; sets that are still in different groups and share a signature are
compared with each other, as far as sizes, parity bits and own tokens allow.  A
group of copies makes few pairs, as nothing is compared inside it.

Own tokens are the rare ones of a prefix that are no other set's signature.  A
set whose rare tokens all sign, or reach as far in their order, has none of
them, so they bound what two sets can have in common; and a set whose own tokens
leave no room for any of the sizes at a signature leaves that signature.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, discard, filtered, map_batches, materialize, small_batches
from .components import connected_components
from .similar import shingles

SHARE = (4, 5)
WORDS = 5
#: A token is frequent from so many sets on, very frequent from so many or a share of all sets.
FREQUENT, VERY_FREQUENT, VERY_SHARE = 16, 256, 500
#: The most frequent tokens that classes are kept for; a token counts in a task that meets it so often.
CLASSED, LOCAL = 1 << 18, 3
#: Sets a task remembers, so that copies are stored once, and tokens it counts at once.
_REMEMBERED, _COUNTED = 200_000, 4_000_000
#: Longs of the parity bits that stand beside signatures; bits of those that stand beside sets, for each of which it is the next power of two over twice its size.
MARK, LEAST_BITS, MOST_BITS = 4, 1 << 10, 1 << 15
#: Least signatures of a set that stand beside each of its signatures, so that a pair that shares many is made once.
FIRST = 8
#: Sets drawn from those of a signature, 16 at most, that the others are compared with before any two are.
LEADS = 16
#: Times that they are drawn; later draws are from signatures that still reach another group.
DRAWS, _DRAW = 3, 0x9E3779B97F4A7C15
#: Parts of the signatures that are counted one after the other, so that only one part is shuffled at a time.
PARTS = 4
#: Where the rare tokens of a prefix end that has all those of its set.
_ALL = (1 << 63) - 1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


#: Tables of this module: their shuffles are large, and of no use once a table is written.
_kept = partial(materialize, tidy=True)


def _levels(share: tuple[int, int]) -> list[int]:
    """Least size of each level: similar sets are on one level or on neighbouring ones."""
    p, q = share
    return [-(-(q**k) // p**k) for k in range(90)]


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29)) ^ np.atleast_1d(np.asarray(b, dtype=np.uint64)) * _MIX[1]) * _MIX[0]
    return h ^ (h >> np.uint64(32))


def _combined(tokens: np.ndarray, bucket: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A hash of every combination of ``size`` (2 or 3) tokens of one bucket; tokens stand in order of their buckets."""
    out, n = [np.zeros(0, dtype=np.uint64)], len(tokens)
    for d in range(1, n):
        same = np.flatnonzero(bucket[d:] == bucket[:-d])
        if not len(same):
            break
        pair = _mixed(_mixed(tokens[same], salt), tokens[same + d])
        if size == 2:
            out.append(pair)
            continue
        for e in range(1, n - d):
            third = same + d + e
            fits = third < n
            fits[fits] = bucket[third[fits]] == bucket[same[fits]]
            if not fits.any():
                break
            out.append(_mixed(pair[fits], tokens[third[fits]]))
    return np.concatenate(out)


def _need(n: int, share: tuple[int, int]) -> int:
    """Votes of a prefix of a set of n tokens."""
    return n - -(-share[0] * n // share[1]) + 1


def signatures(tokens: np.ndarray, often: np.ndarray, very: int, share: tuple[int, int], levels: list[int]) -> np.ndarray:
    """Signatures of a set of sorted ``tokens``; ``often`` is 0 for the rare ones, ``very`` where the third class begins.

    Sets under 4 tokens have none: only equal ones are similar to them.
    """
    n = len(tokens)
    if n < 4:
        return tokens[:0]
    need = _need(n, share)
    rare = tokens[often == 0]
    if len(rare) >= need:
        return rare[:need]
    order = np.argsort(often, kind="stable")[len(rare) :]
    frequent, size = tokens[order].view(np.uint64), 2 + (often[order] >= very)
    spread, own = _mixed(frequent, 1), bisect_right(levels, n) - 1
    out = [rare]
    for level in (own, own + 1):
        least = levels[max(0, level - 1)]
        pairs, triples = max(1, least // 16), max(1, least // 10)
        bucket = np.where(size == 2, spread % np.uint64(pairs), np.uint64(pairs) + spread % np.uint64(triples)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        first = np.r_[True, bucket[by][1:] != bucket[by][:-1]]
        nth = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        votes = np.empty(len(by), dtype=bool)
        votes[by] = nth >= size[by] - 1
        length = int(np.searchsorted(np.cumsum(votes), need - len(rare))) + 1
        by = by[by < length]
        for k in (2, 3):
            mine = by[size[by] == k]
            out.append(_combined(frequent[mine], bucket[mine], k, 4 * level + k).view(np.int64))
    return np.unique(np.concatenate(out))


def parity(tokens: np.ndarray) -> list[int]:
    """Bits that an odd number of the tokens fall on, as longs; the two halves of a longer one fold into a shorter one by XOR."""
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << max(0, 2 * len(tokens) - 1).bit_length()))
    return np.packbits((np.bincount(tokens & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64).tolist()


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def token_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, tokens, doc_id, n) of every row of (doc_id, text), written once: node is a hash of the set of n tokens, which a task stores once."""
    import xxhash

    schema = T.StructType([*_longs("node"), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("doc_id", docs.schema["doc_id"].dataType), *_longs("n")])
    seen: set[int] = set()  # each task has its own copy

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            made = shingles(text, words)
            node = int.from_bytes(xxhash.xxh64_digest(made.tobytes()), "big", signed=True)
            if len(seen) >= _REMEMBERED:
                seen.clear()
            for name, value in zip(schema.names, (node, None if node in seen else made, doc_id, len(made))):
                out[name].append(value)
            seen.add(node)
        return out

    return _kept(map_batches(docs.select("doc_id", "text"), run, schema), "sets")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that most sets have, sorted, with their counts: of all sets, but for tokens that a task meets under LOCAL times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            tokens, often = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=np.int64),) * 2
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[often >= LOCAL], type=pa.int64()) for x in (tokens, often)], names=["token", "often"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            n += len(held[-1])
            if n >= _COUNTED:
                yield flush()
                n = 0
        yield flush()

    small_batches(sets.sparkSession)
    counted = sets.where("tokens is not null").select("tokens").mapInArrow(count, "token long, often long").groupBy("token").agg(F.sum("often").alias("often"))
    table = counted.where(F.col("often") >= FREQUENT).orderBy(F.desc("often"), "token").limit(CLASSED).toPandas().sort_values("token")
    return table["token"].to_numpy(dtype=np.int64), table["often"].to_numpy(dtype=np.int64)


def _signed(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(node, n, parity, keys, rare, end): signatures of the stored sets that can be similar to another one, the first ``rare`` of them tokens, up to ``end`` in their order."""
    known, often = _frequent(sets)
    very, levels = max(VERY_FREQUENT, sets.count() // VERY_SHARE), _levels(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1).flatten().to_numpy()
            count = np.zeros(len(tokens), dtype=np.int64)
            if len(known) and len(tokens):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                count = np.where(known[at] == tokens, often[at], 0)
            ends = np.cumsum(batch.column(2).to_numpy())
            spans = list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()))
            keys, rares, last = [], [], []
            for a, b in spans:
                rare, need = tokens[a:b][count[a:b] == 0], _need(b - a, share)
                last.append(int(rare[need - 1]) if len(rare) >= need else _ALL)
                rares.append(min(len(rare), need))
                keys.append(np.r_[rare[:need], np.setdiff1d(signatures(tokens[a:b], count[a:b], very, share, levels), rare[:need], assume_unique=True)])
            marks = [parity(tokens[a:b]) for a, b in spans]
            longs = pa.list_(pa.int64())
            made = [batch.column(0), batch.column(2), pa.array(marks, type=longs), pa.array(keys, type=longs), pa.array(rares, type=pa.int64()), pa.array(last, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["node", "n", "parity", "keys", "rare", "end"])

    rows = sets.where("tokens is not null and n >= 4").select("node", "tokens", "n")
    return _kept(rows.mapInArrow(run, "node long, n long, parity array<long>, keys array<long>, rare long, end long"), "signed")


def _sharing(signed: DataFrame) -> DataFrame:
    """(node, n, parity, mark, own, end, keys, leads): the sets with signatures that others have, these signatures, and the least set of each."""
    entries = signed.select("node", "rare", F.posexplode("keys").alias("at", "key")).select("node", (F.col("at") < F.col("rare")).alias("token"), "key")
    parts = []
    for part in range(PARTS):
        some = entries.where(F.pmod("key", F.lit(PARTS)) == part)
        # Counted apart and joined back, so that Spark can split the rows of a hot signature.
        several = some.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1").select("key")
        parts.append(_kept(some.join(several, "key"), "shared"))
    shared = reduce(DataFrame.unionByName, parts)
    leads = shared.groupBy("key").agg(F.min("node").alias("lead"))
    met = F.size(F.collect_set(F.when(F.col("token"), F.col("key")))).alias("met")
    # Written before the parity bits come, so that the shuffles of both do not stand at once.
    keyed = _kept(shared.join(leads, "key").groupBy("node").agg(F.collect_set("key").alias("keys"), F.collect_set("lead").alias("leads"), met), "keyed")
    discard(*parts)
    # Parity bits folded to MARK longs still differ in no more bits than the sets in tokens.
    zero = F.lit(0).cast("long")
    fold = lambda i: F.aggregate(F.filter("parity", lambda x, j: j % MARK == i), zero, lambda a, b: a.bitwiseXOR(b))
    marks = F.array(*[fold(i) for i in range(MARK)])
    each = signed.select("node", "n", "parity", marks.alias("mark"), "rare", "end").dropDuplicates(["node"])
    made = _kept(keyed.join(each, "node").withColumn("own", F.col("rare") - F.col("met")).drop("rare", "met"), "sharing")
    discard(keyed)
    return made


def _differing(x: Column, y: Column) -> Column:
    """Differing bits of two parities, the longer one folded to the length of the other; similar sets' lengths are equal or double."""
    half = lambda v, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(v, i).bitwiseXOR(F.element_at(v, i + n)))
    a = F.when(F.size(x) == 2 * F.size(y), half(x, F.size(y))).otherwise(x)
    b = F.when(F.size(y) == 2 * F.size(x), half(y, F.size(x))).otherwise(y)
    return F.aggregate(F.zip_with(a, b, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, n: s + n)


def _room(x: str, share: tuple[int, int]) -> Column:
    """Size, times share[0], of the largest set that is similar to one without its own tokens; ``x`` is a prefix of columns."""
    p, q = share
    return (F.col(f"{x}n") - F.col(f"{x}own")) * (p + q) - F.col(f"{x}n") * p


def _may_be_similar(a: str, b: str, bits: str, share: tuple[int, int]) -> Column:
    """Whether sizes, own tokens and parity bits, in columns with these prefixes, allow similarity: sets that differ in d tokens have at most d differing bits."""
    p, q = share
    # The set whose rare signatures end later, or that has all its rare tokens there, has none of the other's own tokens.
    fits = lambda x, y: (F.col(f"{x}end") > F.col(f"{y}end")) | (F.col(f"{y}n") * p <= _room(x, share))
    x, y = F.col(f"{a}{bits}"), F.col(f"{b}{bits}")
    differ = reduce(lambda s, n: s + n, [F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(MARK)]) if bits == "mark" else _differing(x, y)
    return (F.least(f"{a}n", f"{b}n") * q >= F.greatest(f"{a}n", f"{b}n") * p) & fits(a, b) & fits(b, a) & (differ * (p + q) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (q - p))


def _side(sharing: DataFrame, name: str, bits: str) -> DataFrame:
    return sharing.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "own", "end", bits)])


def _lead_pairs(sharing: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): each set with the least ones of its signatures."""
    pairs = sharing.select(*[F.col(c).alias(f"b_{c}") for c in ("n", "own", "end", "mark")], F.col("node").alias("b"), F.explode("leads").alias("a")).where("a <> b")
    return pairs.join(_side(sharing, "a", "mark"), "a").where(_may_be_similar("a_", "b_", "mark", share)).select("a", "b")


def _mixed_only(entries: DataFrame) -> DataFrame:
    """Those of the ``entries`` (key, root, ...) whose signature more than one group has, written once; asked by the key and its roots alone, as most are of one group."""
    mixed = entries.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return _kept(entries.join(mixed, "key"), "mixed")


def _left(rows: DataFrame, groups: DataFrame, draw: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(node, n, mark, own, end, root, keys, first): the sets of ``rows`` whose signatures reach another group, with these; (key, leads): sets drawn from those of each such signature, none after the last draw."""
    rooted = rows.select("node", "n", "mark", "own", "end", "keys").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    entries = rooted.select("node", "root", "n", "own", "end", F.explode("keys").alias("key"))
    if not draw:
        entries = _mixed_only(entries)
    # A signature whose sets are all in one group has nothing left to compare; of signatures that the same sets have, one is enough.
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"same{i}") for i in range(2)]
    # Nodes are hashes, so the least one after other leading bits are flipped is another set, drawn alike for every signature.
    flips = [F.lit(((i << 60) ^ (draw * _DRAW >> 4)) - (1 << 63)) for i in range(LEADS)]
    names = [f"lead{i}" for i in range(LEADS + 1)] if draw < DRAWS else []
    least = [F.min(F.col("node").bitwiseXOR(f)).bitwiseXOR(f).alias(name) for name, f in zip(names, flips)]
    if names:
        # The set with the least share of own tokens is the most alike to the others.
        least.append(F.min(F.struct((F.col("own") * 1000 / F.col("n")).cast("int"), "node"))["node"].alias(names[-1]))
    bounds = {"least_n": F.min("n"), "least_end": F.min("end")}
    mixed = entries.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("sets"), *same, *least, *[c.alias(name) for name, c in bounds.items()]).where("least <> most")
    found = mixed.groupBy("sets", "same0", "same1").agg(F.min("key").alias("key"), *[F.min(name).alias(name) for name in [*names, *bounds]])
    asked = _kept(found.select("key", *([F.array_distinct(F.array(*names)).alias("leads")] if names else []), *bounds), "keys")
    # Where no other set's rare signatures end before its own, a set's own tokens hold against all of them.
    able = (F.col("end") > F.col("least_end")) | (F.col("least_n") * share[0] <= _room("", share))
    keyed = entries.select("node", "n", "own", "end", "key").join(asked.select("key", *bounds), "key").where(able).groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    left = _kept(rooted.drop("keys").join(keyed, "node").withColumn("first", F.slice("keys", 1, FIRST)), "left")
    if not draw:
        discard(entries)
    return left, asked


def _drawn_pairs(left: DataFrame, asked: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): each set of ``left`` with the drawn sets of its first signatures that are in other groups, so that few sets of a large group are left outside it."""
    # Both sides come to a signature with all that the comparison asks, so that only pairs that pass it are sent on.
    side = lambda name, *more: left.select(*[F.col(c).alias(f"{name}_{c}") for c in ("n", "mark", "own", "end", "root")], F.col("node").alias(name), *more)
    leads = asked.select("key", F.explode("leads").alias("a")).join(side("a"), "a")
    met = side("b", F.explode("first").alias("key")).join(leads, "key")
    return met.where("a_root <> b_root").where(_may_be_similar("a_", "b_", "mark", share)).select("a", "b")


def _rest_pairs(left: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b) of sets in different groups that share a signature, mostly once: at the least one that both have among their first."""
    # The least signature of two sets is never above one that both have first, so each pair is left at one place at least.
    unseen = F.coalesce(F.array_min(F.array_intersect("a.first", "b.first")) >= F.col("a.key"), F.lit(True))
    other = (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    each = left.select("node", "n", "mark", "own", "end", "root", "first", F.explode("keys").alias("key")).hint("merge")
    met = each.alias("a").join(each.alias("b"), (F.col("a.key") == F.col("b.key")) & other & _may_be_similar("a.", "b.", "mark", share) & unseen)
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _verified(pairs: DataFrame, sharing: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose whole sets are similar, each once."""
    p, q = share
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = once.join(_side(sharing, "a", "parity"), "a").join(_side(sharing, "b", "parity"), "b").where(F.least("a_n", "b_n") * q >= F.greatest("a_n", "b_n") * p).where(_may_be_similar("a_", "b_", "parity", share))
    asked = _kept(near.select("a", "b"), "asked")
    nodes = asked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stored = filtered(sets.where("tokens is not null").select("node", "tokens"), bitmap(nodes)).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    whole = _kept(stored, "whole")
    side = lambda name, k: whole.select(F.col("node").alias(name), F.col("tokens").alias(k))
    # |x & y| / |x | y| >= p / q, in whole numbers.
    similar = F.size(F.array_intersect("x", "y")) * (p + q) >= (F.size("x") + F.size("y")) * p
    links = _kept(asked.join(side("a", "x"), "a").join(side("b", "y"), "b").where(similar).select("a", "b"), "links")
    discard(asked, whole)
    return links


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Texts link if the Jaccard similarity of their sets of runs of ``words``
    words (a shorter text is one run) is share[0] / share[1] or more, which is
    0.8 at least; component_id is the smallest id reachable by links, itself
    included.  Sets and tokens are told apart by 64-bit hashes.

    Null, empty and wordless texts have no shingles and link with nothing.
    Long texts count whole.  Rows with a null id are kept and take the smallest
    id of their component, null if there is none; repeated rows are kept; other
    columns are not read; an empty table gives no rows.
    """
    if 5 * share[0] < 4 * share[1] or share[0] > share[1]:
        raise ValueError("the similarity must be from 0.8 to 1")
    sets = token_sets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words)
    signed = _signed(sets, share)
    sharing = _sharing(signed)
    discard(signed)
    links = _verified(_lead_pairs(sharing, share), sharing, sets, share)
    # Groups only grow, so what is left after a round has all signatures that the next one asks.
    before, left = None, sharing
    for draw in range(DRAWS + 1):
        before, (left, asked) = left, _left(left, connected_components(links), draw, share)
        pairs = _drawn_pairs(left, asked, share) if draw < DRAWS else _rest_pairs(left, share)
        links = links.unionByName(_verified(pairs, sharing, sets, share))
        discard(asked, *([before] if draw else []))
    roots = connected_components(links)
    discard(sharing, left)
    least = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = least.select("node", "root").join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    linked = sets.where("n > 0").select("node", "doc_id", "n").join(label, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
