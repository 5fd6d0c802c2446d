"""Removal of byte strings that occur more than once, by sorting suffixes.

A string of LENGTH bytes has one anchor: the least K-gram hash in it, the last
of equals.  Equal strings have their anchors at the same place, so only the
suffixes at anchors are sorted, a few for each hundred bytes.

1. Anchors whose K-gram occurs once end here.  An anchor whose whole context
   (all bytes that a string with this anchor can have) occurs twice is repeated
   as it stands, and one of its occurrences stands for all from here on.
2. The other contexts are sorted by their suffix from the anchor: each task
   sorts its own into runs, sends them front-coded by range, and a loser tree
   that knows common prefixes merges the runs of a range.
3. In merged order, a K-gram's suffixes are neighbours, and the least common
   prefix between two places is their match to the right; the match to the left
   comes from the bytes before the anchor.  Where both add up to LENGTH, the
   strings in between are repeated.  A K-gram with more than CROWDED contexts
   would crowd the task that merges it: its strings are hashed and counted.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW_ROWS, bitmap, filtered, map_batches, materialize, small_batches

LENGTH = 400
K = 32
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20
#: Suffixes of a run, and of a range, about.
RUN_ROWS = 50_000
RANGE_ROWS = 20_000
#: K-grams with more contexts than this are not gathered in one task but counted string by string.
CROWDED = 50_000
#: K-grams with up to this many contexts are compared pair by pair, others length by length.
PAIRWISE = 24

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        made = []
        for base in (_P, _INVERSE):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


def window_anchors(data: bytes, length: int = LENGTH, k: int = K) -> np.ndarray:
    """Place of the anchor of each ``length``-byte string of ``data`` (which fits in memory several times over)."""
    n = len(data)
    if n < length:
        return np.empty(0, dtype=np.int64)
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    grams = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams &= np.uint64(0xFFFFFFFF00000000)
    # The low half counts down, so that of equal hashes the last is least.
    grams |= np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
    w = length - k + 1
    blocks = np.full(-(-len(grams) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[: len(grams)] = grams
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    return (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def anchors(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): each anchor with the first and last string start that it stands for."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        place = window_anchors(data[at : at + CHUNK + length - 1], length, k)
        if not len(place):
            continue
        turn = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        first, last = at + turn, at + np.concatenate([turn[1:] - 1, [len(place) - 1]])
        place = at + place[turn]
        if parts and parts[-1][0][-1] == place[0]:
            parts[-1][2][-1] = last[0]
            place, first, last = place[1:], first[1:], last[1:]
        parts.append((place, first, last))
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts))


def context(data: bytes, place: int, length: int = LENGTH, k: int = K) -> tuple[bytes, bytes]:
    """(bytes before the anchor, bytes from it on) that strings with this anchor can have."""
    return data[max(0, place - (length - k)) : place], data[place : place + length]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are not compared."""
    end = min(len(a), len(b))
    step = 16
    while known < end and a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    if known >= end:
        return end
    low, high = known, min(end, known + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def front_code(suffixes: list[bytes], extras: list[bytes]) -> bytes:
    """A sorted run as one string: for each suffix its common prefix with the one before, its remaining bytes and its extra bytes."""
    out, last = [], b""
    for suffix, extra in zip(suffixes, extras):
        shared = common_prefix(last, suffix)
        tail = suffix[shared:]
        out.append(struct.pack("<III", shared, len(tail), len(extra)) + tail + extra)
        last = suffix
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(common prefix with the one before, suffix, extra) of a front-coded run."""
    at, last = 0, b""
    while at < len(run):
        shared, n, m = struct.unpack_from("<III", run, at)
        at += 12
        last = last[:shared] + run[at : at + n]
        yield shared, last, run[at + n : at + n + m]
        at += n + m


def merge_runs(runs: list[Iterator[tuple[int, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge sorted runs with a loser tree: (common prefix with the one before, suffix, extra) in order.

    Every contender knows its common prefix with the last winner.  The longer
    one wins a match without a look at the bytes; of equal ones only the bytes
    behind the known prefix are compared, and the loser keeps what was found.
    """
    size = 1
    while size < len(runs):
        size *= 2
    head: list[tuple[int, bytes, bytes] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size
    loser = [0] * size

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        shared = common_prefix(x[1], y[1], known[a])
        if x[1][shared : shared + 1] <= y[1][shared : shared + 1]:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    def play(node: int) -> int:
        if node >= size:
            return node - size
        won, lost = match(play(2 * node), play(2 * node + 1))
        loser[node] = lost
        return won

    winner = play(1) if size > 1 else 0
    while head[winner] is not None:
        _, suffix, extra = head[winner]
        yield known[winner], suffix, extra
        head[winner] = next(runs[winner], None) if winner < len(runs) else None
        known[winner] = head[winner][0] if head[winner] is not None else 0
        node = (winner + size) // 2
        while node:
            winner, loser[node] = match(winner, loser[node])
            node //= 2


def _suffix_prefix(a: bytes, b: bytes) -> int:
    """Length of the common ending."""
    return common_prefix(a[::-1], b[::-1])


def repeated_starts(shared: list[int], lefts: list[bytes], rights: list[bytes], spans: list[tuple[int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Distances before the anchor at which strings are repeated, for the contexts of one K-gram in sorted order.

    shared[i] is the common prefix of rights i - 1 and i, spans[i] the least and
    greatest distance that context i stands for.  A list of (least, greatest) each.
    """
    m = len(lefts)
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]

    def note(i: int, low: int, high: int) -> None:
        low, high = max(low, spans[i][0]), min(high, spans[i][1])
        if low <= high:
            found[i].append((low, high))

    if m <= PAIRWISE:
        turned = [x[::-1] for x in lefts]
        for i in range(m):
            right = len(rights[i])
            for j in range(i + 1, m):
                right = min(right, shared[j])
                left = common_prefix(turned[i], turned[j])
                if left + right >= length:
                    note(i, length - right, left)
                    note(j, length - right, left)
        return found
    lcp = np.array(shared, dtype=np.int64)
    lcp[0] = 0
    sizes = np.array([len(x) for x in lefts])
    most = int(sizes.max(initial=0))
    before = np.zeros((m, most), dtype=np.uint8)
    for i, x in enumerate(lefts):
        before[i, : len(x)] = np.frombuffer(x[::-1], dtype=np.uint8)
    low, high = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
    hashed = np.zeros(m, dtype=np.uint64)
    for distance in range(0, int(high.max()) + 1):
        if distance:
            if distance > most:
                break
            hashed = hashed * np.uint64(_P) + before[:, distance - 1] + np.uint64(1)
        block = np.cumsum(lcp < length - distance)
        able = np.flatnonzero(sizes >= distance)
        key = (hashed[able] ^ (hashed[able] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + block[able].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(able), dtype=bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        for i in able[twice]:
            if low[i] <= distance <= high[i]:
                if found[i] and found[i][-1][1] == distance - 1:
                    found[i][-1] = (found[i][-1][0], distance)
                else:
                    found[i].append((distance, distance))
    return found


#: Packed before the left bytes of a suffix: gram, around, low, high.
_EXTRA = "<qqII"


def _anchor_table(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(k1, k2, gram, around, place, first, last) of every anchor of every text, written once."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "gram", "around", "place", "first", "last")])
    names = schema.names
    long = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda raw: xxhash.xxh3_64_intdigest(raw) - (1 << 63)
        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                part = batch.slice(at, ARROW_ROWS)
                out: list[list] = [[] for _ in names]
                for k1, k2, text in zip(*(c.to_pylist() for c in part.columns)):
                    data = text.encode()
                    place, first, last = anchors(data, length, k)
                    for p in place.tolist():
                        left, right = context(data, p, length, k)
                        out[2].append(digest(right[:k]))
                        out[3].append(digest(struct.pack("<I", len(left)) + left + right))
                    out[0] += [k1] * len(place)
                    out[1] += [k2] * len(place)
                    for column, values in zip(out[4:], (place, first, last)):
                        column += values.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, type=long) for c in out], names=names)

    small_batches(docs.sparkSession)
    return materialize(docs.where(F.octet_length("text") >= length).select("k1", "k2", "text").mapInArrow(run, schema), "anchors")


def _contexts(docs: DataFrame, asked: DataFrame, length: int, k: int) -> DataFrame:
    """(gram, around, low, high, left, right): the bytes of one occurrence of each asked context."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("gram", "around", "low", "high")] + [T.StructField(n, T.BinaryType()) for n in ("left", "right")])
    by_doc = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "around", "place", "first", "last")).alias("at"))
    texts = filtered(docs.select("k1", "k2", "text"), bitmap(by_doc.select("k1"))).dropDuplicates(["k1", "k2"])

    def cut(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for text, at in zip(batch["text"], batch["at"]):
            data = text.encode()
            for a in at:
                left, right = context(data, a["place"], length, k)
                for name, value in zip(schema.names, (a["gram"], a["around"], a["place"] - a["last"], a["place"] - a["first"], left, right)):
                    out[name].append(value)
        return out

    return materialize(map_batches(texts.join(by_doc, ["k1", "k2"]).select("text", "at"), cut, schema), "contexts")


def _sorted_matches(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """(gram, around, low, high): distances before the anchor at which a context's strings are repeated."""
    n = contexts.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    # For the borders; the hash thins the rows out first, as every task sends its share to the driver.
    some = contexts.where(F.pmod(F.xxhash64("around"), F.lit(max(1, n // 40_000))) == 0)
    sample = some.select(F.substring("right", 1, k).alias("head"), "around").orderBy(F.xxhash64("around"), "around").limit(20_000).select("head").toPandas()["head"]
    heads = sorted(bytes(h) for h in sample)
    # A range begins at a K-gram, so that all suffixes of one are in one range.
    borders = sorted({heads[len(heads) * i // ranges] for i in range(1, ranges)}) if heads else []

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        held: list[tuple[bytes, bytes]] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            parts: dict[int, tuple[list, list]] = {}
            for suffix, extra in held:
                lists = parts.setdefault(bisect_right(borders, suffix[:k]), ([], []))
                lists[0].append(suffix)
                lists[1].append(extra)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(parts), type=pa.int32()), pa.array([front_code(*v) for v in parts.values()], type=pa.binary())], names=["range", "run"])

        for batch in batches:
            for gram, around, low, high, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((right, struct.pack(_EXTRA, gram, around, low, high) + left))
            if len(held) >= RUN_ROWS:
                yield flush()
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], []]

        def close(group: list[tuple[int, bytes, bytes]]) -> None:
            if len(group) < 2:
                return
            extras = [struct.unpack_from(_EXTRA, g[2]) for g in group]
            hits = repeated_starts([g[0] for g in group], [g[2][struct.calcsize(_EXTRA) :] for g in group], [g[1] for g in group], [(e[2], e[3]) for e in extras], length)
            for (gram, around, _, _), ranges_ in zip(extras, hits):
                for low, high in ranges_:
                    for column, value in zip(out, (gram, around, low, high)):
                        column.append(value)

        group: list[tuple[int, bytes, bytes]] = []
        for entry in merge_runs([read_run(r) for r in table.column("run").to_pylist()]):
            if group and entry[0] < k:
                close(group)
                group = []
            group.append(entry)
        close(group)
        return pa.Table.from_arrays([pa.array(c, type=pa.int64()) for c in out], names=["gram", "around", "low", "high"])

    runs = contexts.select("gram", "around", "low", "high", "left", "right").mapInArrow(make_runs, "range int, run binary")
    return runs.groupBy("range").applyInArrow(merge, "gram long, around long, low long, high long")


def _counted_matches(contexts: DataFrame, length: int) -> DataFrame:
    """What ``_sorted_matches`` finds, by counting the strings themselves; for K-grams whose contexts would crowd one task."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("gram", "around", "low", "string")])

    def spell(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for gram, around, low, high, left, right in zip(*(batch[n] for n in ("gram", "around", "low", "high", "left", "right"))):
            data = left + right
            for distance in range(low, high + 1):
                start = len(left) - distance
                for name, value in zip(schema.names, (gram, around, distance, xxhash.xxh3_64_intdigest(data[start : start + length]) - (1 << 63))):
                    out[name].append(value)
        return out

    strings = map_batches(contexts, spell, schema)
    twice = strings.groupBy("gram", "low", "string").agg(F.count("*").alias("n")).where("n > 1").select("gram", "low", "string")
    return strings.join(twice, ["gram", "low", "string"], "left_semi").select("gram", "around", "low", F.col("low").alias("high"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """docs (k1, k2, text) -> (k1, k2, spans): maximal byte ranges covered by strings of ``length`` bytes that start elsewhere too."""
    table = _anchor_table(docs, length, k)
    # Written tables on both sides let Spark split the join's partition of a very frequent K-gram.
    often = materialize(table.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "often")
    candidates = materialize(table.join(often, "gram", "left_semi"), "candidates")
    one = F.min(F.struct("k1", "k2", "place", "first", "last")).alias("one")
    around = materialize(candidates.groupBy("gram", "around").agg(F.count("*").alias("n"), one), "around")
    several = materialize(around.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "several")
    asked = around.join(several, "gram", "left_semi").select("gram", "around", "one.*")
    contexts, crowded = _contexts(docs, asked, length, k), several.where(F.col("m") > CROWDED).select("gram")
    if crowded.isEmpty():
        matches = _sorted_matches(contexts, length, k)
    else:
        crowded = materialize(crowded, "crowded")
        few = materialize(contexts.join(crowded, "gram", "left_anti").select(contexts.columns), "few")
        matches = _sorted_matches(few, length, k).unionByName(_counted_matches(contexts.join(crowded, "gram", "left_semi"), length))
    single = around.where("n = 1").select("gram", "around")
    partly = matches.join(single, ["gram", "around"], "left_semi").groupBy("gram", "around").agg(F.collect_list(F.struct("low", "high")).alias("at"))
    whole = around.where("n > 1").select("gram", "around", F.lit(None).cast(partly.schema["at"].dataType).alias("at"))
    hit = candidates.join(whole.unionByName(partly), ["gram", "around"])
    all_of_it = F.array(F.struct((F.col("place") - F.col("last")).alias("low"), (F.col("place") - F.col("first")).alias("high")))
    flat = hit.select("k1", "k2", "place", F.inline(F.coalesce("at", all_of_it)))
    starts = flat.select("k1", "k2", F.struct((F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("stop")).alias("s"))
    return starts.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def _united(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted (start, stop); runs that touch are one."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [(a, b) for a, b in out]


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs``.

    Null texts are empty; texts under ``length`` bytes lose nothing; long texts
    are searched whole.  Repeated rows are kept and repeat each other's bytes;
    rows with a null id are kept; other columns are not read; an empty table
    gives an empty result.
    """
    key = [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2")]
    src = docs.select(*key, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = materialize(repeated_spans(src.select("k1", "k2", "text"), length, k), "spans")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    ])
    if with_bytes:
        schema.add("kept", T.BinaryType())

    def remove(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc_id, text, found in zip(batch["doc_id"], batch["text"], batch["spans"]):
            data, at, kept = text.encode(), 0, []
            runs = _united(found or [])
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            rest = b"".join([*kept, data[at:]])
            for name, value in (("doc_id", doc_id), ("n_bytes", len(data)), ("n_removed", len(data) - len(rest)), ("n_spans", len(runs)), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("kept", rest)):
                if name in out:
                    out[name].append(value)
        return out

    bits = bitmap(spans.select("k1"))
    touched = filtered(src, bits).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    clean = filtered(src, bits, wanted=False).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return map_batches(touched.unionByName(clean), remove, schema)
