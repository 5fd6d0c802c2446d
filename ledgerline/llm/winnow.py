"""Benchmark decontamination by winnowing.

Texts are words; each run of ``K`` words has a hash, and of every ``W``
consecutive hashes the least one (the last of equals) is a fingerprint.  With
K + W - 1 = 10 words in a window, equal windows choose the same fingerprint, so
a shared span of that many words cannot be missed.  A filter of bounded size
holds the items' fingerprints; where a document has one of them, it is extended
to the windows that chose it, and fingerprint and window together are joined
with those of the items.  So a phrase shorter than a window makes no join rows,
however many documents and items have it.  Items shorter than a window are
looked up whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, fresh_names, map_batches, materialize

#: Words of a hashed run, and runs of a winnowing window: together 10 words.
K, W = 5, 6
SPAN = K + W - 1
#: Bits of the filter for each fingerprint, and at most.
FILTER_BITS, FILTER_MOST = 64, 1 << 26
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k words, from the words' checksums."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h = (h + words[i : i + n]) * _P
        h ^= h >> np.uint64(29)
    return h * _P


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """For every w consecutive hashes the place of their fingerprint: the least one, the last of equals."""
    if len(hashes) < w:
        return np.empty(0, dtype=np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.arange(len(seen)) + (w - 1 - seen[:, ::-1].argmin(axis=1))


def _checksums(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


class Filter:
    """The items' fingerprints in a bit table of bounded size: it may pass others, but none of them is missed."""

    def __init__(self, prints: DataFrame):
        halves = prints.select(F.explode(F.array("fp", F.shiftrightunsigned("fp", 20))).alias("h"))
        self.bits = bitmap(halves, FILTER_MOST, FILTER_BITS)

    def _set(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.int64) % ((len(self.bits) - 1) * 32)
        return (self.bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1

    def keep(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be fingerprints of items."""
        return self._set(hashes) & self._set(hashes >> np.uint64(20))


def _window(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def fingerprints(words: list[bytes], short: list[int], allowed: Filter | None) -> list[tuple[int, int, int, int]]:
    """(fp, window, place, size) of each window of a text with its fingerprint, and of all runs of the lengths in ``short``; ``allowed`` leaves out what no item has."""
    sums, out = _checksums(words), []
    hashes = run_hashes(sums, K)
    places = winnow(hashes)
    chosen = hashes[places]
    for at in np.flatnonzero(allowed.keep(chosen)) if allowed else range(len(places)):
        out.append((int(chosen[at].astype(np.int64)), _window(words[at : at + SPAN]), int(at), SPAN))
    for m in short:
        hashes = run_hashes(sums, m)
        for at in np.flatnonzero(allowed.keep(hashes)) if allowed else range(len(hashes)):
            out.append((int(hashes[at].astype(np.int64)), _window(words[at : at + m]), int(at), m))
    return out


_PRINT = T.StructType([T.StructField("fp", T.LongType()), T.StructField("window", T.LongType()), T.StructField("place", T.LongType()), T.StructField("size", T.LongType())])


def _structs(found: list[tuple[int, int, int, int]]) -> list[dict]:
    return [dict(zip(_PRINT.names, f)) for f in found]


def index_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(fp, window, size, items): the distinct windows of all items with the ids that have them; wordless items have none."""
    schema = T.StructType([T.StructField("item", items.schema[id_col].dataType), T.StructField("prints", T.ArrayType(_PRINT))])

    def run(batch: dict[str, list]) -> dict[str, list]:
        words = [words_of(t) for t in batch["text"]]
        return {"item": batch["item"], "prints": [_structs(fingerprints(w, [len(w)] if 0 < len(w) < SPAN else [], None)) for w in words]}

    rows = map_batches(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), run, schema)
    return rows.select("item", F.inline("prints")).groupBy("fp", "window", "size").agg(F.collect_set("item").alias("items"))


def _covered(spans: Column) -> Column:
    """Words under the union of (start, stop) spans sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["reach"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["reach"], s["stop"]).alias("reach")
    )
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_hit, spans, items) for every row of ``docs``.

    spans are the windows hit, as word ranges (start, stop), items the sorted ids
    of items with a window in the text.  Null and wordless texts have no words;
    long texts are searched whole; rows with null or repeated ids and equal rows
    are kept apart; an item with a null id hits words but is not listed, and ids
    that several items have are listed once; an empty item table hits nothing;
    an empty table gives no rows; other columns are not read.
    """
    index = materialize(index_items(items, item_id, item_text), "items")
    # At most SPAN - 1 rows.
    short = sorted(r["size"] for r in index.where(F.col("size") < SPAN).select("size").distinct().collect())
    allowed = Filter(index.select("fp").distinct())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("prints", T.ArrayType(_PRINT))])

    def run(batch: dict[str, list]) -> dict[str, list]:
        words = [words_of(t) for t in batch["text"]]
        return {"row": batch["row"], "doc_id": batch["doc_id"], "n_words": [len(w) for w in words], "prints": [_structs(fingerprints(w, short, allowed)) for w in words]}

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = materialize(map_batches(src, run, schema), "fingerprints")
    hits = base.select("row", F.inline("prints")).join(index, ["fp", "window", "size"]).select("row", "items", F.struct(F.col("place").alias("start"), (F.col("place") + F.col("size")).alias("stop")).alias("span"))
    by_row = hits.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    none = F.array().cast(by_row.schema["spans"].dataType)
    whole = base.select("row", "doc_id", "n_words").join(by_row, "row", "left").withColumn("spans", F.coalesce("spans", none))
    return whole.select("row", "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", F.coalesce("items", F.array().cast(index.schema["items"].dataType)).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without any benchmark window; columns of any name unchanged.

    A row goes if any row with its id and text is hit; null, empty and long
    texts, repeated rows and empty tables are as in ``find_contamination``.
    """
    (name,) = fresh_names(docs, "key")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    found = find_contamination(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, "key", "text", **options)
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, key.eqNullSafe(F.col(name)), "left_anti")
