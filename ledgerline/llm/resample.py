"""Resampling towards a target distribution: hashed n-gram weights, and a draw ranked by a distributed radix sort.

A text's features are its runs of words, hashed into buckets.  A bucket's gain
is the logarithm of how much likelier the target texts make it than all texts;
a text's weight is the mean gain of its features, and Gumbel noise from a hash
of its id makes the highest scores a sample without replacement.

The order comes from an LSD radix sort.  Each pass is a stable counting sort by
one digit of the composite key: rows stand in chunks of the order so far, rows
of each (digit, chunk) are counted, running sums over digits and chunks give
where each of these groups begins, and a row goes there by its place in its
group.  No pass needs more of a task than one group of one chunk, and each pass
is written, so that a lost executor repeats one pass at most.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_batches, materialize, small_batches

#: Bits of a digit, and rows of a chunk at most.
DIGIT_BITS, CHUNK_ROWS = 11, 1 << 18
#: What splits words: all ASCII characters but letters and digits; A-Z become a-z.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def feature_buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """Bucket of each run of 1 to ``longest`` words, repeats included."""
    sums = list(map(zlib.crc32, words))
    for n in range(2, longest + 1):
        sums += [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.fromiter(sums, dtype=np.int64, count=len(sums)) % buckets


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all ``texts`` in each bucket; a task sends one row for each bucket that it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held += np.bincount(feature_buckets(words_of(text), longest, buckets), minlength=buckets)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    # One row for each bucket, whatever the input.
    rows = texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log ratio of its smoothed shares, rounded down."""
    n, of_source, of_target = len(source), float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * of_source / ((float(source[b]) + 1) * of_target))) for b in range(n)], dtype=np.int64)


def noise(seed: int, doc_id: object) -> int:
    """Gumbel noise of an id in thousandths, rounded down; a null id counts as no characters."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``; texts without a word have weight 0."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    names = ("n_words", "n_features", "weight", "score")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in names])

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            words = words_of(text)
            at = feature_buckets(words, longest, buckets)
            weight = int(gain[at].sum()) // len(at) if len(at) else 0
            for name, value in zip(schema.names, (doc_id, len(words), len(at), weight, weight + noise(seed, doc_id))):
                out[name].append(value)
        return out

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def ascending(column: str) -> list[Column]:
    """Keys whose unsigned bits sort as a column of whole numbers does, nulls last; the first key matters most."""
    return [F.col(column).isNull().cast("long"), F.coalesce(F.col(column).cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))]


def descending(column: str) -> list[Column]:
    none, bits = ascending(column)
    return [none, F.bitwise_not(bits)]


def radix_places(rows: DataFrame, keys: Sequence[Column], chunk_rows: int = CHUNK_ROWS, bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` with ``place``, from 0, in the order of the unsigned 64-bit ``keys``, the first of which matters most.

    Digits in which all rows agree need no pass.  Of rows with equal keys any
    may come first; the columns named place, chunk, digit and k0, k1, ... are
    the sort's own.
    """
    spark, mask = rows.sparkSession, (1 << bits) - 1
    names = [f"k{i}" for i in range(len(keys))]
    current = materialize(rows.withColumns(dict(zip(names, keys))).withColumns({"place": F.lit(0).cast("long"), "chunk": F.lit(0).cast("long")}), "unsorted")
    seen = current.agg(F.count("*").alias("n"), *[F.bit_or(k).bitwiseXOR(F.bit_and(k)).alias(k) for k in names]).first()
    passes = [(k, shift) for k in reversed(names) for shift in range(0, 64, bits) if ((seen[k] or 0) & ((1 << 64) - 1)) >> shift & mask]
    size = max(1, min(chunk_rows, -(-seen["n"] // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # The first pass may meet the rows in any order, so its chunks are dealt by hash.
    current = current.withColumn("chunk", F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, -(-seen["n"] // size)))))
    held = current
    for k, shift in passes or [(names[-1], 0)]:
        at = held.withColumn("digit", F.shiftrightunsigned(k, shift).bitwiseAND(F.lit(mask)))
        groups = at.groupBy("digit", "chunk").agg(F.count("*").alias("n"))
        before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # At most 2 ** bits rows meet in the one window without a key.
        digits = groups.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", before(Window.orderBy("digit")).alias("base"))
        starts = groups.withColumn("start", before(Window.partitionBy("digit").orderBy("chunk"))).join(digits, "digit").select("digit", "chunk", (F.col("base") + F.col("start")).alias("start"))
        stable = Window.partitionBy("digit", "chunk").orderBy("place", *rows.columns)
        moved = at.withColumn("nth", F.row_number().over(stable) - 1).join(starts, ["digit", "chunk"]).withColumn("place", F.col("start") + F.col("nth"))
        made = materialize(moved.withColumn("chunk", F.floor(F.col("place") / size)).select(*rows.columns, *names, "place", "chunk"), "sorted")
        if hasattr(held, "scratch"):
            discard(held)
        held = made
    return held.select(*rows.columns, "place")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: rank 1, 2, ... for those drawn, null for others.

    Of the rows whose texts have ``least_words`` words, ``percent`` in a hundred
    (rounded down) are drawn: the highest scores, ties by smaller id, a null id
    last.  Ids are whole numbers.  Null and empty texts have no features and
    weight 0; long texts count whole; repeated rows are drawn each for itself;
    other columns are not read; without target texts all gains are as for
    counts of 0; an empty table gives no rows.
    """
    scored = materialize(importance_scores(docs, target, id_col, text_col, target_text, longest, buckets, seed), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = radix_places(scored.where(able), [*descending("score"), *ascending("doc_id")], chunk_rows)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    out = ("doc_id", "n_features", "weight", "score")
    return placed.select(*out, rank.alias("rank")).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))
