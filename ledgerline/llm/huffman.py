"""Token ids as canonical length-limited Huffman code, in independent blocks.

The code comes from the counts of all ids.  Documents are coded one by one,
each from a byte boundary on, with the bit offset of every ``STRIDE``-th id as
a checkpoint.  A block holds whole documents in ascending id order and decodes
on its own: all stretches between checkpoints advance together, one table look
up for each id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_batches, scratch_path, small_batches, stretches
from .tokens import CachedEncoder

#: Longest code word in bits; the decoding table has two to this power entries.
LIMIT = 16
#: Ids between two checkpoints.
STRIDE = 128
#: Ids of a block, about; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Ids of a part, about: the parts of large tables follow the data.
PART_IDS = 1 << 22


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); ids that never occur get 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    packages, kinds = np.empty(0, dtype=np.int64), []
    for _ in range(limit):
        weights = np.concatenate([leaf, packages])
        by = np.argsort(weights, kind="stable")
        kinds.append(by < len(leaf))
        weights = weights[by]
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaf) - 2
    for is_leaf in reversed(kinds):
        leaves = int(is_leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of length, then id."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == length)
        code <<= length - last
        codes[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code, last = code + len(ids), length
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each ``limit`` bits: id << 8 | length of the code word they begin with."""
    table, codes = np.zeros(1 << limit, dtype=np.uint32), canonical_codes(lengths)
    for i in np.flatnonzero(lengths):
        first = int(codes[i]) << (limit - int(lengths[i]))
        table[first : first + (1 << (limit - int(lengths[i])))] = (int(i) << 8) | int(lengths[i])
    return table


def encode(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(code bits, checkpoints) of each document; checkpoints are 4-byte bit offsets of ids STRIDE, 2 * STRIDE, ..."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    ids = np.concatenate(docs).astype(np.int64) if len(docs) else np.empty(0, dtype=np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    bits = ends[first[1:]] - ends[first[:-1]]
    n_bytes = (bits + 7) // 8
    base = np.concatenate([[0], np.cumsum(n_bytes)])
    at = ends[:-1] + np.repeat(base[:-1] * 8 - ends[first[:-1]], sizes)
    shifted = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    words = int(base[-1]) // 4 + 3
    place = at >> 5
    # Code words don't overlap, so sums are unions; they stay under 2^32 and so are exact.
    high = np.bincount(place, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=words)[:words]
    low = np.bincount(place + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)[:words]
    packed = (high + low).astype(np.uint32).astype(">u4").tobytes()
    out = []
    for i in range(len(docs)):
        marks = at[first[i] + STRIDE : first[i + 1] : STRIDE] - base[i] * 8
        out.append((packed[base[i] : base[i + 1]], marks.astype("<u4").tobytes()))
    return out


def decode(payload: bytes, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of all stretches, one after the other: stretch i has counts[i] ids from bit starts[i] on."""
    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    out = np.zeros(int(counts.sum()), dtype=np.uint32)
    order = np.argsort(-counts, kind="stable")
    place = (np.cumsum(counts) - counts)[order]
    at, left = starts[order].astype(np.int64), counts[order]
    live = len(left)
    for step in range(int(left.max(initial=0))):
        live = int(np.searchsorted(-left[:live], -step, side="left"))
        now = at[:live]
        found = table[(window[now >> 3] >> (32 - limit - (now & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)]
        out[place[:live] + step] = found >> 8
        at[:live] = now + (found & 0xFF)
    return out


def token_table(docs: DataFrame, encoder: CachedEncoder, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n, ids) with the ids as little-endian bytes, written once; null texts have only the end id."""
    wide = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = encoder.ids(batch["text"])
        tail = np.array([] if end_id is None else [end_id], dtype=encoder.dtype).tobytes()
        ids = [f.tobytes() + tail for f in found]
        return {"row": batch["row"], "doc_id": batch["doc_id"], "n": [len(b) // encoder.dtype.itemsize for b in ids], "ids": ids}

    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    map_batches(src, run, wide).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(wide).parquet(path)


def count_ids(tokens: DataFrame, vocabulary: int, width: int) -> np.ndarray:
    """Occurrences of each id in the whole table; the driver gets one row for each id of the vocabulary at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=f"<u{width}")
            total += np.bincount(ids, minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int64()), pa.array(total[used], type=pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, path: str, encoder: CachedEncoder, vocabulary: int, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts under ``path``: ``blocks`` in ascending (id, row) order, ``code`` with the code lengths, ``parts`` with the ids before each part.

    Ids of any type that has an order; rows with a null id come first, and equal
    ids keep the order of their rows, over several parts if there are many.
    Null and empty texts have only the end id, long texts a block of their own;
    other columns are not read; an empty table gives empty files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = token_table(docs, encoder, end_id, id_col, text_col)
    width = 2 if vocabulary <= 1 << 16 else 4
    counted = count_ids(tokens, vocabulary, width)
    lengths = code_lengths(counted)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/code")

    id_type = docs.schema[id_col].dataType
    n_parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counted.sum()) // PART_IDS))
    coded = T.StructType([tokens.schema["row"], tokens.schema["doc_id"], tokens.schema["n"], T.StructField("bits", T.BinaryType()), T.StructField("marks", T.BinaryType())])

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = []
        for part in stretches(batch["n"], 1 << 20):
            found += encode([np.frombuffer(b, dtype=f"<u{width}") for b in batch["ids"][part]], lengths, codes)
        return {"row": batch["row"], "doc_id": batch["doc_id"], "n": batch["n"], "bits": [f[0] for f in found], "marks": [f[1] for f in found]}

    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()), T.StructField("checkpoints", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, block, start, size = TaskContext.get().partitionId(), 0, 0, 0

        def flush() -> pa.RecordBatch:
            values = [part, block, start, [h[0] for h in held], [h[1] for h in held], [len(h[2]) for h in held], b"".join(h[2] for h in held), b"".join(h[3] for h in held)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for _, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size + entry[1] > BLOCK_IDS:
                    yield flush()
                    start, block, size, held = start + size, block + 1, 0, []
                held.append(entry)
                size += entry[1]
        if held:
            yield flush()

    # The ranges are parts: their number is the order of their ids.  Ids are coded behind the shuffle, as its borders are sampled from what stands before it.
    dealt = tokens.repartitionByRange(n_parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    map_batches(dealt, run, coded).mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    # One row for each part.
    rows, before = [], 0
    for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(rows, "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document written under ``path``; ids as little-endian 32-bit bytes."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, dtype=np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    table = decoding_table(lengths)
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/parts"), "part").withColumn("start", F.col("start") + F.col("before"))
    schema = T.StructType([T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema.add("ids", T.BinaryType())
    names = ["start", "doc_ids", "counts", "sizes", "payload", "checkpoints"]

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f: [] for f in schema.names}
        for start, doc_ids, counts, sizes, payload, marks in zip(*(batch[k] for k in names)):
            counts, sizes = np.array(counts, dtype=np.int64), np.array(sizes, dtype=np.int64)
            ids = _decode_block(payload, sizes, counts, np.frombuffer(marks, dtype="<u4").astype(np.int64), table)
            at = 0
            for doc_id, n in zip(doc_ids, counts):
                raw = ids[at : at + n].astype("<u4").tobytes()
                for name, value in (("doc_id", doc_id), ("start", start + at), ("n_tokens", int(n)), ("ids_crc32", zlib.crc32(raw))):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(raw)
                at += int(n)
        return out

    return map_batches(blocks.select(*names), run, schema)


def _decode_block(payload: bytes, sizes: np.ndarray, counts: np.ndarray, marks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of a block's documents: the stretches begin at the documents' bytes and at the checkpoints."""
    stretches = np.maximum(1, -(-counts // STRIDE))
    last = np.cumsum(stretches) - 1
    length = np.full(int(stretches.sum()), STRIDE, dtype=np.int64)
    length[last] = counts - (stretches - 1) * STRIDE
    starts = np.repeat((np.cumsum(sizes) - sizes) * 8, stretches)
    inner = np.ones(len(starts), dtype=bool)
    inner[last - stretches + 1] = False
    starts[inner] += marks
    return decode(payload, starts, length, table)
