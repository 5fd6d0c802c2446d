"""Hard negatives by exact search over Hilbert-ordered blocks with zone maps.

1. Vectors are quantized to whole numbers.  Rows are ordered by label and by
   their place on a Hilbert curve through the dimensions that vary most, and cut
   into blocks of one label, one Parquet row each: the packed vectors beside a
   zone map, the least and greatest value of every dimension.
2. Anchors are packed into chunks of neighbours.  The interval product of an
   anchor with a zone map bounds the scores of all rows of the block.
3. Positives: an anchor's own block gives a score that its best ones reach at
   least; it reads the blocks of its label whose upper bound does, too.
4. Negatives: a positive's score makes a window of scores.  The window reads
   the blocks of other labels whose bounds meet it, less those that stay below
   a block that is known to lie inside it with enough rows.

Anchors are a stated set of queries, searched against all rows: chunks of them
meet packs of zone maps, and then the blocks asked for.  Results of a task are
the best few of each anchor or window, merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block, anchors of a chunk, and zone maps of a pack, about.
BLOCK_ROWS, CHUNK_ANCHORS, PACK_ZONES = 1_024, 256, 256
#: Dimensions of the curve, and bits of each.
CURVE_DIMS, CURVE_BITS = 6, 5
#: Rows of an Arrow batch of blocks, and windows whose best rows a task holds before it sends them.
_BATCH, _HELD = 32, 50_000
_LOW = -(1 << 63)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (whole numbers under 2 ** bits): Skilling's transform, for all rows at once."""
    x, dims = cells.astype(np.int64).T.copy(), cells.shape[1]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | x[i] >> b & 1
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``; dimensions that one side lacks are zero."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = width
    for side in (a, b):
        bound *= float(np.abs(side.astype(np.float64)).max()) if side.size else 0.0
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if bound < 1 << 62 else (a.astype(object) @ b.astype(object).T)


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of each anchor with any vector of each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, least) + products(down, most), products(up, most) + products(down, least)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by smaller id."""
    if len(scores) > 4 * n:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return kept[np.lexsort((ids[kept], -scores[kept]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    values = _longs(data)
    return values.reshape(n, len(values) // n if n else 0)


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH))
    return df.mapInArrow(run, schema)


def _record(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], type=t) for n, t in types.items()], names=list(types))


def quantized(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int, anchors: Column) -> DataFrame:
    """(id, label, v, anchor) of the rows that take part."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))


def _curve(rows: DataFrame) -> list[tuple[int, float, float]]:
    """(dimension, lower end, width of a cell) of the dimensions that vary most, over all rows."""
    stats = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.mean("x").alias("m"), F.stddev_pop("x").alias("s"))
    # One row for each dimension.
    found = stats.orderBy(F.desc("s"), "at").limit(CURVE_DIMS).collect()
    return [(r["at"], r["m"] - 2 * r["s"], max(1e-9, 4 * r["s"] / (1 << CURVE_BITS))) for r in found]


def build_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """(block, label, n, least, most, ids, vectors, anchors): the written blocks of ``quantized`` rows."""
    curve, n = _curve(rows), rows.count()
    cells = [F.least(F.greatest(F.floor((F.coalesce(F.try_element_at("v", F.lit(d + 1)), F.lit(0)) - low) / width), F.lit(0)), F.lit((1 << CURVE_BITS) - 1)).cast("long") for d, low, width in curve]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = hilbert_index(np.array(batch.column(4).to_pylist(), dtype=np.int64).reshape(batch.num_rows, len(curve)), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(at)], names=["id", "label", "v", "anchor", "place"])

    placed = rows.withColumn("cells", F.array(*cells).cast("array<long>"))
    placed = placed.mapInArrow(place, "id long, label long, v array<long>, anchor boolean, place long") if curve else rows.withColumn("place", F.lit(0).cast("long"))
    parts = max(1, min(-(-n // (2 * block_rows)), 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 10_000))
    order = ["label", "place", "id"]
    types = {"block": pa.int64(), "label": pa.int64(), "n": pa.int64(), "least": pa.binary(), "most": pa.binary(), "ids": pa.binary(), "vectors": pa.binary(), "anchors": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            v = _matrix([h[2] for h in held], max(len(h[2]) for h in held))
            row = (first + made, held[0][1], len(held), v.min(0).tobytes(), v.max(0).tobytes(), np.array([h[0] for h in held], dtype=np.int64).tobytes(), v.tobytes(), np.flatnonzero([h[3] for h in held]).astype(np.int64).tobytes())
            made, held = made + 1, []
            return _record({k: [x] for k, x in zip(types, row)}, types)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (len(held) >= block_rows or held[0][1] != row[1]):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(cut, "block long, label long, n long, least binary, most binary, ids binary, vectors binary, anchors binary"), "blocks")


def anchor_chunks(blocks: DataFrame, n_positives: int, chunk_anchors: int) -> DataFrame:
    """(chunk, n, ids, labels, homes, places, reached, vectors): anchors in the order of the blocks, with the score that ``n_positives`` others of the home block reach."""
    longs = ("ids", "labels", "homes", "places", "reached")
    types = {"chunk": pa.int64(), "n": pa.int64()} | {k: pa.binary() for k in (*longs, "vectors")}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            vectors = _matrix([h[-1] for h in held], max(len(h[-1]) for h in held))
            columns = [np.array([h[i] for h in held], dtype=np.int64).tobytes() for i in range(5)]
            row = (first + made, len(held), *columns, vectors.tobytes())
            made, held = made + 1, []
            return _record({k: [x] for k, x in zip(types, row)}, types)

        for batch in batches:
            for block, label, n, ids, vectors, anchors in zip(*(batch.column(c).to_pylist() for c in ("block", "label", "n", "ids", "vectors", "anchors"))):
                v, places, ids = _unpacked(vectors, n), _longs(anchors), _longs(ids)
                if not len(places):
                    continue
                scores = products(v[places], v)
                for row, at in zip(scores, places.tolist()):
                    others = np.sort(np.delete(row, at))
                    reached = int(others[-n_positives]) if len(others) >= n_positives else _LOW
                    held.append((int(ids[at]), label, block, at, reached, v[at]))
                    if len(held) >= chunk_anchors:
                        yield flush()
        if held:
            yield flush()

    return materialize(_mapped(blocks.where(F.octet_length("anchors") > 0), pack, f"chunk long, n long, {', '.join(f'{c} binary' for c in longs)}, vectors binary"), "chunks")


def _asked(chunks: DataFrame, blocks: DataFrame, choose) -> DataFrame:
    """(chunk, block, who): blocks that anchors or windows of a chunk have to read; every chunk meets every pack of zone maps."""
    packs = max(1, -(-blocks.count() // PACK_ZONES))
    zone = F.struct("block", "label", "n", "least", "most")
    zones = blocks.select(F.pmod(F.xxhash64("block"), F.lit(packs)).alias("pack"), zone.alias("z")).groupBy("pack").agg(F.collect_list("z").alias("zones"))
    met = chunks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).withColumn("pack", F.col("pack").cast("long")).join(zones, "pack")
    types = {"chunk": pa.int64(), "block": pa.int64(), "who": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in types}
            for row in batch.to_pylist():
                zs = row["zones"]
                sides = [[_longs(z[k]) for z in zs] for k in ("least", "most")]
                width = max(len(x) for x in sides[0])
                low, high = bounds(_unpacked(row["vectors"], row["n"]), *(_matrix(s, width) for s in sides))
                wanted = choose(row, np.array([z["label"] for z in zs]), np.array([z["n"] for z in zs]), low, high)
                for z, who in zip(zs, wanted.T):
                    if who.any():
                        for k, x in zip(types, (row["chunk"], z["block"], np.flatnonzero(who).astype(np.int64).tobytes())):
                            out[k].append(x)
            yield _record(out, types)

    return materialize(_mapped(met, run, "chunk long, block long, who binary"), "asked")


def _wanted_positives(row: dict, labels: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (_longs(row["labels"])[:, None] == labels[None, :]) & (high >= _longs(row["reached"])[:, None])


def window_of(score: int, percent: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest whole score between these percentages of ``score``; none if the first exceeds the second."""
    return -(-percent[0] * score // 100), percent[1] * score // 100


def _windows(row: dict, percent: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(anchor's number, positive's score, least, greatest score) of the windows that are not empty."""
    found = [(w["at"], w["score"], *window_of(w["score"], percent)) for w in row["windows"]]
    return [w for w in found if w[2] <= w[3]]


def _negative_chooser(percent: tuple[int, int], n_negatives: int):
    def choose(row: dict, labels: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        own, windows = _longs(row["labels"]), _windows(row, percent)
        out = np.zeros((len(windows), len(labels)), dtype=bool)
        for i, (at, _, least, most) in enumerate(windows):
            other, top = labels != own[at], np.minimum(high[at], most)
            inside = other & (low[at] >= least) & (high[at] <= most) & (sizes >= n_negatives)
            known = low[at][inside].max() if inside.any() else least
            out[i] = other & (top >= max(least, known)) & (low[at] <= most)
        return out

    return choose


def _search(asked: DataFrame, blocks: DataFrame, chunks: DataFrame, percent: tuple[int, int] | None, n: int) -> DataFrame:
    """(chunk, at, window, own, score, id, rank): the n best rows of each anchor (``percent`` is None) or window; own is the anchor's id."""
    rows = asked.join(blocks.select("block", F.col("n").alias("rows"), F.col("ids").alias("block_ids"), F.col("vectors").alias("block_vectors")), "block").join(chunks, "chunk")
    types = {k: pa.int64() for k in ("chunk", "at", "window", "own", "score", "id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int, int], tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            out = [np.concatenate([np.full(len(s), key[i], dtype=np.int64) for key, (s, _) in held.items()]) if held else np.zeros(0, dtype=np.int64) for i in range(4)]
            out += [np.concatenate([x[i] for x in held.values()]).astype(np.int64) if held else np.zeros(0, dtype=np.int64) for i in range(2)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in out], names=list(types))

        for batch in batches:
            for row in batch.to_pylist():
                own, ids, v = _longs(row["ids"]), _longs(row["block_ids"]), _unpacked(row["block_vectors"], row["rows"])
                who, reached = _longs(row["who"]), _longs(row["reached"])
                homes, places = _longs(row["homes"]), _longs(row["places"])
                windows = [(at, 0, int(reached[at]), None) for at in range(row["n"])] if percent is None else _windows(row, percent)
                chosen = [windows[w] for w in who.tolist()]
                column = {at: i for i, at in enumerate(sorted({w[0] for w in chosen}))}
                scores = products(_unpacked(row["vectors"], row["n"])[list(column)], v)
                for at, window, least, most in chosen:
                    s, key = scores[column[at]], (row["chunk"], at, window, int(own[at]))
                    old = held.get(key)
                    if old is not None and len(old[0]) >= n:
                        least = max(least, int(old[0][-1]))
                    fits = s >= least if most is None else (s >= least) & (s <= most)
                    if percent is None and homes[at] == row["block"]:
                        fits[places[at]] = False  # the anchor itself
                    fits = np.flatnonzero(fits)
                    if not len(fits):
                        continue
                    s, i = (s[fits], ids[fits]) if old is None else (np.concatenate([old[0], s[fits]]), np.concatenate([old[1], ids[fits]]))
                    top = best(s, i, n)
                    held[key] = s[top], i[top]
                if len(held) >= _HELD:
                    yield flush()
        yield flush()

    found = _mapped(rows, run, ", ".join(f"{k} long" for k in types))
    order = Window.partitionBy("chunk", "at", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, n_positives: int = 5, n_negatives: int = 3, percent: Sequence[int] = (50, 95), block_rows: int = BLOCK_ROWS, chunk_anchors: int = CHUNK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` holds for.

    A component x counts as floor(scale * x), a score is the inner product.  An
    anchor's positives are its ``n_positives`` best other rows of its label; of
    the rows of other labels whose score lies between the two percentages of a
    positive's score, the ``n_negatives`` best are its negatives.  Ties go to
    the smaller id.  The search is exact.

    Rows with a null id, label or vector, or a component that is null or not
    finite, take no part.  Vectors may differ in length: missing components are
    zero.  Repeated rows are rows of their own, also as anchors; anchors
    without positives or negatives give no rows, nor does an empty table; other
    columns are not read but for ``anchors``.  Scores must fit a long.
    """
    percent = (percent[0], percent[1])
    rows = materialize(quantized(vectors, id_col, label_col, vector_col, scale, anchors), "vectors")
    blocks = build_blocks(rows, block_rows)
    chunks = anchor_chunks(blocks, n_positives, chunk_anchors)
    near = _search(_asked(chunks, blocks, _wanted_positives), blocks, chunks, None, n_positives)
    positives = materialize(near.select("chunk", "at", "own", "score", "id"), "positives")
    windows = positives.select("chunk", F.struct("at", "score").alias("w")).distinct().groupBy("chunk").agg(F.array_sort(F.collect_list("w")).alias("windows"))
    asking = materialize(chunks.join(windows, "chunk"), "windows")
    chosen = _asked(asking, blocks, _negative_chooser(percent, n_negatives))
    negatives = _search(chosen, blocks, asking, percent, n_negatives)
    named = positives.select("chunk", "at", F.col("own").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = named.join(negatives.select("chunk", "at", F.col("window").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["chunk", "at", "positive_score"])
    return met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
