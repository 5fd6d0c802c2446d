"""Near-duplicate groups by SimHash, searched with vantage-point trees.

Texts become 64-bit fingerprints.  Distinct fingerprints are the points of a
Hamming space; they link at ``radius`` or fewer differing bits.  Three trees
are built, each over one band of the bits: two fingerprints that differ in at
most ``radius`` bits differ in at most ``radius // bands`` bits of some band,
so a small search radius does in each tree.  The upper part of a tree is fitted
on a bounded sample on the driver and cuts the points into shards: a point's
home is the leaf its distances to the vantage points lead to, and it also
visits every leaf whose region comes within the band radius of it (triangle
bound).  Inside a shard the same splitting goes on to small nodes, where exact
distances over all 64 bits decide.  A shard emits a spanning forest of its
links, not the pairs, and star contraction joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_least, map_batches, materialize
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of word shingles; a text without words has 0."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        starts = list(accumulate(map(len, tokens), lambda a, b: a + b + 1, initial=0))
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:])])
    return majority(digests)


def majority(digests: bytes) -> int:
    """Signed 64-bit SimHash of 8-byte hashes: a bit is set if it is in over half of them."""
    rows = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(rows), 65536):
        ones += np.unpackbits(rows[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big", signed=True)


def band_masks(bands: int) -> list[int]:
    """Bit masks that cut the 64 bits into ``bands`` runs of nearly equal width."""
    cuts = [round(BITS * i / bands) for i in range(bands + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def _distance(points: np.ndarray, centre: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ centre) & mask)


def build_tree(sample: np.ndarray, mask: int, leaves: int, seed: int) -> list[tuple]:
    """A vantage-point tree over one band, as nodes (vantage, bound, inside, outside), or (leaf number,).

    The vantage point is, of a few tried, that which spreads the sample most;
    the bound is the median distance to it.
    """
    rng, nodes, mask = np.random.default_rng(seed), [], np.uint64(mask)
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    count = 0

    def grow(part: np.ndarray, left: int) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append(())
        if left and len(part) >= 4:
            tried = rng.choice(part, size=min(8, len(part)), replace=False)
            spread = [(float(np.std(_distance(part, v, mask))), int(v)) for v in tried]
            vantage = np.uint64(max(spread)[1])
            far = _distance(part, vantage, mask)
            bound = int(np.median(far))
            inside = far <= bound
            if inside.all():
                bound -= 1
                inside = far <= bound
            if inside.any() and not inside.all():
                a = grow(part[inside], left - 1)
                b = grow(part[~inside], left - 1)
                nodes[at] = (int(vantage), bound, a, b)
                return at
        nodes[at] = (count,)
        count += 1
        return at

    grow(sample, depth)
    return nodes


def route(nodes: list[tuple], mask: int, radius: int, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, index of points, whether it is their home) for each leaf that the points' balls touch."""
    mask = np.uint64(mask)
    stack = [(0, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while stack:
        at, idx, home = stack.pop()
        if not len(idx):
            continue
        node = nodes[at]
        if len(node) == 1:
            yield node[0], idx, home
            continue
        vantage, bound, inside, outside = node
        far = _distance(points[idx], np.uint64(vantage), mask).astype(np.int16)
        near = far - radius <= bound
        away = far + radius > bound
        stack.append((inside, idx[near], home[near] & (far[near] <= bound)))
        stack.append((outside, idx[away], home[away] & (far[away] > bound)))


class _Forest:
    """Least-label union over array indices."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def link_shard(points: np.ndarray, home: np.ndarray, mask: int, band_radius: int, radius: int) -> np.ndarray:
    """Label of each point: points share a label if a chain of links through homes of this shard joins them.

    Every link between a home and any point of the shard is found exactly.
    """
    forest, mask = _Forest(len(points)), np.uint64(mask)
    rng = np.random.default_rng(len(points))
    whole = np.uint64((1 << BITS) - 1)
    every, homes = np.arange(len(points)), np.flatnonzero(home)
    work = [(homes, every, 0)]
    # Dense groups: what lies around a leader is joined through it, and pairs within one group need no comparison.
    for _ in range(8):
        if len(homes) < 512:
            break
        sample = points[rng.choice(homes, size=min(64, len(homes)), replace=False)]
        tested = points[rng.choice(homes, size=min(2048, len(homes)), replace=False)]
        degree = (np.bitwise_count(sample[:, None] ^ tested[None, :]) <= radius).sum(axis=1)
        if degree.max() < 0.02 * len(tested):
            break
        leader = sample[int(degree.argmax())]
        group = np.flatnonzero(_distance(points, leader, whole) <= radius)
        forest.join(np.full(len(group), group[0]), group)
        around = forest.label == forest.label[group[0]]
        done, homes = homes[around[homes]], homes[~around[homes]]
        work[0] = (homes, every, 0)
        work.append((done, np.flatnonzero(~around), 0))
    while work:
        h, q, depth = work.pop()
        if not len(h) or not len(q):
            continue
        if len(h) * len(q) > 1_000_000 and len(h) > 64 and depth < 40:
            vantage = points[rng.choice(h)]
            far_h = _distance(points[h], vantage, mask).astype(np.int16)
            far_q = _distance(points[q], vantage, mask).astype(np.int16)
            bound = int(np.median(far_h))
            if (far_h <= bound).all():
                bound -= 1
            if (far_h <= bound).any():
                work.append((h[far_h <= bound], q[far_q - band_radius <= bound], depth + 1))
                work.append((h[far_h > bound], q[far_q + band_radius > bound], depth + 1))
                continue
        step = max(1, 2_000_000 // len(q))
        for at in range(0, len(h), step):
            part = h[at : at + step]
            label = forest.label
            open_q = q
            if len(np.unique(label[part])) == 1:
                open_q = q[label[q] != label[part[0]]]
                if not len(open_q):
                    continue
            i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[open_q][None, :]) <= radius)
            forest.join(part[i], open_q[j])
    return forest.label


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, digest, fp) of every row, with the hash of its text; null texts have no words."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("digest", T.LongType()), T.StructField("fp", T.LongType())])
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return map_batches(src, lambda b: {"doc_id": b["doc_id"], "digest": b["digest"], "fp": [fingerprint(t, words) for t in b["text"]]}, schema)


def link_fingerprints(points: DataFrame, radius: int = 4, bands: int = 3, shard_rows: int = 20_000, sample_rows: int = 16_384) -> DataFrame:
    """Distinct ``fp`` -> links (a, b) whose components are those of all pairs within ``radius`` bits.

    sample_rows bounds what the driver sees; every point is indexed.  Leaves
    that hold more homes than ``shard_rows`` several times over (dense groups)
    have their homes dealt to several tasks, each with all visitors.
    """
    spark = points.sparkSession
    n = points.count()
    # The hash thins the rows out first, as every task sends its share to the driver.
    some = points.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // (2 * sample_rows)))) == 0)
    rows = some.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()
    sample = np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)
    leaves = min(max(1, -(-n // shard_rows)), max(1, len(sample) // 8))
    masks, band_radius = band_masks(bands), radius // bands
    trees = [build_tree(sample, m, leaves, 17 + i) for i, m in enumerate(masks)]
    width = max(len(t) for t in trees)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(dtype=np.int64)
            for k, (nodes, mask) in enumerate(zip(trees, masks)):
                for leaf, idx, home in route(nodes, mask, band_radius, fps.view(np.uint64)):
                    yield pd.DataFrame({"shard": np.int32(k * width + leaf), "fp": fps[idx], "home": home})

    # A point makes several rows, so the points are dealt out before.
    parts = max(1, min(-(-n // 5_000), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    routed = materialize(points.repartition(parts, "fp").mapInPandas(send, "shard int, fp long, home boolean"), "shards")
    sizes = routed.where("home").groupBy("shard").count().withColumn("cuts", F.ceil(F.col("count") / (4 * shard_rows)).cast("int")).where("cuts > 1")
    # At most one row for each leaf of the trees, whose number the sample bounds.
    cuts = {r["shard"]: r["cuts"] for r in sizes.select("shard", "cuts").collect()}
    if cuts:
        table = F.create_map(*[F.lit(x) for k, v in cuts.items() for x in (k, v)])
        n_cuts = F.coalesce(table[F.col("shard")], F.lit(1))
        cut = routed.withColumn("cut", F.explode(F.sequence(F.lit(0), n_cuts - 1))).withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), n_cuts) == F.col("cut")))
    else:
        cut = routed.withColumn("cut", F.lit(0))

    def link(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(group["fp"].to_numpy(dtype=np.int64))
        home = np.isin(fps, group.loc[group["home"], "fp"].to_numpy(dtype=np.int64))
        label = link_shard(fps.view(np.uint64), home, masks[int(key[0]) // width], band_radius, radius)
        joined = label != np.arange(len(fps))
        return pd.DataFrame({"a": fps[joined], "b": fps[label[joined]]})

    return cut.groupBy("shard", "cut").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4, bands: int = 3, shard_rows: int = 20_000, sample_rows: int = 16_384) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id reachable by links of at most ``radius``
    bits.  Null and wordless texts have fingerprint zero and link like others;
    long texts count whole; rows with a null id are kept and take the smallest
    non-null id of their component, or null if it has none.  Repeated rows are
    kept; other columns are not read; an empty table gives an empty result.
    """
    prints, whole = _components(docs, id_col, text_col, radius, words, bands, shard_rows, sample_rows)
    named = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    label = whole.select("fp", "root").join(named, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(label, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, radius: int = 4, words: int = 4, bands: int = 3, shard_rows: int = 20_000, sample_rows: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, fp) of every row, and (fp, least, root) of every fingerprint with its least id."""
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = link_fingerprints(points.select("fp"), radius, bands, shard_rows, sample_rows)
    roots = connected_components(edges)
    return prints, points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of smallest id from each near-duplicate component; columns unchanged, as in ``keep_least``."""
    prints, whole = _components(docs, id_col, text_col, **options)
    return keep_least(docs, prints.join(whole.select("fp", "root"), "fp").select("doc_id", "digest", "root"), id_col, text_col)
