"""Helpers that several operators share: scratch tables, Arrow mapping, text ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch; texts are long, so a batch of Spark's default size could fill a worker.
ARROW_ROWS = 256


#: Bits of the smallest bitmap: whole 32-bit words, and room for a few keys.
_LEAST_BITS = 1024


#: Local folders of sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: spark.checkpoint.dir; where that is unset a new local one, which only a local session can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _LOCAL[app]
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/ledgerline-{uuid.uuid4().hex}/{name}"


#: Spark's setting to delete the shuffle files of a query when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    This cuts the lineage, so a lost executor costs no recomputation of what
    stands before, and expensive text passes run exactly once.  With ``tidy``
    the shuffle files of the write go when it ends, as nothing reads them again;
    otherwise they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_TIDY, "false")
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The ``names``, each changed where ``df`` has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` (column lists in, column lists out) to Arrow batches of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                part = batch.slice(at, ARROW_ROWS)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS * 2))


def keep_least(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of smallest id of each group of ``groups`` (doc_id, digest of the text, root); columns unchanged.

    A row without an id stays only if no row of its group has one.  Of rows with
    the same id in different groups each group keeps its own, of rows that
    repeat id and text one stays.  Columns may have any names; an empty table
    gives no rows.
    """
    groups = materialize(groups, "groups")
    name, digest, text = fresh_names(docs, "name", "digest", "text_digest")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k")
    keep = materialize(groups.groupBy("root").agg(least).select(F.col("k.doc_id").alias(name), F.col("k.digest").alias(digest)), "keep")
    kept = docs.withColumn(text, F.xxhash64(text_col)).join(keep, F.col(id_col).eqNullSafe(F.col(name)) & (F.col(text) == F.col(digest)), "left_semi")
    again = groups.groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("i"), F.col("digest").alias("d"))
    if not again.join(keep, F.col("i").eqNullSafe(F.col(name)) & (F.col("d") == F.col(digest)), "left_semi").isEmpty():
        kept = kept.dropDuplicates([id_col, text])
    return kept.select(docs.columns)


def bitmap(keys: DataFrame, most: int = 1 << 26, bits_each: int = 16) -> np.ndarray:
    """Which buckets of the one long column of ``keys`` have rows: a filter of bounded size that may pass too much, never too little."""
    n, key = max(1, keys.count()), keys.columns[0]
    size = max(_LEAST_BITS, min(most, 1 << (bits_each * n - 1).bit_length()))
    buckets = keys.select(F.pmod(key, F.lit(size)).cast("long").alias("b"))
    # Gathered as 32-bit words of the map, so at most size / 32 rows.
    words = buckets.groupBy((F.col("b") / 32).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(b % 32)))").alias("bits")).toPandas()
    bits = np.zeros(size // 32 + 1, dtype=np.uint32)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return bits


def filtered(rows: DataFrame, bits: np.ndarray, wanted: bool = True) -> DataFrame:
    """Rows whose first column's bucket is set (or not) in a ``bitmap``."""
    size = (len(bits) - 1) * 32
    if size < _LEAST_BITS:
        raise ValueError("not a bitmap")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % size
            yield batch.filter(pa.array(((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1) == wanted))

    small_batches(rows.sparkSession)
    return rows.mapInArrow(keep, rows.schema)


def stretches(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to at most ``most``; a larger item is alone."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if sizes:
        yield slice(start, len(sizes))


def id_crc(doc_id: str) -> Column:
    """crc32 of the id as text: the fold that the queries hold out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
