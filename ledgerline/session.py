"""Session settings that the library relies on, and its folder for tables of its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "ledgerline", **conf: str) -> SparkSession:
    """A session in UTC with ANSI rules and adaptive execution; ``conf`` overrides, with underscores for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; a session on one machine that names none gets a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to delete the shuffle files of a query when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a shared folder and read back: what follows does not compute it again, also after an executor is lost.

    The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path, before = scratch_folder(spark, name), spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def drop_kept(*tables: DataFrame) -> None:
    """Delete ``kept`` tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
