"""Raw JSON feeds under a declared schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.names import fresh, named


@dataclass(frozen=True)
class Feed:
    """A feed: its name, the schema of one record, and the columns no row may lack.

    A file holds one record, or an array whose elements are records; the reader
    gives a row for each record in both cases.
    """

    name: str
    schema: T.StructType | str
    required: tuple[str, ...] = ()
    snapshot: bool = False


def read_feed(spark: SparkSession, feed: Feed, paths: str | list[str], one_per_line: bool = False) -> DataFrame:
    """Records of all files that ``paths`` (globs) match, with ``source_file``.

    Fields outside the schema are dropped, values of another type are null.
    A file of one record cannot be split; ``one_per_line`` is for feeds that have a record on each line.
    """
    reader = spark.read.schema(feed.schema).option("mode", "PERMISSIVE").option("multiLine", str(not one_per_line).lower())
    return reader.json(paths).withColumn("source_file", F.col("_metadata.file_path"))


#: What holds the text of a file that is no JSON, or breaks off.
BROKEN = "broken_text"


def with_broken(feed: Feed) -> T.StructType:
    """The feed's schema with a column for what could not be parsed."""
    schema = feed.schema if isinstance(feed.schema, T.StructType) else T.StructType.fromDDL(feed.schema)
    return T.StructType([*schema, T.StructField(fresh(BROKEN, schema.names), T.StringType())])


def parse_options(feed: Feed, one_per_line: bool = False) -> dict[str, str]:
    return {"mode": "PERMISSIVE", "multiLine": str(not one_per_line).lower(), "columnNameOfCorruptRecord": with_broken(feed).names[-1]}


def marked_broken(feed: Feed, parsed: DataFrame) -> DataFrame:
    """Records parsed under ``with_broken``, with ``source_file``: the text stays only where no declared field came out of it.

    A value of another type than declared is null and breaks nothing.
    """
    *declared, broken = with_broken(feed).names
    nothing = reduce(lambda a, b: a & b, [named(c).isNull() for c in declared])
    return parsed.withColumns({broken: F.when(nothing, named(broken)), "source_file": F.col("_metadata.file_path")})


def read_marked(spark: SparkSession, feed: Feed, paths: str | list[str], one_per_line: bool = False) -> DataFrame:
    """Records of all matching files, those of broken files among them: their last column but one holds the text."""
    return marked_broken(feed, spark.read.schema(with_broken(feed)).options(**parse_options(feed, one_per_line)).json(paths))


def split_broken(feed: Feed, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, broken ones as (source_file, payload)) of rows from ``marked_broken``."""
    broken = with_broken(feed).names[-1]
    is_broken = named(broken).isNotNull()
    return marked.where(~is_broken).drop(broken), marked.where(is_broken).select("source_file", named(broken).alias("payload"))


def file_ledger(spark: SparkSession, paths: str | list[str], records: DataFrame, broken: DataFrame) -> DataFrame:
    """(source_file, n_bytes, n_records, status) of every file that ``paths`` match.

    status is "broken" for a file with text that is no JSON, "empty" for one
    that gave no record, else "read".  Files are listed, not opened; the names
    come from the driver, which lists them for any read, as scans leave empty
    files out.
    """
    found = spark.read.format("binaryFile").load(paths)
    # A list of names and a scan spell a local file in their own ways: file:///a and file:/a.
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("source_file")
    names = spark.createDataFrame([(name,) for name in found.inputFiles()], "name string").select(key("name"))
    sizes = found.select(key("_metadata.file_path"), F.col("length").alias("size"))
    counts = records.groupBy(key("source_file")).agg(F.count("*").alias("n_records"))
    bad = broken.groupBy(key("source_file")).agg(F.count("*").alias("n_broken"))
    n_bytes, n = (F.coalesce(c, F.lit(0)).cast("long") for c in ("size", "n_records"))
    status = F.when(F.col("n_broken") > 0, "broken").when(n == 0, "empty").otherwise("read")
    joined = names.join(sizes, "source_file", "left").join(counts, "source_file", "left").join(bad, "source_file", "left")
    return joined.select("source_file", n_bytes.alias("n_bytes"), n.alias("n_records"), status.alias("status"))


def raw_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, payload): each matching file as it is."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("payload"))


def key_from_path(path: Column | str, suffix: str = r"\.json") -> Column:
    """The number that names a file, as a long; null if its name is not a number."""
    return F.nullif(F.regexp_extract(path, rf"/(\d+){suffix}$", 1), F.lit("")).try_cast("long")
