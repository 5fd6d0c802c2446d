"""Contracts on rows and tables: what may pass, what is set aside and why, and what does not add up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_REQUIRED = "null_required_field"
CAST_FAILED = "cast_failed_schema_drift"
BROKEN_FILE = "broken_file"


def split_rows(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; a condition that is null counts as good."""
    bad = F.coalesce(bad, F.lit(False))
    return df.where(~bad), df.where(bad)


def split_required(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all required columns, the rest)."""
    return split_rows(df, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required], F.lit(False)))


def quarantined(df: DataFrame, reason: str, batch_id: str, at: Column | None = None) -> DataFrame:
    """Rejected rows with reason, batch and time."""
    return df.withColumns({"quarantine_reason": F.lit(reason), "quarantined_at": F.current_timestamp() if at is None else at, "batch_id": F.lit(batch_id)})


def quarantine_summary(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Rejected rows by table, reason, batch and day; a typed empty frame if there are no tables."""
    parts = [df.select(F.lit(name).alias("source_table"), "quarantine_reason", "batch_id", F.to_date("quarantined_at").alias("quarantined_on")) for name, df in sorted(tables.items())]
    if not parts:
        return spark.createDataFrame([], "source_table string, quarantine_reason string, batch_id string, quarantined_on date, n_rows long")
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("source_table", "quarantine_reason", "batch_id", "quarantined_on").agg(F.count("*").alias("n_rows"))


def grain_check(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows share their key with another; null keys are keys."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tested"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    return sums.select(F.lit("grain").alias("check"), F.lit(table).alias("table"), F.lit(",".join(keys)).alias("columns"), F.col("tested").cast("long"), F.col("violations").cast("long"))


def reference_check(df: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row: how many distinct values of ``column`` have no parent; null is no reference."""
    values = df.select(F.col(column).alias("k")).where("k is not null").distinct()
    known = parent.select(F.col(parent_column).alias("k"), F.lit(True).alias("known")).distinct()
    both = values.join(known, "k", "left").agg(F.count("*").alias("tested"), F.count_if(F.col("known").isNull()).alias("violations"))
    return both.select(F.lit("reference").alias("check"), F.lit(table).alias("table"), F.lit(column).alias("columns"), "tested", "violations")


def checks_report(tables: Mapping[str, DataFrame], grains: Mapping[str, Sequence[str]], references: Mapping[str, Sequence[tuple[str, str, str]]]) -> DataFrame:
    """A row for each grain check and each reference (column, parent table, parent's column) of all ``tables``.

    The same counts as ``grain_check`` and ``reference_check``, for all tables
    at once: the keys of all tables are grouped together, and their references,
    unfolded to a row each, meet the keys of all parents in one join.
    """
    spark = next(iter(tables.values())).sparkSession
    listed = [("grain", t, ",".join(keys)) for t, keys in grains.items()] + [("reference", t, c) for t, refs in references.items() for c, _, _ in refs]
    asked = spark.createDataFrame(listed, "check string, table string, columns string")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    key = lambda columns: F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    groups = union([tables[t].select(F.lit(t).alias("table"), key(keys).alias("k")) for t, keys in grains.items()]).groupBy("table", "k").agg(F.count("*").alias("n"))
    grain = groups.groupBy("table").agg(F.sum("n").alias("tested"), F.sum(F.col("n") - 1).alias("violations")).withColumn("check", F.lit("grain"))
    found = [grain.join(spark.createDataFrame([(t, ",".join(keys)) for t, keys in grains.items()], "table string, columns string"), "table").select("check", "table", "columns", "tested", "violations")]
    if any(references.values()):
        unfold = lambda refs: F.explode(F.array(*[F.struct(F.lit(c).alias("columns"), F.lit(f"{d}.{k}").alias("parent"), F.col(c).cast("string").alias("k")) for c, d, k in refs]))
        values = union([tables[t].select(F.lit(t).alias("table"), unfold(refs).alias("r")).select("table", "r.*") for t, refs in references.items() if refs]).where("k is not null").distinct()
        parents = sorted({(d, k) for refs in references.values() for _, d, k in refs})
        known = union([tables[d].select(F.lit(f"{d}.{k}").alias("parent"), F.col(k).cast("string").alias("k")) for d, k in parents]).distinct().withColumn("known", F.lit(True))
        counts = values.join(known, ["parent", "k"], "left").groupBy("table", "columns").agg(F.count("*").alias("tested"), F.count_if(F.col("known").isNull()).alias("violations"))
        found.append(counts.select(F.lit("reference").alias("check"), "table", "columns", "tested", "violations"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return asked.join(union(found), ["check", "table", "columns"], "left").select("check", "table", "columns", zero("tested"), zero("violations"))


class CheckFailed(Exception):
    """Some checks have violations; all were run."""


def require_clean(report: DataFrame) -> DataFrame:
    """Raise one error that names every check of ``report`` with violations; the report has a row for each check."""
    bad = report.where("violations > 0").orderBy("check", "table", "columns").collect()
    if bad:
        raise CheckFailed("; ".join(f"{r['check']} of {r['table']}({r['columns']}): {r['violations']} of {r['tested']}" for r in bad))
    return report
