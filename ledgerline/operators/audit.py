"""The execution log: one row for each step of a run, whatever becomes of it."""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "batch_id string not null, layer string not null, target_table string not null, load_type string not null, status string not null, started_at timestamp not null, "
    "ended_at timestamp not null, seconds double, rows_read long, rows_inserted long, rows_updated long, rows_quarantined long, error string"
)
#: Characters of an error that the log keeps.
ERROR_CHARS = 2_000


def new_batch(prefix: str = "batch") -> str:
    """An id for a run: prefix, UTC time and six random digits."""
    return f"{prefix}_{datetime.now(timezone.utc):%Y%m%dT%H%M%S}_{uuid.uuid4().hex[:6]}"


class RunLog:
    """Rows of a run.  ``sink`` gets the row of each step when it ends, so that what a killed run had done is known."""

    def __init__(self, spark: SparkSession, batch_id: str, load_type: str, sink: Callable[[DataFrame], None] | None = None):
        self.spark, self.batch_id, self.load_type, self.sink = spark, batch_id, load_type, sink
        self.rows: list[tuple] = []

    def step(self, layer: str, table: str) -> Step:
        return Step(self, layer, table)

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, LOG_SCHEMA)

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if self.sink is not None:
            self.sink(self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1))


class Step:
    """Context of one step; a failure is logged and raised again.  ``metrics`` takes the row counts."""

    def __init__(self, log: RunLog, layer: str, table: str):
        self.log, self.layer, self.table = log, layer, table
        self.metrics: dict[str, int] = {}

    def __enter__(self) -> Step:
        self.began = datetime.now(timezone.utc)
        return self

    def __exit__(self, kind, error, trace) -> None:
        ended = datetime.now(timezone.utc)
        text = None if error is None else "".join(traceback.format_exception(kind, error, trace))[-ERROR_CHARS:]
        counts = [self.metrics.get(k) for k in ("read", "inserted", "updated", "quarantined")]
        self.log.add((self.log.batch_id, self.layer, self.table, self.log.load_type, "FAILED" if error else "SUCCESS", self.began, ended, (ended - self.began).total_seconds(), *counts, text))


def roll_up(log: DataFrame, *by: str) -> DataFrame:
    """Log rows by the given columns."""
    return log.groupBy(*by).agg(F.count("*").alias("n_steps"), F.sum("rows_read").alias("rows_read"), F.sum("rows_inserted").alias("rows_inserted"))


def failures(log: DataFrame) -> DataFrame:
    return log.where("status = 'FAILED'")


def by_batch(log: DataFrame) -> DataFrame:
    """Log rows by batch and load type, with the rows each batch met."""
    return roll_up(log, "batch_id", "load_type", "status")


def snapshot_presence(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """(snapshot_date, n_rows, is_present) of each expected capture: whether a load has arrived."""
    asked = df.sparkSession.createDataFrame([(d,) for d in expected], "d string").select(F.to_date("d").alias("snapshot_date"))
    counts = df.groupBy(F.col(column).cast("date").alias("snapshot_date")).agg(F.count("*").alias("n_rows"))
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    return asked.join(counts, "snapshot_date", "left").select("snapshot_date", n.alias("n_rows"), (n > 0).alias("is_present"))


def stamped(df: DataFrame, batch_id: str, load_type: str, with_source: bool = True) -> DataFrame:
    """Lineage columns: load time, batch, load type and source file ("UNKNOWN" where the frame has none)."""
    out = df.withColumns({"load_timestamp": F.current_timestamp(), "batch_id": F.lit(batch_id), "load_type": F.lit(load_type)})
    if not with_source:
        return out.drop("source_file")
    source = F.coalesce(F.col("source_file"), F.lit("UNKNOWN")) if "source_file" in df.columns else F.lit("UNKNOWN")
    return out.withColumn("source_file", source)
