"""A landing folder as a stream of merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import RunLog
from ..plans.layers import BRONZE, OPS, is_done, load_rows
from ..sources import Feed, Lake
from ..sources.feeds import marked_broken, parse_options, with_broken


def stream_upserts(lake: Lake, feed: Feed, folder: str, flatten: Callable[[DataFrame], DataFrame], layer: str, name: str, keys: Sequence[str], checkpoint: str, max_files: int = 1_000) -> StreamingQuery:
    """Merge every new file of ``folder`` into a table, then stop; the checkpoint remembers what was merged.

    A merge that is repeated after a failure gives the same table.
    """
    stream = lake.spark.readStream.schema(feed.schema).option("multiLine", "true").option("maxFilesPerTrigger", max_files).json(folder)

    def one(batch: DataFrame, _: int) -> None:
        lake.upsert(flatten(batch), layer, name, keys)

    return stream_of(stream, one, checkpoint)


def stream_feed(lake: Lake, feed: Feed, folder: str, checkpoint: str, max_files: int = 1_000, after: Callable[[str], None] | None = None) -> StreamingQuery:
    """Load every new file of ``folder`` as ``load_feed`` does, then stop: quarantine, lineage, merge and log for each micro-batch.

    The load's batch id is that of the query and the micro-batch, and the log
    has it before Spark commits the micro-batch.  One that comes again after a
    failure is therefore known: done ones are passed over, others are merged
    again, which gives the same table.  A snapshot's date is the day that its
    file was last changed.  ``after`` is called with the batch id when a
    micro-batch is done.
    """
    stream = lake.spark.readStream.schema(with_broken(feed)).options(**parse_options(feed)).option("maxFilesPerTrigger", max_files).json(folder)
    marked = marked_broken(feed, stream)
    if feed.snapshot:
        marked = marked.withColumn("captured_on", F.to_date("_metadata.file_modification_time"))

    def one(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch_id = f"stream_{query}_{number}"
        log = RunLog(lake.spark, batch_id, "STREAM", lambda row: lake.append(row, OPS, "run_log"))
        if not feed.snapshot:
            if not is_done(lake, batch_id, BRONZE, feed.name):
                load_rows(lake, feed, batch, log)
        else:
            # A micro-batch has few days, each a load of its own.
            for day in sorted(str(r[0]) for r in batch.select("captured_on").distinct().collect()):
                log.batch_id = f"{batch_id}_{day}"
                if not is_done(lake, log.batch_id, BRONZE, feed.name):
                    load_rows(lake, feed, batch.where(F.col("captured_on") == F.lit(day).cast("date")).drop("captured_on"), log, day)
        if after is not None:
            after(batch_id)

    return stream_of(marked, one, checkpoint)


def stream_of(stream: DataFrame, one: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
