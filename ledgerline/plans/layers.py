"""The layered run: raw files to flat tables, to typed tables, to the star."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.audit import RunLog, new_batch, stamped
from ..operators.quality import BROKEN_FILE, CAST_FAILED, NULL_REQUIRED, quarantine_summary, quarantined, require_clean, split_required
from ..sources import Feed, Lake, read_marked, split_broken
from .feeds import FEEDS, FLATTENERS
from .star import NATURAL, TABLES, Star, agg_home_away, agg_matchday_progress, agg_team_season, validation_report
from .typed import TYPED, TypedTable

BRONZE, SILVER, GOLD, OPS = "bronze", "silver", "gold", "ops"
FULL = tuple(FEEDS)
INCREMENTAL = ("matches", "standings", "scorers", "teams")
_AGGREGATES = {"agg_team_season": agg_team_season, "agg_home_away": agg_home_away, "agg_matchday_progress": agg_matchday_progress}


def load_rows(lake: Lake, feed: Feed, marked: DataFrame, log: RunLog, snapshot_date: str | None = None) -> dict[str, int]:
    """Rows from ``marked_broken`` into the feed's flat table; broken files and rows without a required value go to quarantine.

    The parsed files are written aside once, and all that follows reads what was
    written: no file is parsed twice and nothing is cached.  Rows are counted by
    the writes themselves.
    """
    if feed.snapshot and snapshot_date is None:
        raise ValueError(f"{feed.name} needs a snapshot date")
    with log.step(BRONZE, feed.name) as step:
        staged, remove = lake.staged(marked, feed.name)
        try:
            records, broken = split_broken(feed, staged)
            flat = FLATTENERS[feed.name](records)
            keys = list(TYPED[feed.name].keys)
            if feed.snapshot:
                flat = flat.withColumn("snapshot_date", F.to_date(F.lit(snapshot_date)))
            good, bad = split_required(stamped(flat, log.batch_id, log.load_type), feed.required)
            files = quarantined(stamped(broken, log.batch_id, log.load_type), BROKEN_FILE, log.batch_id)
            n_broken = lake.quarantine(files, f"bronze_{feed.name}")
            n_bad = lake.quarantine(quarantined(bad, NULL_REQUIRED, log.batch_id), f"bronze_{feed.name}")
            newest = [F.col("source_last_updated").desc_nulls_last()] if "source_last_updated" in flat.columns else []
            counts = Observation()
            good = good.observe(counts, F.count(F.lit(1)).alias("n"))
            made = lake.upsert(good, BRONZE, feed.name, keys, newest, "snapshot_date" if feed.snapshot else None, batch_id=log.batch_id)
        finally:
            remove()
        step.metrics |= {"read": counts.get["n"] + n_bad, "quarantined": n_bad + n_broken} | {k: made[k] for k in ("inserted", "updated")}
    return step.metrics


def load_feed(lake: Lake, feed: Feed, paths: str | list[str], log: RunLog, snapshot_date: str | None = None) -> dict[str, int]:
    """Files of one feed into its flat table, as in ``load_rows``."""
    return load_rows(lake, feed, read_marked(lake.spark, feed, paths), log, snapshot_date)


def is_done(lake: Lake, batch_id: str, layer: str, table: str) -> bool:
    """Whether the run log has this step of this batch as a success."""
    if not lake.exists(OPS, "run_log"):
        return False
    same = (F.col("batch_id") == batch_id) & (F.col("layer") == layer) & (F.col("target_table") == table) & (F.col("status") == "SUCCESS")
    return not lake.read(OPS, "run_log").where(same).isEmpty()


def build_typed(lake: Lake, table: TypedTable, log: RunLog, snapshot_date: str | None = None) -> dict[str, int]:
    """A flat table into its typed one; drifted rows go to quarantine."""
    with log.step(SILVER, table.source) as step:
        flat = lake.read(BRONZE, table.source, ("snapshot_date", snapshot_date) if table.snapshot and snapshot_date else None)
        typed, drifted = table.split(flat.drop("batch_id", "load_type", "load_timestamp"))
        step.metrics["read"] = flat.count()
        # A drifted row stays in its flat table, so every run meets it again: the latest finding replaces the earlier ones.
        step.metrics["quarantined"] = lake.quarantine(quarantined(drifted, CAST_FAILED, log.batch_id), f"silver_{table.source}", ("quarantine_reason",))
        made = lake.upsert(stamped(typed, log.batch_id, log.load_type), SILVER, table.source, list(table.keys), (), "snapshot_date" if table.snapshot else None)
        step.metrics |= {k: made[k] for k in ("inserted", "updated")}
    return step.metrics


#: Columns that readers of the large star tables select by.
LAYOUT = {"fact_matches": ("date_key", "competition_key"), "fact_team_match": ("season_key", "team_key"), "agg_matchday_progress": ("season_key", "competition_key")}
#: Rows of a file of a clustered table, about.
FILE_ROWS = 4_000_000


def optimise_star(lake: Lake, log: RunLog) -> None:
    """Rewrite the large star tables in the order of their usual selections; what fails is logged and ends nothing."""
    for name, by in LAYOUT.items():
        try:
            with log.step("gold_layout", name):
                lake.cluster(GOLD, name, by, max(1, -(-lake.read(GOLD, name).count() // FILE_ROWS)))
        except Exception:  # the table is as good as before
            continue


def quarantine_of(lake: Lake) -> DataFrame:
    """Rejected rows of all quarantine tables of a lake by table, reason, batch and day."""
    return quarantine_summary({name: lake.read("quarantine", name) for name in lake.tables("quarantine")}, lake.spark)


def publish_all(lake: Lake, schema: str, prefix: str = "") -> list[str]:
    """Star tables as catalog tables, dimensions before facts before aggregates; the quarantine summary and the run log come last."""
    last = {"quarantine_summary": quarantine_of(lake)}
    if lake.exists(OPS, "run_log"):
        last["run_log"] = lake.read(OPS, "run_log")
    return lake.publish([(GOLD, t) for t in TABLES if lake.exists(GOLD, t)], schema, prefix, last)


def build_star(lake: Lake, log: RunLog, validate: bool = True, optimise: bool = False) -> dict[str, DataFrame]:
    """All star tables in order: dimensions, facts, then aggregates, which read the written fact; checks and layout can be left out."""
    star = Star(*[lake.read(SILVER, t) for t in ("matches", "teams", "scorers")], recency="load_timestamp")
    for name, (keys, merged) in TABLES.items():
        with log.step(GOLD, name) as step:
            made = _AGGREGATES[name](lake.read(GOLD, "fact_team_match").select(*_FACT)) if name in _AGGREGATES else getattr(star, name)()
            made = stamped(made, log.batch_id, log.load_type, with_source=False)
            if merged:
                counts = lake.upsert(made, GOLD, name, [*keys, *([NATURAL[name]] if name in NATURAL else [])])
                step.metrics |= {k: counts[k] for k in ("inserted", "updated")}
            else:
                step.metrics["inserted"] = lake.replace(made, GOLD, name)
    tables = {name: lake.read(GOLD, name) for name in TABLES}
    if validate:
        with log.step("gold_checks", "all"):
            require_clean(validation_report(tables))
    if optimise:
        optimise_star(lake, log)
        tables = {name: lake.read(GOLD, name) for name in TABLES}
    return tables


_FACT = ("team_key", "competition_key", "season_key", "venue", "stage", "group_name", "matchday", "result", "points", "goals_for", "goals_against")


def run_all(lake: Lake, paths: Mapping[str, str | list[str]], load_type: str = "FULL", snapshot_date: str | None = None, feeds: Sequence[str] | None = None, star: bool = True, validate: bool = True, optimise: bool = False) -> RunLog:
    """Load the feeds that have paths, type them and build the star under one batch id; the first failure ends the run; the log has each step as it ends."""
    log = RunLog(lake.spark, new_batch(), load_type, lambda row: lake.append(row, OPS, "run_log"))
    chosen = [f for f in (feeds or (FULL if load_type == "FULL" else INCREMENTAL)) if f in paths]
    for name in chosen:
        load_feed(lake, FEEDS[name], paths[name], log, snapshot_date)
    for name in chosen:
        build_typed(lake, TYPED[name], log, snapshot_date)
    if star:
        build_star(lake, log, validate, optimise)
    return log
