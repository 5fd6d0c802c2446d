"""The operators on the standard tables: the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checked_cast, clock_seconds, date_key, has_drift, json_leaf, period_key, period_label, share_of, surrogate_key
from ..operators.audit import RunLog, roll_up
from ..operators.changes import capture_gaps, change_feed, latest_capture
from ..operators.dimensions import calendar
from ..operators.linkage import Source, link_records
from ..operators.flatten import first_of, flatten, size_or_zero
from ..operators.quality import CAST_FAILED, NULL_REQUIRED, grain_check, quarantine_summary, quarantined, reference_check, split_required, split_rows
from ..operators.rows import change_since, latest_per_key, ranked, running_totals, top
from ..operators.upsert import merge, merge_counts, without
from ..session import scratch_folder
from ..sources import file_ledger, key_from_path, read_feed, read_marked, split_broken
from ..sources.bucketed import BucketedTable
from ..sources.lake import Lake, clustered
from ..sources.layout import files_touched
from ..sources.payload import replayed, undeclared, with_payload
from .feeds import FEEDS, FLATTENERS
from .star import TABLES, Star, agg_home_away, agg_matchday_progress, agg_team_season, validation_report
from .typed import TYPED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views: the standard tables as the sports-match model -------------------------------------------------

TEAMS = 30
#: Literal reference data of the model's competitions; the last priority is left to the defaults.
COMPETITIONS = {"1-URGENT": ("LEAGUE", "North"), "2-HIGH": ("LEAGUE", "South"), "3-MEDIUM": ("CUP", "East"), "4-NOT SPECIFIED": ("LEAGUE", "West")}


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches: line flags are goals, the order's date the kick-off, priorities competitions."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.count_if(F.col("l_returnflag") == flag).cast("int").alias(name) for flag, name in (("R", "home_goals"), ("A", "away_goals"))])
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    day = F.to_date("o_orderdate")
    year = F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)
    home = F.pmod("o_custkey", F.lit(TEAMS))
    away = F.pmod(home + 1 + F.pmod("o_orderkey", F.lit(TEAMS - 1)), F.lit(TEAMS))
    status = F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "SCHEDULED").otherwise("POSTPONED")
    rows = o.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderpriority").alias("competition_code"), F.substring("o_orderpriority", 1, 1).cast("long").alias("competition_id"),
        F.concat(F.lit("Competition "), F.col("o_orderpriority")).alias("competition_name"), year.cast("long").alias("season_id"), F.make_date(year, F.lit(7), F.lit(1)).alias("season_start_date"),
        F.make_date(year + 1, F.lit(6), F.lit(30)).alias("season_end_date"), day.alias("match_date"), F.col("o_orderdate").alias("kickoff_utc"), F.month(day).alias("matchday"), status.alias("match_status"),
        F.when(F.col("o_orderkey") % 50 == 0, "KNOCKOUT").otherwise("REGULAR_SEASON").alias("stage"), F.lit("NONE").alias("group_name"), home.alias("home_team_id"), away.alias("away_team_id"),
        F.concat(F.lit("Team "), home.cast("string")).alias("home_team_name"), F.concat(F.lit("Team "), away.cast("string")).alias("away_team_name"),
        F.concat(F.lit("T"), home.cast("string")).alias("home_team_tla"), F.concat(F.lit("T"), away.cast("string")).alias("away_team_tla"), "home_goals", "away_goals",
    )
    final, h, a = F.col("match_status") == "FINISHED", F.col("home_goals"), F.col("away_goals")
    won = F.when(final & h.isNotNull() & a.isNotNull(), F.when(h > a, "HOME_WIN").when(h < a, "AWAY_WIN").otherwise("DRAW"))
    return rows.withColumns({"is_finished": final, "result": won})


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as described teams, by region as competition; the model plays with more teams than there are nations."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(
        F.col("n_nationkey").cast("long").alias("team_id"), F.col("r_name").alias("competition_code"), F.col("n_name").alias("team_name"), F.substring("n_name", 1, 8).alias("team_short_name"),
        F.substring("n_name", 1, 3).alias("team_tla"), (F.col("n_nationkey") + 1900).cast("int").alias("founded"), F.lit(None).cast("string").alias("club_colors"),
        F.concat(F.col("n_name"), F.lit(" ground")).alias("venue"), F.col("r_name").alias("area_name"), F.lit(None).cast("string").alias("coach_name"),
    )


def scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players: a snapshot for each year and priority they ordered in."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    joined = o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linenumber"), "o_orderkey")
    sums = joined.groupBy("o_custkey", "o_orderpriority", "y").agg(
        F.count_distinct("o_orderkey").alias("played_matches"), F.count_if(F.col("l_returnflag") == "R").alias("goals"), F.count_if(F.col("l_returnflag") == "A").alias("assists"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("penalties"),
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return sums.join(c, "o_custkey").select(
        F.col("o_orderpriority").alias("competition_code"), F.col("y").cast("long").alias("season_id"), F.make_date("y", F.lit(12), F.lit(31)).alias("snapshot_date"), F.col("o_custkey").alias("player_id"),
        F.col("c_name").alias("player_name"), F.col("c_mktsegment").alias("player_position"), F.pmod("o_custkey", F.lit(TEAMS)).alias("team_id"),
        F.concat(F.lit("Team "), F.pmod("o_custkey", F.lit(TEAMS)).cast("string")).alias("team_name"), "played_matches", "goals", "assists", "penalties",
    )


def star(spark: SparkSession, sf_dir: str, played: DataFrame | None = None, scored: DataFrame | None = None) -> Star:
    """The model's star, from its views or from tables ``played`` and ``scored`` that hold them."""
    return Star(matches(spark, sf_dir) if played is None else played, teams(spark, sf_dir), scorers(spark, sf_dir) if scored is None else scored, key_method="md5", competitions=COMPETITIONS, as_of=F.to_date(F.lit("1998-01-15")))


def _clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a clock text, broken in every eleventh row."""
    text = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.date_format("ts", "HH:mm:ss.SSS"))
    return table(spark, sf_dir, "events").withColumn("clock", text)


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as JSON text."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"), "lines")
    return o.select(F.to_json(body).alias("payload"))


_ORDER = "id bigint, customer struct<key: bigint, status: string>, lines array<struct<l_linenumber: int, l_partkey: bigint, l_quantity: double, l_returnflag: string>>"


def _parsed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_documents(spark, sf_dir).select(F.from_json("payload", _ORDER).alias("d")).select("d.*")


# --- reading and flattening -------------------------------------------------------------------------------


@query
def flatten_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"order_id": "id", "cust_key": "customer.key", "line": "l.l_linenumber", "part_key": "l.l_partkey", "quantity": "l.l_quantity", "flag": "l.l_returnflag"}
    return flatten(_parsed_orders(spark, sf_dir), columns, [("lines", "l")])


@query
def flatten_struct_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(_parsed_orders(spark, sf_dir), {"order_id": "id", "cust_key": "customer.key", "status": "customer.status"})


@query
def flatten_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(F.struct("c_custkey", "c_mktsegment")).alias("members"))
    n = table(spark, sf_dir, "nation").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    regions = n.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "members")).alias("nations"))
    columns = {"region_key": "n_regionkey", "nation": "n.n_name", "cust_key": "m.c_custkey", "segment": first_of("m.c_mktsegment", default="NONE")}
    return flatten(regions, columns, [("nations", "n"), ("n.members", "m")])


@query
def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return flatten(e, {"event_id": "event_id", "event_type": "event_type", "k": "p.k"})


@query
def flatten_members_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return flatten(turns.withColumn("n_turns", size_or_zero("turns")), {"conv_id": "conv_id", "n_turns": "n_turns", "turn": "t.turn", "role": "t.role"}, [("turns", "t")])


@query
def file_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", key_from_path(F.col("url"), r"(?:[?#].*)?").alias("url_key"))


@query
def permissive_bad_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, '{"k":"two"}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", json_leaf(text, "k bigint", "k").alias("k"))


# --- typed tables -----------------------------------------------------------------------------------------


@query
def typed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).withColumn("day_text", F.when(F.col("match_id") % 13 == 0, "soon").otherwise(F.date_format("match_date", "dd.MM.yyyy")))
    day = checked_cast("day_text", "date", "dd.MM.yyyy")
    good, _ = split_rows(m.withColumn("day", day), has_drift([(F.col("day_text"), F.col("day"))]))
    return good.select("match_id", F.col("day").alias("match_day"), F.coalesce(F.nullif("stage", F.lit("KNOCKOUT")), F.lit("NONE")).alias("stage"), "result", F.when(F.col("is_finished"), F.col("home_goals") + F.col("away_goals")).alias("total_goals"))


@query
def typed_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("capture", F.pmod("c_custkey", F.lit(3)).cast("int"))
    sums = c.groupBy("capture", "c_nationkey").agg(F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 0).cast("long").alias("balance"))
    return ranked(sums, ["capture"], [F.col("balance").desc(), F.col("c_nationkey")], "position")


@query
def typed_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("goals_text", F.when(F.col("c_custkey") % 9 != 0, F.pmod("c_custkey", F.lit(40)).cast("string")))
    return c.select(F.col("c_custkey").alias("player_id"), F.coalesce(checked_cast("goals_text", "int"), F.lit(0)).alias("goals"))


@query
def typed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("team_name"), F.col("s_nationkey").cast("long").alias("area_id"))


@query
def event_clock_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clock(spark, sf_dir).select("event_id", F.round(clock_seconds("clock"), 3).alias("seconds"))


@query
def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", (kind == "purchase").alias("is_shot"), ((kind == "purchase") & (F.col("value") > 50)).alias("is_goal"), F.coalesce(F.when(F.col("event_id") % 2 == 0, kind == "view"), F.lit(False)).alias("flag")
    )


# --- contracts, drift, quarantine -------------------------------------------------------------------------


def _contract(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return split_required(joined, ["doc_id", "quality"])


@query
def contract_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contract(spark, sf_dir)[0]


@query
def contract_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contract(spark, sf_dir)[1].select("doc_id", F.lit(NULL_REQUIRED).alias("quarantine_reason"))


def _drift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _clock(spark, sf_dir).withColumn("seconds", F.round(clock_seconds("clock"), 3))
    return split_rows(e, has_drift([(F.col("clock"), F.col("seconds"))]))


@query
def drift_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir)[0].select("event_id", "seconds")


@query
def drift_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir)[1].select("event_id", "clock")


@query
def quarantine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    held = {
        "events": quarantined(_drift(spark, sf_dir)[1].select("event_id"), CAST_FAILED, "b1", at),
        "documents": quarantined(_contract(spark, sf_dir)[1].select("doc_id"), NULL_REQUIRED, "b1", at),
    }
    return quarantine_summary(held, spark)


# --- the feeds' own readers, flatteners and typed tables on files made from the standard tables -----------


#: Stands for a number that is spelled out in the files.
_TWO = -99_999


def _files(spark: SparkSession, rows: DataFrame, key: str, root: str, **head: tuple[str, str]) -> str:
    """Write the structs ``row`` of ``rows`` as JSON documents of about a thousand in the list ``root``; returns their folder."""
    n = max(1, rows.count() // 1_000)
    lists = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("b")).agg(F.collect_list("row").alias(root))
    made = lists.select(F.to_json(F.struct(*[F.from_json(F.lit(text), kind).alias(k) for k, (text, kind) in head.items()], root)).alias("value"))
    made = made.select(F.replace("value", F.lit(f":{_TWO}"), F.lit(':"two"')).alias("value"))
    path = f"{_scratch_lake(spark).root}/raw"
    made.write.option("maxRecordsPerFile", 1).text(path)
    return f"{path}/*.txt"


def _typed_feed(spark: SparkSession, name: str, paths: str, **more: Column) -> DataFrame:
    """The feed's files as its typed rows: read, flattened, split by what is required, cast and split by drift."""
    flat = FLATTENERS[name](read_feed(spark, FEEDS[name], paths)).withColumns(more)
    return TYPED[name].split(split_required(flat, FEEDS[name].required)[0])[0]


@query
def feed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match files with missing ids, broken times and wrongly typed goals."""
    m = matches(spark, sf_dir).withColumn("i", F.col("match_id"))
    i, text = F.col("i"), lambda day: F.date_format(day, "yyyy-MM-dd")
    team = lambda side: F.struct(F.col(f"{side}_team_id").alias("id"), F.col(f"{side}_team_name").alias("name"), F.col(f"{side}_team_tla").alias("tla"))
    goals = F.struct(F.when(i % 19 == 0, _TWO).otherwise(F.col("home_goals")).alias("home"), F.col("away_goals").alias("away"))
    row = F.struct(
        F.when(i % 17 != 0, i).alias("id"), F.when(i % 13 == 0, "soon").otherwise(F.concat(text("match_date"), F.lit("T12:00:00Z"))).alias("utcDate"), F.col("match_status").alias("status"), "matchday", "stage",
        F.lit("2024-01-01T00:00:00Z").alias("lastUpdated"), F.struct(F.col("competition_id").alias("id"), F.col("competition_name").alias("name"), F.col("competition_code").alias("code")).alias("competition"),
        F.struct(F.col("season_id").alias("id"), text("season_start_date").alias("startDate"), text("season_end_date").alias("endDate")).alias("season"),
        team("home").alias("homeTeam"), team("away").alias("awayTeam"), F.struct(goals.alias("fullTime")).alias("score"), F.lit("x").alias("undeclared"),
    )
    found = _typed_feed(spark, "matches", _files(spark, m.select("i", row.alias("row")), "i", "matches"))
    return found.select("match_id", "competition_code", "season_id", "season_start_date", "match_date", "match_status", "is_finished", "matchday", "stage", "group_name", "home_team_id", "away_team_name", "home_goals", "away_goals", "result", "total_goals")


@query
def feed_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer files of one capture: counts that are missing are zero, and a broken birth date rejects its row."""
    c = table(spark, sf_dir, "customer").withColumn("i", F.col("c_custkey"))
    i = F.col("i")
    player = F.struct(i.alias("id"), F.col("c_name").alias("name"), F.when(i % 7 == 0, "unknown").otherwise(F.date_format(F.date_add(F.to_date(F.lit("1990-01-01")), (i % 900).cast("int")), "yyyy-MM-dd")).alias("dateOfBirth"))
    row = F.struct(player.alias("player"), F.struct((i % TEAMS).alias("id"), F.concat(F.lit("Team "), (i % TEAMS).cast("string")).alias("name")).alias("team"), (i % 38).cast("int").alias("playedMatches"), F.when(i % 9 != 0, (i % 40).cast("int")).alias("goals"))
    head = {"competition": ('{"id": 1, "code": "PL", "name": "First"}', "id bigint, code string, name string"), "season": ('{"id": 7}', "id bigint")}
    found = _typed_feed(spark, "scorers", _files(spark, c.select("i", row.alias("row")), "i", "scorers", **head), snapshot_date=F.to_date(F.lit("2025-10-01")))
    return found.select("competition_code", "season_id", "player_id", "player_name", "player_date_of_birth", "team_id", "team_name", "played_matches", "goals", "assists", "penalties", "snapshot_date")


def _document_files(spark: SparkSession, docs: DataFrame) -> str:
    """Write each (number, value) as a file <number>.json; returns what matches them.  There are few, and the driver only names them."""
    lake = _scratch_lake(spark)
    path = lake.path("raw", "written")
    spelled = docs.select("number", F.replace("value", F.lit(f":{_TWO}"), F.lit(':"two"')).alias("value"))
    spelled.repartition("number").write.partitionBy("number").text(path)
    for folder in lake._listed(path, "number="):
        (part,) = lake._listed(f"{path}/{folder}", "part-")
        lake._rename(f"{path}/{folder}/{part}", f"{lake.path('raw', folder.partition('=')[2])}.json")
    return f"{lake.root}/raw/*.json"


def _listed(rows: DataFrame, number: Column, row: Column) -> DataFrame:
    """(number, value): rows of each number as a JSON array."""
    return rows.groupBy(number.alias("number")).agg(F.to_json(F.collect_list(row)).alias("value"))


def _headed(rows: DataFrame, number: Column, code: Column, lists: Column) -> DataFrame:
    """(number, value): one document for each number, with competition and season; ``lists`` makes its other fields, a struct, of the list ``rows``."""
    grouped = rows.groupBy(number.alias("number"), code.alias("code")).agg(F.collect_list("row").alias("rows"))
    head = F.struct(F.struct(F.col("number").cast("long").alias("id"), "code").alias("competition"), F.struct(F.lit(7).alias("id")).alias("season"), lists.alias("rest"))
    whole = F.to_json(head, {"ignoreNullFields": "false"})
    # The struct's fields stand beside the head's.
    return grouped.select("number", F.regexp_replace(F.regexp_replace(whole, '"rest":\\{', ""), "\\}$", "").alias("value"))


@query
def feed_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing files of one capture: a table of all matches and one of home matches, which some lack; teams without an id and points that are spelled out."""
    members = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").cast("int").alias("n"))
    c = table(spark, sf_dir, "nation").join(members, "n_nationkey")
    key, n = F.col("n_nationkey").cast("int"), F.col("n")
    team = F.struct(F.when(key % 8 != 7, key).alias("id"), F.col("n_name").alias("name"), F.substring("n_name", 1, 3).alias("tla"))
    line = F.struct(key.alias("position"), team.alias("team"), n.alias("playedGames"), (n % 7).alias("won"), (n % 3).alias("draw"), F.when(key % 6 == 5, _TWO).otherwise(n * 3).alias("points"), (n % 5 - 2).alias("goalDifference"))
    part = lambda kind, group, rows: F.struct(F.lit("REGULAR_SEASON").alias("stage"), F.lit(kind).alias("type"), F.lit(group).cast("string").alias("group"), rows.alias("table"))
    lists = F.struct(F.array(part("TOTAL", None, F.col("rows")), part("HOME", "A", F.when(F.col("number") % 2 == 1, F.col("rows")))).alias("standings"))
    docs = _headed(c.select("n_regionkey", line.alias("row")), F.col("n_regionkey"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), lists)
    found = _typed_feed(spark, "standings", _document_files(spark, docs), snapshot_date=F.to_date(F.lit("2025-10-01")))
    return found.select("competition_code", "season_id", "stage", "standing_type", "group_name", "position", "team_id", "team_name", "team_tla", "played_games", "won", "draw", "lost", "points", "goal_difference", "snapshot_date")


@query
def feed_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team files with missing ids and squads of several sizes."""
    c = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    squad = F.transform(F.sequence(F.lit(1).cast("long"), key % 4 + 1), lambda i: F.struct(i.alias("id"), F.lit("P").alias("name")))
    row = F.struct(
        F.when(key % 11 != 10, key).alias("id"), F.col("s_name").alias("name"), F.substring("s_name", 1, 4).alias("shortName"), F.when(key % 5 == 4, _TWO).otherwise((1900 + key % 100).cast("int")).alias("founded"),
        F.concat(F.col("s_name"), F.lit(" ground")).alias("venue"), F.struct(F.lit("Area").alias("name")).alias("area"), F.struct(F.when(key % 3 == 0, "C. Oach").alias("name")).alias("coach"), F.when(key % 4 != 3, squad).alias("squad"),
    )
    docs = _headed(c.select("s_nationkey", row.alias("row")), F.col("s_nationkey"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.struct(F.col("rows").alias("teams")))
    found = _typed_feed(spark, "teams", _document_files(spark, docs))
    return found.select("competition_code", "season_id", "team_id", "team_name", "team_short_name", "founded", "venue", "area_name", "coach_name", "squad_size")


@query
def feed_event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are lists of matches, with missing ids, broken dates and scores that are spelled out."""
    m = matches(spark, sf_dir)
    i = F.col("match_id")
    row = F.struct(
        F.when(i % 17 != 0, i).alias("match_id"), F.when(i % 13 == 0, "soon").otherwise(F.date_format("match_date", "yyyy-MM-dd")).alias("match_date"), F.lit("15:00").alias("kick_off"), F.when(i % 19 == 0, _TWO).otherwise(F.col("home_goals")).alias("home_score"),
        F.col("away_goals").alias("away_score"), F.struct(F.col("competition_id"), F.col("competition_name"), F.lit("X").alias("country_name")).alias("competition"), F.struct("season_id").alias("season"),
        F.struct("home_team_id", "home_team_name").alias("home_team"), F.struct("away_team_id", "away_team_name").alias("away_team"), F.struct(F.col("stage").alias("name")).alias("competition_stage"),
    )
    found = _typed_feed(spark, "event_matches", _document_files(spark, _listed(m, F.pmod(F.xxhash64("match_id"), F.lit(40)), row)))
    return found.select("match_id", "match_date", "kick_off", "competition_id", "competition_name", "country_name", "season_id", "home_team_id", "home_team_name", "away_team_id", "away_team_name", "home_goals", "away_goals", "competition_stage", "stadium_name")


@query
def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files named by their match, with broken clocks, short coordinates, and details that only some kinds have."""
    e, i, value = _clock(spark, sf_dir), F.col("event_id"), F.col("value")
    kind = F.when(F.col("event_type") == "purchase", "Shot").when(F.col("event_type") == "click", "Pass").otherwise(F.initcap("event_type"))
    shot = F.when(kind == "Shot", F.struct(value.alias("statsbomb_xg"), F.struct(F.when(value > 50, "Goal").otherwise("Saved").alias("name")).alias("outcome")))
    passed = F.when(kind == "Pass", F.struct(value.alias("length"), F.when(i % 3 == 0, F.struct(F.lit("Incomplete").alias("name"))).alias("outcome"), F.when(i % 2 == 0, True).alias("cross")))
    place = F.when(i % 5 == 0, F.array(value)).when(i % 5 < 4, F.array(value, value + 1))
    row = F.struct(i.cast("string").alias("id"), F.col("clock").alias("timestamp"), F.struct(kind.alias("name")).alias("type"), place.alias("location"), F.when(i % 7 == 0, True).alias("under_pressure"), shot.alias("shot"), passed.alias("pass"))
    found = _typed_feed(spark, "events", _document_files(spark, _listed(e, F.col("user_id") % 50, row)))
    seconds = F.round("event_seconds", 3).alias("event_seconds")
    return found.select("event_id", "match_id", seconds, "event_type", "location_x", "location_y", "under_pressure", "pass_length", "pass_is_cross", "shot_xg", "shot_outcome", "is_shot", "is_goal", "is_completed_pass")


@query
def feed_lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-up files named by their match: players in lists of their teams, some without an id, and their cards."""
    t = table(spark, sf_dir, "conversations")
    player, turn = F.col("conv_id") * 1_000 + F.col("turn"), F.col("turn")
    cards = F.transform(F.sequence(F.lit(1).cast("long"), turn % 3), lambda i: F.struct(F.lit("Yellow").alias("card_type"), i.alias("period")))
    member = F.struct(F.when(player % 9 != 4, player).alias("player_id"), F.concat(F.lit("P"), player.cast("string")).alias("player_name"), (turn % 30).cast("int").alias("jersey_number"), F.when(turn % 3 > 0, cards).alias("cards"))
    number, team = F.col("conv_id") % 40, F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    teams_ = t.groupBy(number.alias("number"), team.alias("team_id")).agg(F.collect_list(member).alias("lineup"))
    row = F.struct("team_id", F.concat(F.lit("T"), F.col("team_id").cast("string")).alias("team_name"), "lineup")
    found = _typed_feed(spark, "lineups", _document_files(spark, _listed(teams_, F.col("number"), row)))
    return found.select("match_id", "team_id", "team_name", "player_id", "player_name", "jersey_number", "card_count")


@query
def feed_file_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by file, of files some of which break off or are empty: (file number, records, rows, status)."""
    m = matches(spark, sf_dir)
    row = F.struct(F.col("match_id").alias("id"), F.col("match_status").alias("status"))
    lists = m.groupBy((F.col("match_id") % 60).alias("number")).agg(F.to_json(F.struct(F.collect_list(row).alias("matches"))).alias("value"))
    number, value = F.col("number"), F.col("value")
    spoilt = F.when(number % 7 == 3, F.substring(value, F.lit(1), F.length(value) - 20)).when(number % 11 == 5, "").otherwise(value)
    paths = _document_files(spark, lists.select("number", spoilt.alias("value")))
    # One pass over the files: what it gives is written, and read from there on.
    marked, _ = _scratch_lake(spark).staged(read_marked(spark, FEEDS["matches"], paths), "matches")
    records, broken = split_broken(FEEDS["matches"], marked)
    rows = FLATTENERS["matches"](records).groupBy(key_from_path(F.col("source_file")).alias("number")).agg(F.count("*").alias("n_rows"))
    files = file_ledger(spark, paths, records, broken).withColumn("number", key_from_path(F.col("source_file")))
    return files.join(rows, "number", "left").select("number", "n_records", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "status")


#: What the first schema of the documents takes; all else is known from the payload alone.
_DECLARED = {"id": "bigint", "status": "string"}


def _documents_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of which the schema takes two fields, merged into a table that keeps the whole; some have fields that others lack, and some are no JSON."""
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    buyer = F.when(i % 3 == 0, F.struct(F.col("o_custkey").alias("key")))
    total = F.when(i % 7 != 0, F.col("o_totalprice"))
    made = F.to_json(F.struct(i.alias("id"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("it's rank"), total.alias("total"), buyer.alias("buyer")))
    text = F.when(i % 29 == 0, F.concat(F.lit("<"), made)).when(i % 7 == 0, F.replace(made, F.lit("}"), F.lit(',"total":"unknown"}'))).otherwise(made)
    text = F.when((i % 3 == 0) & (i % 7 == 0), made).otherwise(text)
    lake = _scratch_lake(spark)
    docs = o.select(i.alias("row"), text.alias("body"))
    lake.upsert(with_payload(docs, "body", _DECLARED), "bronze", "documents", ["row"])
    lake.upsert(with_payload(docs.where("row % 5 = 0"), "body", _DECLARED), "bronze", "documents", ["row"])
    return lake.read("bronze", "documents")


@query
def payload_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of stored documents that the schema does not take, with the type that takes all their values."""
    return undeclared(_documents_kept(spark, sf_dir), list(_DECLARED))


@query
def payload_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later schema filled from the stored documents; is_drift where a value does not fit it."""
    kept = _documents_kept(spark, sf_dir)
    rows, drifted = replayed(kept.withColumn("seen", F.lit(True)), {"it's rank": "int", "total": "double", "buyer": "struct<key: bigint>"})
    return rows.withColumn("is_drift", drifted).select("row", "id", "status", F.col("it's rank").alias("rank"), "total", F.col("buyer.key").alias("buyer_key"), "is_drift")


def _customer_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as four captures saw them, the third of which comes two days late: some come and go, balances and segments change."""
    days = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.to_date(F.lit(d)).alias("captured_on")) for k, d in enumerate(("2024-05-01", "2024-05-02", "2024-05-05", "2024-05-06"))]))
    c = table(spark, sf_dir, "customer").select("*", days.alias("c")).select("*", "c.*")
    i, k = F.col("c_custkey"), F.col("k")
    seen = c.where((i + k) % 9 != 0)
    balance = F.when((i + k) % 5 == 0, F.col("c_acctbal") + k).otherwise(F.col("c_acctbal"))
    return seen.select(i.alias("customer"), "captured_on", balance.alias("balance"), F.when(i % 11 != k, F.col("c_mktsegment")).alias("segment"), k.alias("load"))


@query
def customer_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = change_feed(_customer_captures(spark, sf_dir), ["customer"], "captured_on", ignore=["load"])
    return feed.select("captured", "customer", "change", F.array_join("changed", ",").alias("changed"), "days", F.col("old.balance").alias("old_balance"), F.col("new.balance").alias("new_balance"), F.col("old.segment").alias("old_segment"), F.col("new.segment").alias("new_segment"))


@query
def customer_capture_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_gaps(_customer_captures(spark, sf_dir), "captured_on")


def _spellings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The matches as two providers have them: other ids and spellings, some days later by one, some matches missing on either side."""
    clubs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.lower("n_name").alias("name"))
    m = matches(spark, sf_dir).select("match_id", F.col("match_date").alias("day"), "home_team_id", "away_team_id")
    for side in ("home", "away"):
        team = F.col(f"{side}_team_id")
        city = F.when(team >= 25, " city").otherwise("")
        m = m.join(F.broadcast(clubs), team % 25 == F.col("nation")).withColumn(side, F.concat("name", city)).drop("nation", "name")
    i = F.col("match_id")

    def respelled(name: str, k: int) -> Column:
        way, upper = (i + k) % 4, F.upper(name)
        return F.when(way == 0, F.replace(upper, F.lit("I"), F.lit("Y"))).when(way == 1, F.substring(upper, F.lit(1), F.length(upper) - 1)).when(way == 2, F.concat(F.lit("A.F.C. "), upper)).otherwise(upper)

    left = m.where(i % 10 != 3).select(i.alias("id"), "day", F.concat("home", F.lit(" fc")).alias("home"), F.concat("away", F.lit(" fc")).alias("away"))
    later = F.date_add("day", F.when(i % 11 == 0, 1).otherwise(0))
    return left, m.where(i % 13 != 5).select((i * 7 + 1).alias("id"), later.alias("day"), respelled("home", 0).alias("home"), respelled("away", 1).alias("away"))


@query
def cross_source_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which match of one provider is which of the other; is_true says whether both are the same row."""
    left, right = (Source(rows, "id", "day", ("home", "away")) for rows in _spellings(spark, sf_dir))
    found = link_records(left, right, tolerance=1, least=0.5)
    return found.select("left_id", "right_id", "score", (F.col("left_id") * 7 + 1 == F.col("right_id")).alias("is_true"))


# --- keys, merges, snapshots ------------------------------------------------------------------------------


@query
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate"))
    start = F.when(F.col("o_orderkey") % 17 != 0, F.to_date("o_orderdate"))
    label = period_label(start, F.add_months(start, 9))
    return table(spark, sf_dir, "orders").select("o_orderkey", surrogate_key(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")), "md5").alias("priority_key"), date_key(day).alias("day_key"), label.alias("label"), period_key(label, "md5").alias("label_key"))


@query
def latest_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey").agg(F.max("l_suppkey").alias("l_suppkey"))
    return latest_per_key(lines, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate").desc(), F.col("l_partkey").desc()])


def _customer_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    digit = F.col("c_custkey") % 10
    return c.where(digit < 6), c.where(digit >= 4).withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))


@query
def upsert_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(*_customer_parts(spark, sf_dir), ["c_custkey"])


@query
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_counts(*_customer_parts(spark, sf_dir), ["c_custkey"])


@query
def upsert_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge into a bucketed table, which is not shuffled for it, and once more as a repeated load."""
    base, news = _customer_parts(spark, sf_dir)
    folder = scratch_folder(spark, "buckets")
    customers = BucketedTable(spark, f"customers_{folder.rpartition('-')[2]}", ("c_custkey",), 8, folder)
    for load in (base, news, news):
        customers.upsert(load)
    return customers.read()


@query
def upsert_schema_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return merge(s.where("s_suppkey % 3 <> 0").select("s_suppkey", "s_name"), s.where("s_suppkey % 3 <> 1").select("s_suppkey", "s_name", "s_nationkey"), ["s_suppkey"])


@query
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return without(s, F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") < 0)).select("s_suppkey", "s_name", "s_acctbal")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("snapshot_date")).agg(F.count("*").alias("n_events"))


@query
def snapshot_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later load brings its days again with other counts, and new days."""
    days = _daily(spark, sf_dir)
    return merge(days.where("day(snapshot_date) <= 20"), days.where("day(snapshot_date) >= 15").withColumn("n_events", F.col("n_events") + 100), ["user_id", "snapshot_date"])


@query
def lake_schema_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by day whose loads bring new columns twice, merged into an early day at the end: nothing of the early rows is lost."""
    lake, days, keys = _scratch_lake(spark), _daily(spark, sf_dir), ["user_id", "snapshot_date"]
    last = F.dayofmonth("snapshot_date")
    lake.upsert(days.where(last <= 10), "bronze", "daily", keys, partition="snapshot_date")
    lake.upsert(days.where((last > 10) & (last <= 20)).withColumn("twice", F.col("n_events") * 2), "bronze", "daily", keys, partition="snapshot_date")
    lake.upsert(days.where(last > 20).withColumn("half", F.col("n_events") / 2), "bronze", "daily", keys, partition="snapshot_date")
    lake.upsert(days.where((last == 15) & (F.col("user_id") % 2 == 0)).withColumn("n_events", F.lit(0).cast("long")), "bronze", "daily", keys, partition="snapshot_date")
    return lake.read("bronze", "daily").select("user_id", "snapshot_date", "n_events", "twice", "half")


@query
def lake_null_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by day, some of whose rows have none: a later load of such rows leaves the earlier ones in place."""
    lake, keys = _scratch_lake(spark), ["user_id", "snapshot_date"]
    days = _daily(spark, sf_dir).where("day(snapshot_date) <= 12")
    lost = days.groupBy("user_id").agg(F.sum("n_events").alias("n_events")).withColumn("snapshot_date", F.lit(None).cast("date"))
    lake.upsert(days.unionByName(lost.where("user_id % 3 < 2")), "bronze", "daily", keys, partition="snapshot_date")
    lake.upsert(days.where("day(snapshot_date) = 5 and user_id % 2 = 0").unionByName(lost.where("user_id % 3 > 0")).withColumn("n_events", -F.col("n_events")), "bronze", "daily", keys, partition="snapshot_date")
    return lake.read("bronze", "daily")


@query
def lake_type_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that comes as int, then as long, then as double, by day, and once more as int."""
    lake, days, keys, last = _scratch_lake(spark), _daily(spark, sf_dir), ["user_id", "snapshot_date"], F.dayofmonth("snapshot_date")
    n = F.col("n_events")
    for part, value in ((last <= 8, n.cast("int")), ((last > 8) & (last <= 16), n * (1 << 33)), ((last > 16) & (last <= 24), n / 8), (last > 24, n.cast("int"))):
        lake.upsert(days.where(part).withColumn("n_events", value), "bronze", "daily", keys, partition="snapshot_date")
    lake.upsert(days.where((last == 3) & (F.col("user_id") % 2 == 0)).withColumn("n_events", F.lit(0.5)), "bronze", "daily", keys, partition="snapshot_date")
    return lake.read("bronze", "daily")


@query
def lake_partition_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days and single rows deleted from a table by day, a later load, and a new order of the rows."""
    lake, days, keys = _scratch_lake(spark), _daily(spark, sf_dir), ["user_id", "snapshot_date"]
    last = F.dayofmonth("snapshot_date")
    lake.upsert(days, "bronze", "daily", keys, partition="snapshot_date")
    lake.delete_where("bronze", "daily", last.isin(4, 11) | ((last <= 15) & (F.col("n_events") > 1)))
    lake.upsert(days.where((last == 4) & (F.col("user_id") % 3 == 0)), "bronze", "daily", keys, partition="snapshot_date")
    lake.cluster("bronze", "daily", ["user_id"], 4)
    return lake.read("bronze", "daily")


@query
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the last day that has a user with several events: the day is a subquery, and prunes the folders when it is known."""
    lake = _scratch_lake(spark)
    lake.replace_partitions(_daily(spark, sf_dir), "bronze", "daily", ["snapshot_date"])
    return latest_capture(lake.read("bronze", "daily"), "snapshot_date", F.col("n_events") > 1)


@query
def snapshot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).where(F.col("snapshot_date") == F.to_date(F.lit("2024-01-10")))


@query
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_since(_daily(spark, sf_dir), ["user_id"], ["snapshot_date"], {"delta": "n_events"})


@query
def running_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return running_totals(days, ["o_custkey"], ["day"], {"running": "n"})


@query
def scd1_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, news = _customer_parts(spark, sf_dir)
    keyed = lambda df: df.select(surrogate_key("c_custkey", "md5").alias("customer_key"), "c_custkey", "c_name", "c_acctbal")
    # By the natural key: surrogate keys of 31 bits clash among some 100,000 customers.
    return merge(keyed(base), keyed(news), ["c_custkey"])


@query
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate")), table(spark, sf_dir, "events").select(F.to_date("ts")))


# --- the star ---------------------------------------------------------------------------------------------


@query
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).dim_date()


@query
def dim_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).dim_competition()


@query
def dim_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).dim_season()


@query
def dim_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).dim_team()


@query
def dim_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).dim_player()


@query
def fact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).fact_matches()


@query
def fact_team_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).fact_team_match()


@query
def fact_top_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir).fact_top_scorers()


@query
def agg_team_season_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_team_season(star(spark, sf_dir).fact_team_match())


@query
def agg_home_away_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_home_away(star(spark, sf_dir).fact_team_match())


@query
def agg_matchday_progress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_matchday_progress(star(spark, sf_dir).fact_team_match())


@query
def league_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    # A table is ranked inside its competition and season, so these are chosen before anything is added up.
    competition, season = s.dim_competition().where("competition_code = '1-URGENT'").select("competition_key"), s.dim_season().where("season_label = '1997/98'").select("season_key")
    played = s.fact_team_match().join(competition, "competition_key", "left_semi").join(season, "season_key", "left_semi")
    picked = agg_team_season(played).join(s.dim_team(), "team_key")
    return top(picked.select("season_rank", "team_name", "matches_played", "points", "goal_difference"), [F.col("season_rank"), F.col("team_name")], 10)


@query
def home_vs_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    rows = agg_home_away(s.fact_team_match()).join(s.dim_competition(), "competition_key").where("competition_type = 'LEAGUE'")
    n = F.col("matches_played")
    return rows.groupBy("venue").agg(F.sum(n).alias("matches"), share_of(F.col("wins"), n, 3).alias("win_rate"), share_of(F.col("goals_for"), n, 2).alias("goals_per_match"), share_of(F.col("points"), n, 2).alias("points_per_game"))


@query
def top_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    s.fact_top_scorers().createOrReplaceTempView("_scorers")
    s.dim_player().createOrReplaceTempView("_players")
    s.dim_competition().createOrReplaceTempView("_competitions")
    return spark.sql("""
        SELECT player_id, player_name, competition_code, goals, assists, penalties, goals_per_match
        FROM _scorers JOIN _players USING (player_key) JOIN _competitions USING (competition_key)
        WHERE snapshot_date = (SELECT max(snapshot_date) FROM _scorers)
        ORDER BY goals DESC, assists DESC, player_id, competition_code LIMIT 10""")


# --- checks, log, storage ---------------------------------------------------------------------------------


@query
def grain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return grain_check(t("lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]).unionByName(grain_check(t("orders"), "orders", ["o_orderkey"])).unionByName(grain_check(t("events"), "events", ["user_id", "event_type"]))


@query
def fk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    orders = reference_check(t("orders"), "orders", "o_custkey", t("customer"), "c_custkey")
    return orders.unionByName(reference_check(t("documents"), "documents", "doc_id", t("labels"), "doc_id")).unionByName(reference_check(t("events"), "events", "user_id", t("supplier"), "s_suppkey"))


@query
def star_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grain and reference checks of the star, on tables that are written first.

    Matches and scorers are joins of large tables that eight builders read, so they are worked out once.
    """
    lake = _scratch_lake(spark)
    for name, view in (("matches", matches), ("scorers", scorers)):
        lake.replace(view(spark, sf_dir), "silver", name)
    s = star(spark, sf_dir, lake.read("silver", "matches"), lake.read("silver", "scorers"))
    for name in ("dim_date", "dim_competition", "dim_season", "dim_team", "dim_player", "fact_matches", "fact_top_scorers"):
        lake.replace(getattr(s, name)(), "gold", name)
    lake.replace(s.fact_team_match(lake.read("gold", "fact_matches")), "gold", "fact_team_match")
    for name, build in (("agg_team_season", agg_team_season), ("agg_home_away", agg_home_away), ("agg_matchday_progress", agg_matchday_progress)):
        lake.replace(build(lake.read("gold", "fact_team_match")), "gold", name)
    return validation_report({name: lake.read("gold", name) for name in TABLES})


def _scratch_lake(spark: SparkSession) -> Lake:
    """A lake of its own in the folder that the cluster shares for such things."""
    return Lake(spark, scratch_folder(spark, "lake"))


@query
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of a run that merges two tables twice: the second time nothing is new."""
    lake = _scratch_lake(spark)
    for load in ("FULL", "INCREMENTAL"):
        log = RunLog(spark, f"run_{load}", load)
        for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
            with log.step("bronze", name) as step:
                made = lake.upsert(table(spark, sf_dir, name), "bronze", name, [key])
                step.metrics |= {"read": sum(made.values()) - made["kept"], "inserted": made["inserted"], "updated": made["updated"]}
        lake.append(log.frame(), "ops", "run_log")
    return roll_up(lake.read("ops", "run_log"), "layer", "load_type", "status")


@query
def clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"), ["l_shipdate", "l_orderkey"], 8)


@query
def interleaved_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines over 64 files, narrow in two columns at once: for a range of each column the rows that it has, and whether at most half of the files have to be read for it."""
    lake = _scratch_lake(spark)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_quantity")
    lake.replace(lines, "silver", "lines")
    lake.cluster("silver", "lines", ["l_shipdate", "l_quantity"], 64, interleave=True)
    rows = lake.read("silver", "lines")
    ranges = [("l_shipdate", date(1995, 3, 1), date(1995, 3, 31)), ("l_quantity", 7.0, 8.0)]
    counts = rows.select(*[F.count_if(F.col(c).between(F.lit(low), F.lit(high))).alias(c) for c, low, high in ranges]).unpivot([], [c for c, _, _ in ranges], "column", "n_rows")
    touched = files_touched(rows, ranges)
    return counts.join(touched, "column").select("column", "n_rows", (F.col("n_touched") * 2 <= F.col("n_files")).alias("skips_half"))


@query
def lake_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by day of the month, one part replaced, some deleted, and read back."""
    lake = _scratch_lake(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.dayofmonth("o_orderdate").alias("day"))
    lake.upsert(o, "silver", "orders", ["o_orderkey", "day"], partition="day")
    lake.upsert(o.where("day <= 3").withColumn("o_orderstatus", F.lit("X")), "silver", "orders", ["o_orderkey", "day"], partition="day")
    return lake.read("silver", "orders")


def queries() -> dict[str, Query]:
    return dict(QUERIES)
