"""The layered run on files written here: faults, two passes, snapshots, checks, log."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.audit import RunLog, by_batch, failures, snapshot_presence
from ledgerline.operators.quality import CheckFailed, require_clean
from ledgerline.plans.feeds import FEEDS, FLATTENERS
from ledgerline.plans.layers import build_star, build_typed, load_feed, publish_all, quarantine_of, run_all
from ledgerline.plans.star import TABLES, validation_report
from ledgerline.plans.typed import TYPED
from ledgerline.sources import Lake, file_ledger, key_from_path, raw_text, read_feed, read_marked, split_broken
from ledgerline.streaming import stream_feed, stream_upserts


def match(i, home=1, away=2, goals=(2, 1), **more):
    team = lambda k: {"id": k, "name": f"Club {k}", "tla": f"C{k}"}
    season = {"id": 7, "startDate": "2025-08-01", "endDate": "2026-05-30"}
    base = {
        "id": i, "utcDate": f"2025-09-{i % 28 + 1:02d}T15:00:00Z", "status": "FINISHED", "matchday": i, "stage": "REGULAR_SEASON", "group": None, "lastUpdated": "2025-10-01T00:00:00Z",
        "competition": {"id": 2021, "name": "First Division", "code": "PL"}, "season": season, "homeTeam": team(home), "awayTeam": team(away),
        "score": {"winner": None, "fullTime": {"home": goals[0], "away": goals[1]}, "halfTime": {"home": 0, "away": 0}},
    }
    return base | more


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(content))
    return str(path)


def scorers(goals):
    return {"competition": {"code": "PL"}, "season": {"id": 7}, "scorers": [{"player": {"id": 9, "name": "P. Nine", "dateOfBirth": "1999-01-01"}, "team": {"id": 1, "name": "Club 1"}, "playedMatches": 4, "goals": goals, "assists": None, "penalties": 1}]}


def teams():
    return {"competition": {"code": "PL"}, "season": {"id": 7}, "teams": [{"id": 1, "name": "Club One", "shortName": "One", "tla": "ONE", "founded": 1900, "squad": [{"id": 9}]}, {"id": 3, "name": "Club Three", "squad": []}]}


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def test_faults(spark, lake, tmp_path):
    rows = [
        match(1), match(2), match(3) | {"id": None}, match(4, utcDate="soon"), match(5, surprise={"x": 1}), match(6, goals=("two", 1)),
        match(7, season={"id": 7, "startDate": "no date", "endDate": None}), match(8, lastUpdated="2025-10-01T00:00:00Z", matchday=1), match(8, lastUpdated="2025-10-02T00:00:00Z", matchday=2),
    ]
    path = write(tmp_path / "raw/matches_1.json", {"resultSet": {"count": 9}, "matches": rows})
    write(tmp_path / "raw/matches_2.json", {"matches": []})
    for attempt in range(2):
        log = RunLog(spark, f"b{attempt}", "FULL")
        load_feed(lake, FEEDS["matches"], str(tmp_path / "raw/matches_*.json"), log)
        made = build_typed(lake, TYPED["matches"], log)
        bronze = {r["match_id"]: r for r in lake.read("bronze", "matches").collect()}
        assert sorted(bronze) == [1, 2, 4, 5, 6, 7, 8]
        assert bronze[8]["matchday"] == 2 and bronze[5]["competition_code"] == "PL" and "surprise" not in bronze[5].asDict()
        assert (bronze[6]["full_time_home"], bronze[6]["full_time_away"]) == (None, 1)
        silver = {r["match_id"]: r for r in lake.read("silver", "matches").collect()}
        assert sorted(silver) == [1, 2, 5, 6, 8]
        assert silver[1]["result"] == "HOME_WIN" and silver[1]["group_name"] == "NONE" and silver[6]["result"] is None and silver[6]["total_goals"] is None
        assert lake.read("quarantine", "silver_matches").count() == 2
        assert made["inserted"] == (0 if attempt else 5) and made["updated"] == (5 if attempt else 0)
    assert {r["quarantine_reason"] for r in lake.read("quarantine", "bronze_matches").collect()} == {"null_required_field"}
    assert path.endswith("matches_1.json")
    assert {(r["source_table"], r["n_rows"]) for r in quarantine_of(lake).groupBy("source_table").agg(F.sum("n_rows").alias("n_rows")).collect()} == {("bronze_matches", lake.read("quarantine", "bronze_matches").count()), ("silver_matches", 2)}


def test_events_and_lineups(spark, lake, tmp_path):
    event = {"id": "e1", "timestamp": "00:01:02.500", "type": {"name": "Shot"}, "shot": {"statsbomb_xg": 0.3, "outcome": {"name": "Goal"}, "end_location": [1.0, 2.0, 3.0]}, "location": [5.0, 6.0]}
    write(tmp_path / "events/77.json", [event, {"id": "e2", "timestamp": "12", "location": [1.0], "type": {"name": "Pass"}}, {"id": "e3", "timestamp": "00:00:01", "type": {"name": "Pass"}, "pass": {"cross": True}}])
    write(tmp_path / "events/none.json", [{"id": "e4", "timestamp": "00:00:01"}])
    line = {"team_id": 1, "team_name": "Club 1", "lineup": [{"player_id": 9, "player_name": "P. Nine", "cards": None, "positions": []}, {"player_id": 10, "cards": [{"card_type": "Yellow"}]}]}
    write(tmp_path / "lineups/77.json", [line])
    log = RunLog(spark, "b", "FULL")
    metrics = load_feed(lake, FEEDS["events"], str(tmp_path / "events/*.json"), log)
    assert metrics["quarantined"] == 1 and metrics["read"] == 4
    bronze = {r["event_id"]: r for r in lake.read("bronze", "events").collect()}
    assert bronze["e1"]["match_id"] == 77 and bronze["e2"]["location_y"] is None and bronze["e1"]["shot_end_y"] == 2.0
    build_typed(lake, TYPED["events"], log)
    silver = {r["event_id"]: r for r in lake.read("silver", "events").collect()}
    assert sorted(silver) == ["e1", "e3"]
    assert silver["e1"]["event_seconds"] == 62.5 and silver["e1"]["is_goal"] and silver["e3"]["is_completed_pass"] and silver["e3"]["pass_is_cross"] and not silver["e1"]["under_pressure"]
    load_feed(lake, FEEDS["lineups"], str(tmp_path / "lineups/*.json"), log)
    build_typed(lake, TYPED["lineups"], log)
    assert {(r["match_id"], r["player_id"]): r["card_count"] for r in lake.read("silver", "lineups").collect()} == {(77, 9): 0, (77, 10): 1}
    write(tmp_path / "em/1.json", [{"match_id": 5, "match_date": "2024-01-02", "home_score": 1, "competition": {"competition_id": 3}}, {"match_id": 6, "match_date": "never"}])
    load_feed(lake, FEEDS["event_matches"], str(tmp_path / "em/*.json"), log)
    build_typed(lake, TYPED["event_matches"], log)
    assert [(r["match_id"], str(r["match_date"])) for r in lake.read("silver", "event_matches").collect()] == [(5, "2024-01-02")]


def test_standings(spark, tmp_path):
    part = {"stage": "REGULAR_SEASON", "type": "TOTAL", "group": None, "table": [{"position": 1, "team": {"id": 1}, "points": 9}, {"position": 2, "team": {"id": 2}, "points": 4}]}
    write(tmp_path / "s.json", {"competition": {"code": "PL", "id": 1}, "season": {"id": 7}, "standings": [part, part | {"type": "HOME", "table": None}]})
    rows = FLATTENERS["standings"](read_feed(spark, FEEDS["standings"], str(tmp_path / "s.json"))).collect()
    assert [(r["team_id"], r["points"], r["group_name"], r["competition_code"]) for r in rows] == [(1, 9, "NONE", "PL"), (2, 4, "NONE", "PL")]


def test_run_twice_and_snapshots(spark, lake, tmp_path):
    paths = {
        "matches": write(tmp_path / "m.json", {"matches": [match(1), match(2, 2, 3, (0, 0)), match(3, 3, 1, (1, 4)), match(4, 4, 1, (None, None), status="TIMED")]}),
        "scorers": write(tmp_path / "s.json", scorers(3)), "teams": write(tmp_path / "t.json", teams()),
    }
    run_all(lake, paths, snapshot_date="2025-10-01")
    first = {n: lake.read("gold", n).count() for n in TABLES}
    second = run_all(lake, paths, snapshot_date="2025-10-01")
    assert first == {n: lake.read("gold", n).count() for n in TABLES}
    assert all(row[9] == 0 for row in second.rows if row[1] in ("bronze", "silver"))
    log = lake.read("ops", "run_log")
    assert log.select("batch_id").distinct().count() == 2 and failures(log).count() == 0
    teams_ = {r["team_id"]: r for r in lake.read("gold", "dim_team").collect()}
    assert not teams_[1]["is_inferred"] and teams_[2]["is_inferred"] and teams_[2]["team_name"] == "Club 2" and teams_[None]["team_key"] == -1
    assert first["fact_team_match"] == 2 * first["fact_matches"] == 8
    season = lake.read("gold", "agg_team_season").collect()
    assert sum(r["points"] for r in season) == 3 * 2 + 2 * 1
    last = lake.read("gold", "agg_matchday_progress").groupBy("team_key").agg(F.max("cumulative_points").alias("p")).collect()
    assert {r["team_key"]: r["p"] for r in last} == {r["team_key"]: r["points"] for r in season}
    # A new capture adds rows, the same one replaces them.
    run_all(lake, {"scorers": write(tmp_path / "s2.json", scorers(5))}, "INCREMENTAL", "2025-10-02", star=False)
    run_all(lake, {"scorers": write(tmp_path / "s3.json", scorers(6))}, "INCREMENTAL", "2025-10-02", star=False)
    held = {str(r["snapshot_date"]): r["goals"] for r in lake.read("silver", "scorers").collect()}
    assert held == {"2025-10-01": 3, "2025-10-02": 6}
    assert lake.read("silver", "scorers", ("snapshot_date", "2025-10-02")).count() == 1
    with pytest.raises(ValueError):
        load_feed(lake, FEEDS["scorers"], paths["scorers"], RunLog(spark, "b", "FULL"))
    published = lake.publish([("gold", "dim_team"), ("ops", "run_log")], "published_star", "t_")
    assert spark.table(published[0]).count() == first["dim_team"]
    lake.cluster("gold", "fact_matches", ["date_key"], 2)
    assert lake.read("gold", "fact_matches").count() == first["fact_matches"]
    again = RunLog(spark, "b9", "FULL")
    made = build_star(lake, again, validate=False, optimise=True)
    # Another capture has come since.
    assert {n: df.count() for n, df in made.items() if n not in ("dim_date", "fact_top_scorers")} == {n: k for n, k in first.items() if n not in ("dim_date", "fact_top_scorers")} and made["fact_top_scorers"].count() == 2
    assert [r[1] for r in again.rows if r[1] == "gold_layout"] == ["gold_layout"] * 3
    names = publish_all(lake, "published_all")
    assert names[-2:] == ["published_all.quarantine_summary", "published_all.run_log"] and len(names) == len(TABLES) + 2
    seen = snapshot_presence(lake.read("silver", "scorers"), "snapshot_date", ["2025-10-02", "2025-10-09"]).orderBy("snapshot_date").collect()
    assert [(r["n_rows"], r["is_present"]) for r in seen] == [(1, True), (0, False)]
    assert by_batch(log).count() == 2 and quarantine_of(lake).count() == 0


def test_failed_checks_and_log(spark, lake, tmp_path):
    tables = {"dim_team": spark.createDataFrame([(1,), (1,)], "team_key int"), "fact_matches": spark.createDataFrame([(1, 5, 1)], "match_id long, home_team_key int, away_team_key int")}
    with pytest.raises(CheckFailed, match="grain of dim_team.*reference of fact_matches"):
        require_clean(validation_report(tables))
    log = RunLog(spark, "b", "FULL")
    with pytest.raises(RuntimeError), log.step("x", "y"):
        raise RuntimeError("gone wrong")
    row = log.frame().first()
    assert row["status"] == "FAILED" and "gone wrong" in row["error"]
    with pytest.raises(KeyError):
        run_all(lake, {"nothing": "x"}, feeds=["nothing"])
    assert build_star and key_from_path


def test_lake(spark, lake, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    assert not lake.exists("s", "t")
    assert lake.upsert(a, "s", "t", ["k"])["inserted"] == 3
    again = lake.upsert(spark.createDataFrame([(2, "c", 1.0), (None, "m", 2.0)], "k int, v string, w double"), "s", "t", ["k"])
    assert again == {"inserted": 0, "updated": 2, "kept": 1}
    assert {(r["k"], r["v"], r["w"]) for r in lake.read("s", "t").collect()} == {(1, "a", None), (2, "c", 1.0), (None, "m", 2.0)}
    assert lake.delete_where("s", "t", F.col("k") >= 2) == 2
    (tmp_path / "lake/s/broken").mkdir(parents=True)
    (tmp_path / "lake/s/broken/part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        lake.exists("s", "broken")
    write(tmp_path / "raw/5.json", {"x": 1})
    assert json.loads(raw_text(spark, str(tmp_path / "raw/5.json")).first()["payload"]) == {"x": 1}


def test_stream(spark, lake, tmp_path):
    write(tmp_path / "in/1.json", {"matches": [match(1), match(2)]})
    flat = lambda df: FLATTENERS["matches"](df.withColumn("source_file", F.lit("stream")))
    start = lambda: stream_upserts(lake, FEEDS["matches"], str(tmp_path / "in"), flat, "bronze", "matches", ["match_id"], str(tmp_path / "check")).awaitTermination()
    start()
    write(tmp_path / "in/2.json", {"matches": [match(2, matchday=9), match(3)]})
    start()
    assert {r["match_id"]: r["matchday"] for r in lake.read("bronze", "matches").collect()} == {1: 1, 2: 9, 3: 3}


def test_broken_files(spark, lake, tmp_path):
    """A file that breaks off, one that is no JSON and an empty one beside good ones: none vanishes, and the good ones are loaded."""
    write(tmp_path / "raw/good.json", {"matches": [match(1), match(2), match(3) | {"id": None}]})
    write(tmp_path / "raw/odd values.json", {"matches": [match(4, goals=("two", 1))]})
    write(tmp_path / "raw/none.json", {"matches": []})
    whole = json.dumps({"matches": [match(5), match(6)]})
    (tmp_path / "raw/cut.json").write_text(whole[: len(whole) // 2])
    (tmp_path / "raw/page.json").write_text("<html>busy</html>")
    (tmp_path / "raw/empty.json").write_text("")
    feed, paths = FEEDS["matches"], str(tmp_path / "raw/*.json")
    records, broken = split_broken(feed, read_marked(spark, feed, paths))
    name = lambda path: path.rpartition("/")[2].replace("%20", " ")
    ledger = {name(r["source_file"]): (r["n_records"], r["status"]) for r in file_ledger(spark, paths, records, broken).collect()}
    assert ledger == {"good.json": (1, "read"), "odd values.json": (1, "read"), "none.json": (1, "read"), "cut.json": (0, "broken"), "page.json": (0, "broken"), "empty.json": (0, "empty")}
    for attempt in range(2):
        metrics = load_feed(lake, feed, paths, RunLog(spark, f"b{attempt}", "FULL"))
        assert metrics == {"read": 4, "quarantined": 3, "inserted": 0 if attempt else 3, "updated": 3 if attempt else 0}
    held = lake.read("quarantine", "bronze_matches").where("batch_id = 'b1'").collect()
    assert sorted((name(r["source_file"]), r["quarantine_reason"]) for r in held) == [("cut.json", "broken_file"), ("good.json", "null_required_field"), ("page.json", "broken_file")]
    assert {r["payload"] for r in held if r["payload"]} == {whole[: len(whole) // 2], "<html>busy</html>"}
    assert lake.tables("staging") == [] and {r["match_id"]: r["full_time_home"] for r in lake.read("bronze", "matches").collect()} == {1: 2, 2: 2, 4: None}


def test_log_outlives_a_run(spark, lake, tmp_path):
    """What was done before a failure is in the log already."""
    with pytest.raises(ValueError):
        run_all(lake, {"teams": write(tmp_path / "t.json", teams()), "scorers": write(tmp_path / "s.json", scorers(1))}, feeds=["teams", "scorers"])
    assert [(r["target_table"], r["status"]) for r in lake.read("ops", "run_log").collect()] == [("teams", "SUCCESS")]


def test_stream_of_loads(spark, lake, tmp_path):
    """A micro-batch that fails after its merge comes again and is recognised; one that failed before is merged; files come once."""
    write(tmp_path / "in/1.json", {"matches": [match(1), match(2), match(3) | {"id": None}]})
    (tmp_path / "in/cut.json").write_text('{"matches": [{"id": 7')
    done = []

    def fail_once(batch_id):
        done.append(batch_id)
        if len(done) == 1:
            raise RuntimeError("killed after the merge")

    start = lambda after=None: stream_feed(lake, FEEDS["matches"], str(tmp_path / "in"), str(tmp_path / "check"), after=after).awaitTermination()
    with pytest.raises(Exception, match="killed after the merge"):
        start(fail_once)
    versions = lake._listed(lake.path("bronze", "matches"), "v-")
    start(fail_once)
    assert done[0] == done[1] and lake._listed(lake.path("bronze", "matches"), "v-") == versions
    log = lake.read("ops", "run_log")
    assert [(r["batch_id"], r["load_type"], r["rows_read"], r["rows_inserted"], r["rows_quarantined"]) for r in log.collect()] == [(done[0], "STREAM", 3, 2, 2)]
    write(tmp_path / "in/2.json", {"matches": [match(2, matchday=9), match(4)]})
    start()
    rows = {r["match_id"]: (r["matchday"], r["batch_id"], r["source_file"].rpartition("/")[2]) for r in lake.read("bronze", "matches").collect()}
    assert {k: (v[0], v[2]) for k, v in rows.items()} == {1: (1, "1.json"), 2: (9, "2.json"), 4: (4, "2.json")} and rows[1][1] == done[0] and rows[2][1].endswith("_1")
    assert {r["quarantine_reason"] for r in lake.read("quarantine", "bronze_matches").collect()} == {"null_required_field", "broken_file"}
    # Captures are dated by their files.
    write(tmp_path / "caps/s.json", scorers(5))
    stream_feed(lake, FEEDS["scorers"], str(tmp_path / "caps"), str(tmp_path / "check2")).awaitTermination()
    assert lake.read("bronze", "scorers").select("goals", F.col("snapshot_date").isNotNull()).first() == (5, True)
