"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_SK = "(('0x' || substr(md5(({0})::VARCHAR), 1, 15))::BIGINT % 2147483647)::INT"


def _sk(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN -1 ELSE {_SK.format(x)} END)"


_MATCHES = """
lines AS (SELECT l_orderkey, (count(*) FILTER (WHERE l_returnflag = 'R'))::INT AS home_goals, (count(*) FILTER (WHERE l_returnflag = 'A'))::INT AS away_goals FROM lineitem GROUP BY 1),
m0 AS (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS y, o_custkey % 30 AS home_team_id, (o_custkey % 30 + 1 + o_orderkey % 29) % 30 AS away_team_id
       FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey),
matchup AS (SELECT o_orderkey AS match_id, o_orderpriority AS competition_code, substr(o_orderpriority, 1, 1)::BIGINT AS competition_id, 'Competition ' || o_orderpriority AS competition_name, y::BIGINT AS season_id,
       make_date(y, 7, 1) AS season_start_date, make_date(y + 1, 6, 30) AS season_end_date, o_orderdate::DATE AS match_date, o_orderdate AS kickoff_utc, month(o_orderdate)::INT AS matchday,
       CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'SCHEDULED' ELSE 'POSTPONED' END AS match_status, CASE WHEN o_orderkey % 50 = 0 THEN 'KNOCKOUT' ELSE 'REGULAR_SEASON' END AS stage,
       home_team_id, away_team_id, home_goals, away_goals, o_orderstatus = 'F' AS is_finished, y || '/' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS label FROM m0),
scorers AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, count(DISTINCT o_orderkey) AS played_matches, count(*) FILTER (WHERE l_returnflag = 'R') AS goals,
       count(*) FILTER (WHERE l_returnflag = 'A') AS assists, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 1) AS penalties
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"""

_FACT = f"""
fm AS (SELECT match_id, (year(match_date) * 10000 + month(match_date) * 100 + day(match_date))::INT AS date_key, {_sk('competition_code')} AS competition_key, {_sk('label')} AS season_key,
       {_sk('home_team_id')} AS home_team_key, {_sk('away_team_id')} AS away_team_key, matchday, stage, 'NONE' AS group_name, match_status, is_finished, kickoff_utc, home_goals, away_goals,
       is_finished AND home_goals IS NOT NULL AND away_goals IS NOT NULL AS ok FROM matchup),
sides AS (SELECT match_id, date_key, competition_key, season_key, matchday, stage, group_name, match_status, is_finished, kickoff_utc, ok, 'HOME' AS venue, home_team_key AS team_key, away_team_key AS opponent_key, home_goals AS goals_for, away_goals AS goals_against FROM fm
       UNION ALL SELECT match_id, date_key, competition_key, season_key, matchday, stage, group_name, match_status, is_finished, kickoff_utc, ok, 'AWAY', away_team_key, home_team_key, away_goals, home_goals FROM fm),
ftm AS (SELECT * EXCLUDE (ok), CASE WHEN ok THEN goals_for - goals_against END AS goal_difference, CASE WHEN ok THEN CASE WHEN goals_for > goals_against THEN 'WIN' WHEN goals_for < goals_against THEN 'LOSS' ELSE 'DRAW' END END AS result,
       CASE WHEN ok THEN CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END END AS points, CASE WHEN ok THEN goals_against = 0 END AS is_clean_sheet FROM sides)"""

_RECORD = """count(*) AS matches_played, count(*) FILTER (WHERE result = 'WIN') AS wins, count(*) FILTER (WHERE result = 'DRAW') AS draws, count(*) FILTER (WHERE result = 'LOSS') AS losses,
       sum(goals_for)::BIGINT AS goals_for, sum(goals_against)::BIGINT AS goals_against, sum(points)::BIGINT AS points"""
_SEASON = f"""
rec AS (SELECT team_key, competition_key, season_key, {_RECORD} FROM ftm WHERE result IS NOT NULL GROUP BY 1, 2, 3),
season AS (SELECT *, goals_for - goals_against AS goal_difference, round(points / matches_played, 2) AS points_per_game, round(wins / matches_played, 3) AS win_rate,
       rank() OVER (PARTITION BY competition_key, season_key ORDER BY points DESC, goals_for - goals_against DESC, goals_for DESC)::INT AS season_rank FROM rec)"""
_VENUE = f"""
vrec AS (SELECT team_key, competition_key, season_key, venue, {_RECORD} FROM ftm WHERE result IS NOT NULL GROUP BY 1, 2, 3, 4),
venues AS (SELECT *, round(goals_for / matches_played, 2) AS avg_goals_for, round(goals_against / matches_played, 2) AS avg_goals_against, round(points / matches_played, 2) AS points_per_game,
       round(wins / matches_played, 3) AS win_rate, round(draws / matches_played, 3) AS draw_rate, round(losses / matches_played, 3) AS loss_rate FROM vrec)"""
_COMPETITION = f"""
ref(competition_code, competition_type, country) AS (VALUES ('1-URGENT', 'LEAGUE', 'North'), ('2-HIGH', 'LEAGUE', 'South'), ('3-MEDIUM', 'CUP', 'East'), ('4-NOT SPECIFIED', 'LEAGUE', 'West')),
dc AS (SELECT {_sk('competition_code')} AS competition_key, competition_code, competition_id, competition_name, coalesce(competition_type, 'UNKNOWN') AS competition_type, coalesce(country, 'UNKNOWN') AS country
       FROM (SELECT DISTINCT competition_code, competition_id, competition_name FROM matchup) LEFT JOIN ref USING (competition_code)
       UNION ALL SELECT -1, 'UNKNOWN', NULL, 'Unknown', 'UNKNOWN', 'UNKNOWN')"""
_DIM_SEASON = f"""
ds AS (SELECT {_sk('label')} AS season_key, label AS season_label, min(year(season_start_date))::INT AS season_start_year, bool_or(DATE '1998-01-15' BETWEEN season_start_date AND season_end_date) AS is_current FROM matchup GROUP BY label
       UNION ALL SELECT -1, 'Unknown', NULL, false)"""
_DIM_TEAM = f"""
known AS (SELECT n_nationkey::BIGINT AS team_id, n_name AS team_name, substr(n_name, 1, 8) AS team_short_name, substr(n_name, 1, 3) AS team_tla, (n_nationkey + 1900)::INT AS founded, NULL::VARCHAR AS club_colors,
       n_name || ' ground' AS home_venue, r_name AS country, NULL::VARCHAR AS coach_name, false AS is_inferred FROM nation JOIN region ON n_regionkey = r_regionkey),
seen AS (SELECT home_team_id AS team_id, 'T' || home_team_id AS tla FROM matchup UNION SELECT away_team_id, 'T' || away_team_id FROM matchup UNION SELECT o_custkey % 30, NULL FROM scorers),
dt AS (SELECT {_sk('team_id')} AS team_key, * FROM (SELECT * FROM known UNION ALL
       SELECT team_id, 'Team ' || team_id, 'Team ' || team_id, max(tla), NULL, NULL, NULL, NULL, NULL, true FROM seen WHERE team_id NOT IN (SELECT team_id FROM known) GROUP BY team_id)
       UNION ALL SELECT -1, NULL, 'Unknown', 'Unknown', 'UNK', NULL, NULL, NULL, NULL, NULL, false)"""
_PLAYER = f"""
dp AS (SELECT {_sk('c_custkey')} AS player_key, c_custkey AS player_id, c_name AS player_name, c_mktsegment AS player_position FROM customer WHERE c_custkey IN (SELECT o_custkey FROM scorers)
       UNION ALL SELECT -1, NULL, 'Unknown', NULL)"""
_TOP = f"""
labels2 AS (SELECT competition_code, season_id, min(label) AS label FROM matchup GROUP BY 1, 2),
fts AS (SELECT {_sk('o_orderpriority')} AS competition_key, {_sk('label')} AS season_key, (y * 10000 + 1231)::INT AS snapshot_date_key, make_date(y, 12, 31) AS snapshot_date, {_sk('o_custkey')} AS player_key,
       {_sk('(o_custkey % 30)')} AS team_key, played_matches, goals, assists, penalties, goals - penalties AS non_penalty_goals, round(goals / played_matches, 2) AS goals_per_match
       FROM scorers LEFT JOIN labels2 ON o_orderpriority = competition_code AND y = season_id)"""


def _spine(bounds: str) -> str:
    return f"""
days AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM ({bounds})),
dd AS (SELECT (year(d) * 10000 + month(d) * 100 + day(d))::INT AS date_key, d AS full_date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month, monthname(d) AS month_name, day(d)::INT AS day_of_month,
       (dayofweek(d) + 1)::INT AS day_of_week, dayname(d) AS day_name, weekofyear(d)::INT AS iso_week, dayofweek(d) IN (0, 6) AS is_weekend FROM days
       UNION ALL SELECT -1, NULL, NULL, NULL, NULL, 'Unknown', NULL, NULL, 'Unknown', NULL, false)"""


_DATE = _spine("SELECT least(min(match_date), (SELECT min(make_date(y, 12, 31)) FROM scorers)) AS lo, greatest(max(match_date), (SELECT max(make_date(y, 12, 31)) FROM scorers)) AS hi FROM matchup")
_CLOCK = "clocks AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE strftime(ts, '%H:%M:%S.%g') END AS clock, CASE WHEN event_id % 11 <> 0 THEN round(hour(ts) * 3600 + minute(ts) * 60 + millisecond(ts) / 1000, 3) END AS seconds FROM events)"
def _linkage(rounds: int) -> str:
    """Rounds of mutual best between two spellings of the matches, written out; as many as the standard tables need and some more."""
    base = "lower({0}.n_name) || CASE WHEN {1}_team_id >= 25 THEN ' city' ELSE '' END"
    spelled = "CASE (match_id + {1}) % 4 WHEN 0 THEN replace(upper({0}), 'I', 'Y') WHEN 1 THEN upper({0})[:-2] WHEN 2 THEN 'A.F.C. ' || upper({0}) ELSE upper({0}) END"
    norm = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    gram = "list_transform(range(1, greatest(len({0}), 1) + 1), lambda i: '{1}:' || substr('#' || {0} || '#', i, 3))"
    order = "score DESC, l, r"
    steps = [
        f"named AS (SELECT match_id, match_date AS day, {base.format('h', 'home')} AS home, {base.format('a', 'away')} AS away FROM matchup JOIN nation h ON h.n_nationkey = home_team_id % 25 JOIN nation a ON a.n_nationkey = away_team_id % 25)",
        "one AS (SELECT match_id AS id, day, home || ' fc' AS home, away || ' fc' AS away FROM named WHERE match_id % 10 <> 3)",
        f"two AS (SELECT match_id * 7 + 1 AS id, (day + CASE WHEN match_id % 11 = 0 THEN 1 ELSE 0 END)::DATE AS day, {spelled.format('home', 0)} AS home, {spelled.format('away', 1)} AS away FROM named WHERE match_id % 13 <> 5)",
    ]
    for source, side in (("one", "l"), ("two", "r")):
        steps.append(f"{side}n AS (SELECT id, day, {norm.format('home')} AS home, {norm.format('away')} AS away FROM {source})")
        steps.append(f"{side}c AS MATERIALIZED (SELECT min(id) AS {side}, day, list_distinct({gram.format('home', 0)} || {gram.format('away', 1)}) AS g, list(id ORDER BY id) AS {side}_ids FROM {side}n GROUP BY day, home, away)")
    steps.append("near AS (SELECT l, r, l_ids, r_ids, 2::DOUBLE * len(list_intersect(lc.g, rc.g)) / (len(lc.g) + len(rc.g)) AS score FROM lc, (SELECT *, unnest([-1, 0, 1]) AS shift FROM rc) rc WHERE lc.day = rc.day + shift)")
    steps.append("p0 AS MATERIALIZED (SELECT *, len(l_ids) AS l_n, len(r_ids) AS r_n, 0 AS l_from, 0 AS r_from FROM near WHERE score >= 0.5)")
    for k in range(1, rounds + 1):
        steps.append(f"t{k} AS MATERIALIZED (SELECT *, least(l_n, r_n) AS n FROM p{k - 1} QUALIFY row_number() OVER (PARTITION BY l ORDER BY {order}) = 1 AND row_number() OVER (PARTITION BY r ORDER BY {order}) = 1)")
        steps.append(
            f"p{k} AS MATERIALIZED (SELECT p.* REPLACE (p.l_n - coalesce(x.n, 0) AS l_n, p.r_n - coalesce(y.n, 0) AS r_n, p.l_from + coalesce(x.n, 0) AS l_from, p.r_from + coalesce(y.n, 0) AS r_from)"
            f" FROM p{k - 1} p LEFT JOIN t{k} x ON x.l = p.l LEFT JOIN t{k} y ON y.r = p.r WHERE p.l_n > coalesce(x.n, 0) AND p.r_n > coalesce(y.n, 0))"
        )
    steps.append("every AS (" + " UNION ALL ".join(f"SELECT l_ids, r_ids, l_from, r_from, score, n FROM t{k}" for k in range(1, rounds + 1)) + ")")
    steps.append("paired AS (SELECT l_ids[l_from + k] AS left_id, r_ids[r_from + k] AS right_id, score FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM every))")
    return f"WITH {_MATCHES}, " + ",\n".join(steps) + " SELECT *, left_id * 7 + 1 = right_id AS is_true FROM paired"


_CAPTURES = """days(k, captured_on) AS (VALUES (0, DATE '2024-05-01'), (1, DATE '2024-05-02'), (2, DATE '2024-05-05'), (3, DATE '2024-05-06')),
seen AS (SELECT c_custkey AS customer, k, captured_on, CASE WHEN (c_custkey + k) % 5 = 0 THEN c_acctbal + k ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 11 <> k THEN c_mktsegment END AS segment
         FROM customer CROSS JOIN days WHERE (c_custkey + k) % 9 <> 0)"""
_DAILY = "daily AS (SELECT user_id, ts::DATE AS snapshot_date, count(*) AS n_events FROM events GROUP BY 1, 2)"
_PROGRESS = """
steps AS (SELECT team_key, competition_key, season_key, stage, group_name, matchday, sum(points)::BIGINT AS points, sum(goals_for)::BIGINT AS goals_for, sum(goals_against)::BIGINT AS goals_against
       FROM ftm WHERE result IS NOT NULL AND stage = 'REGULAR_SEASON' GROUP BY ALL),
cum AS (SELECT *, (sum(points) OVER w)::BIGINT AS cumulative_points, (sum(goals_for) OVER w)::BIGINT AS cumulative_goals_for, (sum(goals_against) OVER w)::BIGINT AS cumulative_goals_against FROM steps
       WINDOW w AS (PARTITION BY team_key, competition_key, season_key, stage, group_name ORDER BY matchday ROWS UNBOUNDED PRECEDING)),
progress AS (SELECT *, cumulative_goals_for - cumulative_goals_against AS cumulative_goal_difference, rank() OVER (PARTITION BY competition_key, season_key, stage, group_name, matchday
       ORDER BY cumulative_points DESC, cumulative_goals_for - cumulative_goals_against DESC, cumulative_goals_for DESC)::INT AS league_position FROM cum)"""


def _grain(table: str, columns: str, source: str) -> str:
    return f"SELECT 'grain' AS \"check\", '{table}' AS \"table\", '{columns}' AS columns, coalesce(sum(n), 0)::BIGINT AS tested, coalesce(sum(n - 1), 0)::BIGINT AS violations FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns})"


def _reference(table: str, column: str, source: str, parent: str, key: str) -> str:
    return f"SELECT 'reference' AS \"check\", '{table}' AS \"table\", '{column}' AS columns, count(*) AS tested, count(*) FILTER (WHERE k NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)) AS violations FROM (SELECT DISTINCT {column} AS k FROM {source} WHERE {column} IS NOT NULL)"


_VALIDATION = [
    _grain("dim_date", "date_key", "dd"), _grain("dim_competition", "competition_key", "dc"), _grain("dim_season", "season_key", "ds"), _grain("dim_team", "team_key", "dt"), _grain("dim_player", "player_key", "dp"),
    _grain("fact_matches", "match_id", "fm"), _grain("fact_team_match", "match_id,venue", "ftm"), _grain("fact_top_scorers", "competition_key,snapshot_date_key,player_key", "fts"),
    _grain("agg_team_season", "team_key,competition_key,season_key", "season"), _grain("agg_home_away", "team_key,competition_key,season_key,venue", "venues"),
    _grain("agg_matchday_progress", "team_key,competition_key,season_key,stage,group_name,matchday", "progress"),
]
for _t, _s, _cs in (
    ("fact_matches", "fm", ("date_key", "competition_key", "season_key", "home_team_key", "away_team_key")),
    ("fact_team_match", "ftm", ("date_key", "competition_key", "season_key", "team_key", "opponent_key")),
    ("fact_top_scorers", "fts", ("snapshot_date_key", "competition_key", "season_key", "player_key", "team_key")),
    ("agg_team_season", "season", ("competition_key", "season_key", "team_key")),
    ("agg_home_away", "venues", ("competition_key", "season_key", "team_key")),
    ("agg_matchday_progress", "progress", ("competition_key", "season_key", "team_key")),
):
    for _c in _cs:
        _parent, _key = ("dd", "date_key") if "date" in _c else ("dc", _c) if _c == "competition_key" else ("ds", _c) if _c == "season_key" else ("dp", _c) if _c == "player_key" else ("dt", "team_key")
        _VALIDATION.append(_reference(_t, _c, _s, _parent, _key))

_TEXT_DAY = "round(sum(c_acctbal::DECIMAL(18,2)), 0)::BIGINT"

SQL: dict[str, str] = {
    "flatten_nested_json": "SELECT o_orderkey AS order_id, o_custkey AS cust_key, l_linenumber AS line, l_partkey AS part_key, l_quantity AS quantity, l_returnflag AS flag FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "flatten_struct_only": "SELECT o_orderkey AS order_id, o_custkey AS cust_key, o_orderstatus AS status FROM orders",
    "flatten_two_level": "SELECT n_regionkey AS region_key, n_name AS nation, c_custkey AS cust_key, coalesce(c_mktsegment, 'NONE') AS segment FROM nation JOIN customer ON n_nationkey = c_nationkey",
    "flatten_props": "SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "flatten_members_counts": "SELECT conv_id, (count(*) OVER (PARTITION BY conv_id))::INT AS n_turns, turn, role FROM conversations",
    "file_key_extract": r"SELECT page_id, try_cast(nullif(regexp_extract(url, '/(\d+)(?:[?#].*)?$', 1), '') AS BIGINT) AS url_key FROM pages",
    "permissive_bad_leaf": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events",
    "typed_matches": f"WITH {_MATCHES} SELECT match_id, match_date AS match_day, CASE WHEN stage = 'KNOCKOUT' THEN 'NONE' ELSE stage END AS stage, CASE WHEN is_finished AND home_goals IS NOT NULL THEN CASE WHEN home_goals > away_goals THEN 'HOME_WIN' WHEN home_goals < away_goals THEN 'AWAY_WIN' ELSE 'DRAW' END END AS result, CASE WHEN is_finished THEN home_goals + away_goals END AS total_goals FROM matchup WHERE match_id % 13 <> 0",
    "typed_standings": f"SELECT (c_custkey % 3)::INT AS capture, c_nationkey, {_TEXT_DAY} AS balance, (rank() OVER (PARTITION BY c_custkey % 3 ORDER BY {_TEXT_DAY} DESC, c_nationkey))::INT AS position FROM customer GROUP BY c_custkey % 3, c_nationkey",
    "typed_scorers": "SELECT c_custkey AS player_id, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 40)::INT ELSE 0 END AS goals FROM customer",
    "typed_members": "SELECT s_suppkey AS team_id, s_name AS team_name, s_nationkey::BIGINT AS area_id FROM supplier",
    "event_clock_seconds": f"WITH {_CLOCK} SELECT event_id, seconds FROM clocks",
    "event_flags": "SELECT event_id, event_type = 'purchase' AS is_shot, event_type = 'purchase' AND value > 50 AS is_goal, CASE WHEN event_id % 2 = 0 THEN event_type = 'view' ELSE false END AS flag FROM events",
    "contract_valid": "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
    "contract_invalid": "SELECT doc_id, 'null_required_field' AS quarantine_reason FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL",
    "drift_clean": f"WITH {_CLOCK} SELECT event_id, seconds FROM clocks WHERE seconds IS NOT NULL",
    "drift_rejected": f"WITH {_CLOCK} SELECT event_id, clock FROM clocks WHERE seconds IS NULL",
    "quarantine_report": "SELECT 'events' AS source_table, 'cast_failed_schema_drift' AS quarantine_reason, 'b1' AS batch_id, DATE '2024-02-01' AS quarantined_on, count(*) AS n_rows FROM events WHERE event_id % 11 = 0 UNION ALL SELECT 'documents', 'null_required_field', 'b1', DATE '2024-02-01', count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL",
    "surrogate_keys": f"""WITH s AS (SELECT *, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE END AS a, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS d, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p FROM orders),
t AS (SELECT *, CASE WHEN a IS NULL THEN 'Unknown' WHEN year(a) = year(a + INTERVAL 9 MONTH) THEN year(a)::VARCHAR ELSE year(a) || '/' || lpad((year(a + INTERVAL 9 MONTH) % 100)::VARCHAR, 2, '0') END AS label FROM s)
SELECT o_orderkey, {_sk('p')} AS priority_key, coalesce((year(d) * 10000 + month(d) * 100 + day(d))::INT, -1) AS day_key, label, {_sk("nullif(label, 'Unknown')")} AS label_key FROM t""",
    "latest_row_per_key": "WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3, 4) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC) = 1",
    "upsert_final_state": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 >= 4 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
    "upsert_bucketed": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 >= 4 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
    "upsert_counts": "SELECT count(*) FILTER (WHERE c_custkey % 10 >= 6) AS inserted, count(*) FILTER (WHERE c_custkey % 10 IN (4, 5)) AS updated, count(*) FILTER (WHERE c_custkey % 10 < 4) AS kept FROM customer",
    "upsert_schema_growth": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 1 THEN s_nationkey END AS s_nationkey FROM supplier",
    "delete_where": "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE NOT (s_suppkey % 7 <> 0 AND s_acctbal < 0)",
    "snapshot_accumulate": f"WITH {_DAILY} SELECT user_id, snapshot_date, CASE WHEN day(snapshot_date) >= 15 THEN n_events + 100 ELSE n_events END AS n_events FROM daily",
    "feed_matches": f"""WITH {_MATCHES}, g AS (SELECT *, CASE WHEN match_id % 19 <> 0 THEN home_goals END AS h FROM matchup WHERE match_id % 17 <> 0 AND match_id % 13 <> 0)
SELECT match_id, competition_code, season_id, season_start_date, match_date, match_status, is_finished, matchday, stage, 'NONE' AS group_name, home_team_id, 'Team ' || away_team_id AS away_team_name, h AS home_goals, away_goals,
CASE WHEN is_finished AND h IS NOT NULL AND away_goals IS NOT NULL THEN CASE WHEN h > away_goals THEN 'HOME_WIN' WHEN h < away_goals THEN 'AWAY_WIN' ELSE 'DRAW' END END AS result, CASE WHEN is_finished THEN h + away_goals END AS total_goals FROM g""",
    "feed_scorers": "SELECT 'PL' AS competition_code, 7::BIGINT AS season_id, c_custkey AS player_id, c_name AS player_name, (DATE '1990-01-01' + (c_custkey % 900)::INT)::DATE AS player_date_of_birth, c_custkey % 30 AS team_id, 'Team ' || (c_custkey % 30) AS team_name, (c_custkey % 38)::INT AS played_matches, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 40)::INT ELSE 0 END AS goals, 0 AS assists, 0 AS penalties, DATE '2025-10-01' AS snapshot_date FROM customer WHERE c_custkey % 7 <> 0",
    "lake_schema_growth": f"WITH {_DAILY} SELECT user_id, snapshot_date, CASE WHEN day(snapshot_date) = 15 AND user_id % 2 = 0 THEN 0 ELSE n_events END AS n_events, CASE WHEN day(snapshot_date) BETWEEN 11 AND 20 AND NOT (day(snapshot_date) = 15 AND user_id % 2 = 0) THEN n_events * 2 END AS twice, CASE WHEN day(snapshot_date) > 20 THEN n_events / 2 END AS half FROM daily",
    "feed_standings": """WITH c AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name, count(*)::INT AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT 'R' || r AS competition_code, 7::BIGINT AS season_id, 'REGULAR_SEASON' AS stage, kind AS standing_type, grp AS group_name, k AS position, k::BIGINT AS team_id, n_name AS team_name, substr(n_name, 1, 3) AS team_tla, n AS played_games, n % 7 AS won, n % 3 AS draw,
NULL::INT AS lost, CASE WHEN k % 6 <> 5 THEN n * 3 END AS points, n % 5 - 2 AS goal_difference, DATE '2025-10-01' AS snapshot_date FROM c, (VALUES ('TOTAL', 'NONE'), ('HOME', 'A')) p(kind, grp) WHERE k % 8 <> 7 AND (kind = 'TOTAL' OR r % 2 = 1)""",
    "feed_teams": """SELECT 'N' || s_nationkey AS competition_code, 7::BIGINT AS season_id, s_suppkey AS team_id, s_name AS team_name, substr(s_name, 1, 4) AS team_short_name, CASE WHEN s_suppkey % 5 <> 4 THEN (1900 + s_suppkey % 100)::INT END AS founded, s_name || ' ground' AS venue,
'Area' AS area_name, CASE WHEN s_suppkey % 3 = 0 THEN 'C. Oach' END AS coach_name, CASE WHEN s_suppkey % 4 <> 3 THEN (s_suppkey % 4 + 1)::INT END AS squad_size FROM supplier WHERE s_suppkey % 11 <> 10""",
    "feed_event_matches": f"""WITH {_MATCHES} SELECT match_id, match_date, '15:00' AS kick_off, competition_id, competition_name, 'X' AS country_name, season_id, home_team_id, 'Team ' || home_team_id AS home_team_name, away_team_id, 'Team ' || away_team_id AS away_team_name,
CASE WHEN match_id % 19 <> 0 THEN home_goals END AS home_goals, away_goals, stage AS competition_stage, NULL::VARCHAR AS stadium_name FROM matchup WHERE match_id % 17 <> 0 AND match_id % 13 <> 0""",
    "feed_events": """WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'Shot' WHEN 'click' THEN 'Pass' ELSE upper(event_type[1]) || event_type[2:] END AS kind FROM events WHERE event_id % 11 <> 0)
SELECT event_id::VARCHAR AS event_id, user_id % 50 AS match_id, round((epoch_us(ts) // 1000 % 86400000) / 1000, 3) AS event_seconds, kind AS event_type, CASE WHEN event_id % 5 < 4 THEN value END AS location_x, CASE WHEN event_id % 5 BETWEEN 1 AND 3 THEN value + 1 END AS location_y,
event_id % 7 = 0 AS under_pressure, CASE WHEN kind = 'Pass' THEN value END AS pass_length, kind = 'Pass' AND event_id % 2 = 0 AS pass_is_cross, CASE WHEN kind = 'Shot' THEN value END AS shot_xg, CASE WHEN kind = 'Shot' THEN if(value > 50, 'Goal', 'Saved') END AS shot_outcome,
kind = 'Shot' AS is_shot, kind = 'Shot' AND value > 50 AS is_goal, kind = 'Pass' AND event_id % 3 <> 0 AS is_completed_pass FROM e""",
    "feed_lineups": """SELECT conv_id % 40 AS match_id, (CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END)::BIGINT AS team_id, 'T' || CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS team_name, conv_id * 1000 + turn AS player_id,
'P' || (conv_id * 1000 + turn) AS player_name, (turn % 30)::INT AS jersey_number, (turn % 3)::INT AS card_count FROM conversations WHERE (conv_id * 1000 + turn) % 9 <> 4""",
    "feed_file_ledger": """SELECT o_orderkey % 60 AS number, CASE WHEN o_orderkey % 60 % 7 = 3 OR o_orderkey % 60 % 11 = 5 THEN 0 ELSE 1 END::BIGINT AS n_records, CASE WHEN o_orderkey % 60 % 7 = 3 OR o_orderkey % 60 % 11 = 5 THEN 0 ELSE count(*) END AS n_rows,
CASE WHEN o_orderkey % 60 % 7 = 3 THEN 'broken' WHEN o_orderkey % 60 % 11 = 5 THEN 'empty' ELSE 'read' END AS status FROM orders GROUP BY o_orderkey % 60""",
    "payload_undeclared": """WITH o AS (SELECT *, o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 AS odd FROM orders WHERE o_orderkey % 29 <> 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 7 = 0))
SELECT 'buyer' AS field, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_rows, 'OBJECT<key: BIGINT>' AS kind FROM o UNION ALL SELECT 'it''s rank', count(*), 'BIGINT' FROM o
UNION ALL SELECT 'total', count(*) FILTER (WHERE odd OR o_orderkey % 7 <> 0), 'VARIANT' FROM o""",
    "payload_replay": """WITH o AS (SELECT *, o_orderkey % 29 = 0 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 7 = 0) AS bad FROM orders)
SELECT o_orderkey AS row, CASE WHEN NOT bad THEN o_orderkey END AS id, CASE WHEN NOT bad THEN o_orderstatus END AS status, CASE WHEN NOT bad THEN substr(o_orderpriority, 1, 1)::INT END AS rank, CASE WHEN NOT bad AND o_orderkey % 7 <> 0 THEN o_totalprice END AS total,
CASE WHEN NOT bad AND o_orderkey % 3 = 0 THEN o_custkey END AS buyer_key, NOT bad AND o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 AS is_drift FROM o""",
    "customer_change_feed": f"""WITH {_CAPTURES} SELECT coalesce(n.captured_on, o.next_on) AS captured, coalesce(n.customer, o.customer) AS customer, CASE WHEN o.customer IS NULL THEN 'inserted' WHEN n.customer IS NULL THEN 'deleted' ELSE 'changed' END AS change,
CASE WHEN o.customer IS NULL OR n.customer IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.balance IS DISTINCT FROM n.balance THEN 'balance' END, CASE WHEN o.segment IS DISTINCT FROM n.segment THEN 'segment' END) END AS changed,
CASE WHEN coalesce(n.k, o.k + 1) = 2 THEN 3 ELSE 1 END::INT AS days, o.balance AS old_balance, n.balance AS new_balance, o.segment AS old_segment, n.segment AS new_segment
FROM (SELECT * FROM seen WHERE k > 0) n FULL JOIN (SELECT *, captured_on + CASE WHEN k = 1 THEN 3 ELSE 1 END AS next_on FROM seen WHERE k < 3) o ON o.customer = n.customer AND o.k + 1 = n.k
WHERE o.customer IS NULL OR n.customer IS NULL OR o.balance IS DISTINCT FROM n.balance OR o.segment IS DISTINCT FROM n.segment""",
    "customer_capture_gaps": "SELECT DATE '2024-05-05' AS captured, DATE '2024-05-02' AS before, 3::INT AS days WHERE (SELECT count(*) FROM customer) > 0",
    "interleaved_layout": """SELECT 'l_shipdate' AS column, count(*) FILTER (WHERE l_shipdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-31') AS n_rows, true AS skips_half FROM lineitem
UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity BETWEEN 7 AND 8), true FROM lineitem""",
    "cross_source_matches": _linkage(12),
    "lake_null_capture": f"""WITH {_DAILY}, early AS (SELECT * FROM daily WHERE day(snapshot_date) <= 12), lost AS (SELECT user_id, sum(n_events)::BIGINT AS n_events FROM early GROUP BY user_id)
SELECT user_id, snapshot_date, CASE WHEN day(snapshot_date) = 5 AND user_id % 2 = 0 THEN -n_events ELSE n_events END AS n_events FROM early
UNION ALL SELECT user_id, NULL, CASE WHEN user_id % 3 > 0 THEN -n_events ELSE n_events END FROM lost""",
    "lake_type_growth": f"""WITH {_DAILY} SELECT user_id, snapshot_date, (CASE WHEN day(snapshot_date) = 3 AND user_id % 2 = 0 THEN 0.5 WHEN day(snapshot_date) BETWEEN 9 AND 16 THEN n_events::DOUBLE * 8589934592
WHEN day(snapshot_date) BETWEEN 17 AND 24 THEN n_events / 8 ELSE n_events END)::DOUBLE AS n_events FROM daily""",
    "lake_partition_delete": f"""WITH {_DAILY} SELECT * FROM daily WHERE NOT (day(snapshot_date) IN (4, 11) OR (day(snapshot_date) <= 15 AND n_events > 1)) OR (day(snapshot_date) = 4 AND user_id % 3 = 0)""",
    "snapshot_latest": f"WITH {_DAILY} SELECT * FROM daily WHERE snapshot_date = (SELECT max(snapshot_date) FROM daily WHERE n_events > 1)",
    "snapshot_filter": f"WITH {_DAILY} SELECT * FROM daily WHERE snapshot_date = DATE '2024-01-10'",
    "snapshot_delta": f"WITH {_DAILY} SELECT *, n_events - lag(n_events) OVER (PARTITION BY user_id ORDER BY snapshot_date) AS delta FROM daily",
    "running_orders": "WITH d AS (SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2) SELECT *, (sum(n) OVER (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM d",
    "scd1_dimension": f"SELECT {_sk('c_custkey')} AS customer_key, c_custkey, c_name, CASE WHEN c_custkey % 10 >= 4 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer",
    "date_spine": f"WITH {_spine('SELECT least(min(o_orderdate), (SELECT min(ts) FROM events))::DATE AS lo, greatest(max(o_orderdate), (SELECT max(ts) FROM events))::DATE AS hi FROM orders')} SELECT * FROM dd",
    "dim_date": f"WITH {_MATCHES}, {_DATE} SELECT * FROM dd",
    "dim_competition": f"WITH {_MATCHES}, {_COMPETITION} SELECT * FROM dc",
    "dim_season": f"WITH {_MATCHES}, {_DIM_SEASON} SELECT * FROM ds",
    "dim_team": f"WITH {_MATCHES}, {_DIM_TEAM} SELECT * FROM dt",
    "dim_player": f"WITH {_MATCHES}, {_PLAYER} SELECT * FROM dp",
    "fact_matches": f"""WITH {_MATCHES}, {_FACT} SELECT * EXCLUDE (ok), CASE WHEN ok THEN home_goals + away_goals END AS total_goals, CASE WHEN ok THEN home_goals - away_goals END AS goal_difference,
CASE WHEN ok THEN CASE WHEN home_goals > away_goals THEN 'HOME_WIN' WHEN home_goals < away_goals THEN 'AWAY_WIN' ELSE 'DRAW' END END AS result,
CASE WHEN ok THEN CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END END AS home_points, CASE WHEN ok THEN CASE WHEN home_goals < away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END END AS away_points FROM fm""",
    "fact_team_match": f"WITH {_MATCHES}, {_FACT} SELECT * FROM ftm",
    "fact_top_scorers": f"WITH {_MATCHES}, {_TOP} SELECT * FROM fts",
    "agg_team_season_table": f"WITH {_MATCHES}, {_FACT}, {_SEASON} SELECT * FROM season",
    "agg_home_away_table": f"WITH {_MATCHES}, {_FACT}, {_VENUE} SELECT * FROM venues",
    "agg_matchday_progress_table": f"WITH {_MATCHES}, {_FACT}, {_PROGRESS} SELECT * FROM progress",
    "league_table": f"WITH {_MATCHES}, {_FACT}, {_SEASON}, {_DIM_TEAM}, {_COMPETITION}, {_DIM_SEASON} SELECT season_rank, team_name, matches_played, points, goal_difference FROM season JOIN dt USING (team_key) JOIN dc USING (competition_key) JOIN ds USING (season_key) WHERE competition_code = '1-URGENT' AND season_label = '1997/98' ORDER BY season_rank, team_name LIMIT 10",
    "home_vs_away": f"WITH {_MATCHES}, {_FACT}, {_VENUE}, {_COMPETITION} SELECT venue, sum(matches_played)::BIGINT AS matches, round(sum(wins) / sum(matches_played), 3) AS win_rate, round(sum(goals_for) / sum(matches_played), 2) AS goals_per_match, round(sum(points) / sum(matches_played), 2) AS points_per_game FROM venues JOIN dc USING (competition_key) WHERE competition_type = 'LEAGUE' GROUP BY venue",
    "top_scorers": f"WITH {_MATCHES}, {_TOP}, {_PLAYER}, {_COMPETITION} SELECT player_id, player_name, competition_code, goals, assists, penalties, goals_per_match FROM fts JOIN dp USING (player_key) JOIN dc USING (competition_key) WHERE snapshot_date = (SELECT max(snapshot_date) FROM fts) ORDER BY goals DESC, assists DESC, player_id, competition_code LIMIT 10",
    "grain_report": " UNION ALL ".join([_grain("lineitem", "l_orderkey,l_linenumber", "lineitem"), _grain("orders", "o_orderkey", "orders"), _grain("events", "user_id,event_type", "events")]),
    "fk_report": " UNION ALL ".join([_reference("orders", "o_custkey", "orders", "customer", "c_custkey"), _reference("documents", "doc_id", "documents", "labels", "doc_id"), _reference("events", "user_id", "events", "supplier", "s_suppkey")]),
    "star_validation": f"WITH {_MATCHES}, {_FACT}, {_SEASON}, {_VENUE}, {_PROGRESS}, {_TOP}, {_COMPETITION}, {_DIM_SEASON}, {_DIM_TEAM}, {_PLAYER}, {_DATE} " + " UNION ALL ".join(_VALIDATION),
    "audit_rollup": "SELECT 'bronze' AS layer, load_type, 'SUCCESS' AS status, 2::BIGINT AS n_steps, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS rows_read, CASE WHEN load_type = 'FULL' THEN (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) ELSE 0 END AS rows_inserted FROM (VALUES ('FULL'), ('INCREMENTAL')) t(load_type)",
    "clustered_layout": "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey FROM lineitem",
    "lake_round_trip": "SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, day(o_orderdate)::INT AS day FROM orders",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
