"""The raw feeds of the sports-match model: schemas, and how they become rows.

Schemas and column lists are fixed values of the feeds' formats: field names
and types of the files, and the names of the columns they turn into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.flatten import element, first_of, flatten, size_or_zero
from ..sources import Feed, key_from_path

_PAIR = "struct<home: int, away: int>"
_IDENTITY = "struct<id: bigint, name: string>"
_TEAM = "struct<id: bigint, name: string, shortName: string, tla: string, crest: string>"
_COMPETITION = "struct<id: bigint, name: string, code: string, type: string, emblem: string>"
_SEASON = "struct<id: bigint, startDate: string, endDate: string, currentMatchday: int, winner: string>"
_HEAD = f"competition {_COMPETITION}, season {_SEASON}"

MATCHES = Feed(
    "matches",
    f"competition {_COMPETITION}, resultSet struct<count: int, first: string, last: string, played: int>, matches array<struct<id: bigint, utcDate: string, status: string, matchday: int, stage: string,"
    f" group: string, lastUpdated: string, area: {_IDENTITY}, competition: {_COMPETITION}, season: {_SEASON}, homeTeam: {_TEAM}, awayTeam: {_TEAM},"
    f" score: struct<winner: string, duration: string, fullTime: {_PAIR}, halfTime: {_PAIR}>, referees: array<struct<id: bigint, name: string, type: string, nationality: string>>>>",
    ("match_id",),
)
STANDINGS = Feed(
    "standings",
    f"area {_IDENTITY}, {_HEAD}, standings array<struct<stage: string, type: string, group: string, table: array<struct<position: int, team: {_TEAM}, playedGames: int, form: string, won: int, draw: int,"
    " lost: int, points: int, goalsFor: int, goalsAgainst: int, goalDifference: int>>>>",
    ("competition_code", "team_id"),
    snapshot=True,
)
SCORERS = Feed(
    "scorers",
    f"count int, {_HEAD}, scorers array<struct<player: struct<id: bigint, name: string, firstName: string, lastName: string, dateOfBirth: string, nationality: string, section: string, position: string,"
    f" shirtNumber: int>, team: {_TEAM}, playedMatches: int, goals: int, assists: int, penalties: int>>",
    ("competition_code", "player_id"),
    snapshot=True,
)
TEAMS = Feed(
    "teams",
    f"count int, {_HEAD}, teams array<struct<id: bigint, name: string, shortName: string, tla: string, crest: string, address: string, website: string, founded: int, clubColors: string, venue: string,"
    f" lastUpdated: string, area: {_IDENTITY}, coach: struct<id: bigint, name: string, nationality: string>,"
    " squad: array<struct<id: bigint, name: string, position: string, dateOfBirth: string, nationality: string>>>>",
    ("competition_code", "team_id"),
)
EVENT_MATCHES = Feed(
    "event_matches",
    "match_id bigint, match_date string, kick_off string, home_score int, away_score int, match_status string, last_updated string, match_week int,"
    " competition struct<competition_id: bigint, country_name: string, competition_name: string>, season struct<season_id: bigint, season_name: string>,"
    " home_team struct<home_team_id: bigint, home_team_name: string>, away_team struct<away_team_id: bigint, away_team_name: string>,"
    f" competition_stage {_IDENTITY}, stadium {_IDENTITY}, referee {_IDENTITY}",
    ("match_id",),
)
EVENTS = Feed(
    "events",
    "id string, index int, period int, timestamp string, minute int, second int, duration double, possession int, under_pressure boolean, counterpress boolean, off_camera boolean, out boolean,"
    f" location array<double>, related_events array<string>, type {_IDENTITY}, possession_team {_IDENTITY}, play_pattern {_IDENTITY}, team {_IDENTITY}, player {_IDENTITY}, position {_IDENTITY},"
    f" pass struct<recipient: {_IDENTITY}, length: double, angle: double, height: {_IDENTITY}, end_location: array<double>, body_part: {_IDENTITY}, type: {_IDENTITY}, outcome: {_IDENTITY}, `switch`: boolean,"
    " `cross`: boolean, through_ball: boolean, shot_assist: boolean, goal_assist: boolean>,"
    f" shot struct<statsbomb_xg: double, end_location: array<double>, outcome: {_IDENTITY}, technique: {_IDENTITY}, body_part: {_IDENTITY}, type: {_IDENTITY}, first_time: boolean, one_on_one: boolean,"
    f" aerial_won: boolean>, carry struct<end_location: array<double>>, dribble struct<outcome: {_IDENTITY}, nutmeg: boolean, overrun: boolean>, duel struct<type: {_IDENTITY}, outcome: {_IDENTITY}>,"
    f" goalkeeper struct<type: {_IDENTITY}, outcome: {_IDENTITY}, position: {_IDENTITY}, technique: {_IDENTITY}, body_part: {_IDENTITY}>, ball_receipt struct<outcome: {_IDENTITY}>,"
    f" foul_committed struct<card: {_IDENTITY}, type: {_IDENTITY}, advantage: boolean>, substitution struct<outcome: {_IDENTITY}, replacement: {_IDENTITY}>",
    ("event_id", "match_id"),
)
LINEUPS = Feed(
    "lineups",
    f"team_id bigint, team_name string, lineup array<struct<player_id: bigint, player_name: string, player_nickname: string, jersey_number: int, country: {_IDENTITY},"
    " cards: array<struct<time: string, card_type: string, reason: string, period: int>>,"
    " positions: array<struct<position_id: int, position: string, `from`: string, `to`: string, from_period: int, to_period: int, start_reason: string, end_reason: string>>>>",
    ("match_id", "team_id", "player_id"),
)
FEEDS = {f.name: f for f in (MATCHES, STANDINGS, SCORERS, TEAMS, EVENT_MATCHES, EVENTS, LINEUPS)}


def _columns(text: str) -> dict[str, str]:
    """Lines of "name path", or one word where both are the same."""
    return {words[0]: words[-1] for words in (line.split() for line in text.strip().splitlines())}


_MATCH = _columns("""
    match_id m.id
    competition_id m.competition.id
    competition_name m.competition.name
    season_id m.season.id
    season_start_date m.season.startDate
    season_end_date m.season.endDate
    season_current_matchday m.season.currentMatchday
    utc_date m.utcDate
    status m.status
    matchday m.matchday
    stage m.stage
    group_name m.group
    source_last_updated m.lastUpdated
    home_team_id m.homeTeam.id
    home_team_name m.homeTeam.name
    home_team_tla m.homeTeam.tla
    away_team_id m.awayTeam.id
    away_team_name m.awayTeam.name
    away_team_tla m.awayTeam.tla
    score_winner m.score.winner
    score_duration m.score.duration
    full_time_home m.score.fullTime.home
    full_time_away m.score.fullTime.away
    half_time_home m.score.halfTime.home
    half_time_away m.score.halfTime.away
    referees m.referees
""")
_STANDING = _columns("""
    competition_code competition.code
    competition_id competition.id
    season_id season.id
    stage part.stage
    standing_type part.type
    position line.position
    team_id line.team.id
    team_name line.team.name
    team_tla line.team.tla
    played_games line.playedGames
    form line.form
    won line.won
    draw line.draw
    lost line.lost
    points line.points
    goals_for line.goalsFor
    goals_against line.goalsAgainst
    goal_difference line.goalDifference
""")
_SCORER = _columns("""
    competition_code competition.code
    season_id season.id
    player_id s.player.id
    player_name s.player.name
    player_date_of_birth s.player.dateOfBirth
    player_nationality s.player.nationality
    player_position s.player.position
    team_id s.team.id
    team_name s.team.name
    played_matches s.playedMatches
    goals s.goals
    assists s.assists
    penalties s.penalties
""")
_TEAM_ROW = _columns("""
    competition_code competition.code
    season_id season.id
    team_id t.id
    team_name t.name
    team_short_name t.shortName
    team_tla t.tla
    founded t.founded
    club_colors t.clubColors
    venue t.venue
    address t.address
    website t.website
    area_name t.area.name
    coach_id t.coach.id
    coach_name t.coach.name
    coach_nationality t.coach.nationality
    squad t.squad
    source_last_updated t.lastUpdated
""")
_EVENT_MATCH = _columns("""
    match_id
    match_date
    kick_off
    competition_id competition.competition_id
    competition_name competition.competition_name
    country_name competition.country_name
    season_id season.season_id
    season_name season.season_name
    home_team_id home_team.home_team_id
    home_team_name home_team.home_team_name
    away_team_id away_team.away_team_id
    away_team_name away_team.away_team_name
    home_score
    away_score
    match_status
    match_week
    competition_stage competition_stage.name
    stadium_name stadium.name
    referee_name referee.name
    source_last_updated last_updated
""")
_EVENT = _columns("""
    event_id id
    event_index index
    period
    event_timestamp_raw timestamp
    minute
    second
    duration
    possession
    type_id type.id
    type_name type.name
    play_pattern play_pattern.name
    possession_team_id possession_team.id
    possession_team_name possession_team.name
    team_id team.id
    team_name team.name
    player_id player.id
    player_name player.name
    position_name position.name
    under_pressure
    counterpress
    out
    pass_length pass.length
    pass_angle pass.angle
    pass_height pass.height.name
    pass_recipient_id pass.recipient.id
    pass_recipient_name pass.recipient.name
    pass_outcome pass.outcome.name
    pass_body_part pass.body_part.name
    pass_is_cross pass.cross
    pass_is_switch pass.switch
    pass_is_through_ball pass.through_ball
    pass_is_goal_assist pass.goal_assist
    shot_xg shot.statsbomb_xg
    shot_outcome shot.outcome.name
    shot_technique shot.technique.name
    shot_body_part shot.body_part.name
    shot_type shot.type.name
    shot_first_time shot.first_time
    dribble_outcome dribble.outcome.name
    duel_type duel.type.name
    duel_outcome duel.outcome.name
    goalkeeper_action goalkeeper.type.name
    foul_card foul_committed.card.name
    substitution_replacement substitution.replacement.name
""")
#: Pairs of coordinates: column prefix, array.
_PLACES = {"location_": "location", "pass_end_": "pass.end_location", "shot_end_": "shot.end_location", "carry_end_": "carry.end_location"}
_LINEUP = _columns("""
    team_id
    team_name
    player_id p.player_id
    player_name p.player_name
    player_nickname p.player_nickname
    jersey_number p.jersey_number
    country_name p.country.name
    positions p.positions
""")


def flatten_matches(df: DataFrame) -> DataFrame:
    code = first_of("m.competition.code", "competition.code")
    return flatten(df, _MATCH | {"competition_code": code}, [("matches", "m")], ["source_file"])


def flatten_standings(df: DataFrame) -> DataFrame:
    group = first_of("part.group", default="NONE")
    return flatten(df, _STANDING | {"group_name": group}, [("standings", "part"), ("part.table", "line")], ["source_file"])


def flatten_scorers(df: DataFrame) -> DataFrame:
    return flatten(df, _SCORER, [("scorers", "s")], ["source_file"])


def flatten_teams(df: DataFrame) -> DataFrame:
    return flatten(df, _TEAM_ROW | {"squad_size": F.size("t.squad")}, [("teams", "t")], ["source_file"])


def flatten_event_matches(df: DataFrame) -> DataFrame:
    return flatten(df, _EVENT_MATCH, keep=["source_file"])


def flatten_events(df: DataFrame) -> DataFrame:
    places = {f"{prefix}{axis}": element(path, i) for prefix, path in _PLACES.items() for i, axis in enumerate("xy")}
    return flatten(df, _EVENT | places | {"match_id": key_from_path(F.col("source_file"))}, keep=["source_file"])


def flatten_lineups(df: DataFrame) -> DataFrame:
    extra = {"match_id": key_from_path(F.col("source_file")), "card_count": size_or_zero("p.cards")}
    return flatten(df, _LINEUP | extra, [("lineup", "p")], ["source_file"])


FLATTENERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "matches": flatten_matches,
    "standings": flatten_standings,
    "scorers": flatten_scorers,
    "teams": flatten_teams,
    "event_matches": flatten_event_matches,
    "events": flatten_events,
    "lineups": flatten_lineups,
}
