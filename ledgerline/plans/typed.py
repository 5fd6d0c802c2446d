"""Typed tables of the sports-match model: casts, drift and business rules, declared for each table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Cast, clock_seconds, decided, has_drift, verdict
from ..operators.quality import split_rows

LINEAGE = ("source_file", "batch_id", "load_type")


@dataclass(frozen=True)
class TypedTable:
    """How a flat table becomes a typed one.

    casts and computed give new columns and are what drift is judged by;
    columns is the result: name -> source column.  Column expressions are made
    when they are used, as they need a session.
    """

    source: str
    keys: tuple[str, ...]
    columns: Mapping[str, str]
    casts: Sequence[Cast] = ()
    computed: Callable[[], Mapping[str, tuple[str, Column]]] = dict
    defaults: Mapping[str, object] = field(default_factory=dict)
    rules: Callable[[], Mapping[str, Column]] = dict
    snapshot: bool = False

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(typed rows, drifted rows as they came)."""
        computed, rules = self.computed(), self.rules()
        cast = {f"_{c.name}": c.column() for c in self.casts} | {f"_{name}": made for name, (_, made) in computed.items()}
        pairs = [(F.col(c.source), F.col(f"_{c.name}")) for c in self.casts] + [(F.col(source), F.col(f"_{name}")) for name, (source, _) in computed.items()]
        good, bad = split_rows(df.withColumns(cast), has_drift(pairs))
        names = list(self.columns) + [n for n in LINEAGE if n in df.columns]
        values = {n: F.col(self.columns.get(n, n)) for n in names}
        values |= {n: F.coalesce(values[n], F.lit(v)) for n, v in self.defaults.items()}
        typed = good.select(*[v.alias(n) for n, v in values.items()])
        return typed.withColumns(dict(rules)) if rules else typed, bad.select(*df.columns)


def _same(text: str) -> dict[str, str]:
    return {w.partition("=")[0]: w.partition("=")[2] or w for w in text.split()}


def _match_rules() -> dict[str, Column]:
    final, home, away = F.col("match_status") == "FINISHED", F.col("home_goals"), F.col("away_goals")
    counts = decided(final, home, away)
    return {
        "match_date": F.to_date("kickoff_utc"),
        "is_finished": final,
        "result": verdict(counts, home, away, ("HOME_WIN", "DRAW", "AWAY_WIN")),
        "total_goals": F.when(counts, home + away),
    }


def _event_rules() -> dict[str, Column]:
    kind = F.col("event_type")
    return {
        "is_shot": kind == "Shot",
        "is_goal": (kind == "Shot") & F.col("shot_outcome").eqNullSafe(F.lit("Goal")),
        "is_completed_pass": (kind == "Pass") & F.col("pass_outcome").isNull(),
    }


MATCHES = TypedTable(
    "matches",
    ("match_id",),
    _same(
        "match_id competition_code competition_id competition_name season_id season_start_date=_season_start_date season_end_date=_season_end_date kickoff_utc=_kickoff_utc"
        " match_status=status matchday stage group_name home_team_id home_team_name home_team_tla away_team_id away_team_name away_team_tla home_goals=full_time_home"
        " away_goals=full_time_away home_goals_ht=half_time_home away_goals_ht=half_time_away winner=score_winner source_last_updated=_source_last_updated"
    ),
    [Cast("utc_date", "kickoff_utc", "timestamp"), Cast("source_last_updated", "source_last_updated", "timestamp"), Cast("season_start_date", "season_start_date", "date"), Cast("season_end_date", "season_end_date", "date")],
    defaults={"group_name": "NONE"},
    rules=_match_rules,
)
STANDINGS = TypedTable(
    "standings",
    ("competition_code", "season_id", "stage", "standing_type", "group_name", "team_id", "snapshot_date"),
    _same("competition_code competition_id season_id stage standing_type group_name position team_id team_name team_tla played_games form won draw lost points goals_for goals_against goal_difference snapshot_date"),
    defaults={"group_name": "NONE"},
    snapshot=True,
)
SCORERS = TypedTable(
    "scorers",
    ("competition_code", "season_id", "player_id", "snapshot_date"),
    _same("competition_code season_id player_id player_name player_date_of_birth=_player_date_of_birth player_nationality player_position team_id team_name played_matches goals assists penalties snapshot_date"),
    [Cast("player_date_of_birth", "player_date_of_birth", "date")],
    defaults={"goals": 0, "assists": 0, "penalties": 0},
    snapshot=True,
)
TEAMS = TypedTable(
    "teams",
    ("competition_code", "season_id", "team_id"),
    _same("competition_code season_id team_id team_name team_short_name team_tla founded club_colors venue area_name coach_name coach_nationality squad_size"),
)
EVENT_MATCHES = TypedTable(
    "event_matches",
    ("match_id",),
    _same(
        "match_id match_date=_match_date kick_off competition_id competition_name country_name season_id season_name home_team_id home_team_name away_team_id away_team_name"
        " home_goals=home_score away_goals=away_score match_status match_week competition_stage stadium_name referee_name"
    ),
    [Cast("match_date", "match_date", "date")],
)
EVENTS = TypedTable(
    "events",
    ("event_id",),
    _same(
        "event_id match_id event_index period event_seconds=_event_seconds minute second duration event_type=type_name play_pattern possession possession_team=possession_team_name team_id team_name"
        " player_id player_name position=position_name location_x location_y under_pressure pass_length pass_angle pass_height pass_outcome pass_body_part pass_recipient_name pass_end_x pass_end_y"
        " pass_is_cross pass_is_goal_assist shot_xg shot_outcome shot_technique shot_body_part shot_type shot_end_x shot_end_y carry_end_x carry_end_y dribble_outcome duel_type duel_outcome"
        " goalkeeper_action foul_card"
    ),
    computed=lambda: {"event_seconds": ("event_timestamp_raw", clock_seconds("event_timestamp_raw"))},
    defaults={"under_pressure": False, "pass_is_cross": False, "pass_is_goal_assist": False},
    rules=_event_rules,
)
LINEUPS = TypedTable(
    "lineups",
    ("match_id", "team_id", "player_id"),
    _same("match_id team_id team_name player_id player_name player_nickname jersey_number country_name card_count"),
)
TYPED = {t.source: t for t in (MATCHES, STANDINGS, SCORERS, TEAMS, EVENT_MATCHES, EVENTS, LINEUPS)}
