"""The star of the sports-match model, from typed frames.

Every builder takes frames, so it works on tables of a lake and on views alike.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import UNKNOWN_KEY, date_key, decided, period_key, period_label, points, rate, surrogate_key, verdict
from ..operators.aggregates import progress_table, season_table, venue_table
from ..operators.dimensions import calendar, enriched, periods, with_late_members, with_unknown
from ..operators.quality import checks_report
from ..operators.rows import latest_per_key, two_sided

#: Kind and country of the known competitions.
COMPETITIONS = {
    "PL": ("LEAGUE", "England"),
    "ELC": ("LEAGUE", "England"),
    "PD": ("LEAGUE", "Spain"),
    "BL1": ("LEAGUE", "Germany"),
    "SA": ("LEAGUE", "Italy"),
    "FL1": ("LEAGUE", "France"),
    "DED": ("LEAGUE", "Netherlands"),
    "PPL": ("LEAGUE", "Portugal"),
    "BSA": ("LEAGUE", "Brazil"),
    "CL": ("CUP", "Europe"),
    "EC": ("CUP", "Europe"),
    "WC": ("CUP", "World"),
}
#: Stages that have a table of points.
TABLE_STAGES = ("REGULAR_SEASON", "LEAGUE_STAGE", "GROUP_STAGE")
SEASON = ("competition_key", "season_key")


class Star:
    """Builders over the typed frames ``matches``, ``teams`` and ``scorers``."""

    def __init__(self, matches: DataFrame, teams: DataFrame, scorers: DataFrame, key_method: str = "xxhash64", competitions: Mapping[str, tuple[str, str]] = COMPETITIONS, as_of: Column | None = None, recency: str | None = None):
        self.matches, self.teams, self.scorers = matches, teams, scorers
        self.method, self.competitions, self.as_of, self.recency = key_method, competitions, as_of, recency

    def _key(self, column: str) -> Column:
        return surrogate_key(column, self.method)

    def _newest(self, df: DataFrame) -> list[Column]:
        return [F.col(self.recency).desc()] if self.recency in df.columns else []

    def dim_date(self) -> DataFrame:
        return calendar(self.matches.select("match_date"), self.scorers.select("snapshot_date"))

    def dim_competition(self) -> DataFrame:
        names = ["competition_code", "competition_id", "competition_name"]
        # Only what is needed, so that a view of matches need not be worked out whole.
        named = self.matches.where("competition_code is not null").select(*names, *[c for c in [self.recency] if c in self.matches.columns])
        recent = latest_per_key(named, ["competition_code"], self._newest(self.matches)).select(*names)
        known = self.matches.sparkSession.createDataFrame([(c, *v) for c, v in self.competitions.items()], "competition_code string, competition_type string, country string")
        full = enriched(recent, known, ["competition_code"], {"competition_type": "UNKNOWN", "country": "UNKNOWN"})
        keyed = full.select(self._key("competition_code").alias("competition_key"), *names, "competition_type", "country")
        unknown = {"competition_key": UNKNOWN_KEY, "competition_code": "UNKNOWN", "competition_name": "Unknown", "competition_type": "UNKNOWN", "country": "UNKNOWN"}
        return with_unknown(keyed, unknown)

    def dim_season(self) -> DataFrame:
        label = period_label(F.col("season_start_date"), F.col("season_end_date"))
        found = periods(self.matches, "season_start_date", "season_end_date", label, F.current_date() if self.as_of is None else self.as_of)
        keyed = found.select(period_key("label", self.method).alias("season_key"), F.col("label").alias("season_label"), F.col("start_year").alias("season_start_year"), "is_current")
        return with_unknown(keyed, {"season_key": UNKNOWN_KEY, "season_label": "Unknown", "is_current": False})

    def dim_team(self) -> DataFrame:
        described = latest_per_key(self.teams, ["team_id"], [*self._newest(self.teams), F.col("competition_code").asc()])
        known = described.select("team_id", "team_name", "team_short_name", "team_tla", "founded", "club_colors", F.col("venue").alias("home_venue"), F.col("area_name").alias("country"), "coach_name")
        seen = [self.matches.select(*[F.col(f"{side}_{c}").alias(c) for c in ("team_id", "team_name", "team_tla")]) for side in ("home", "away")] + [self.scorers.select("team_id", "team_name")]
        full = with_late_members(known, seen, "team_id", {"team_short_name": "team_name"})
        keyed = full.select(self._key("team_id").alias("team_key"), *full.columns)
        return with_unknown(keyed, {"team_key": UNKNOWN_KEY, "team_name": "Unknown", "team_short_name": "Unknown", "team_tla": "UNK", "is_inferred": False})

    def dim_player(self) -> DataFrame:
        """Names and positions only: birth dates and nationalities stay behind."""
        recent = latest_per_key(self.scorers.where("player_id is not null"), ["player_id"], [F.col("snapshot_date").desc(), *self._newest(self.scorers)])
        keyed = recent.select(self._key("player_id").alias("player_key"), "player_id", "player_name", "player_position")
        return with_unknown(keyed, {"player_key": UNKNOWN_KEY, "player_name": "Unknown"})

    def fact_matches(self) -> DataFrame:
        home, away = F.col("home_goals"), F.col("away_goals")
        counts = decided(F.col("is_finished"), home, away)
        label = period_label(F.col("season_start_date"), F.col("season_end_date"))
        optional = [c for c in ("kickoff_utc", "home_goals_ht", "away_goals_ht", "source_last_updated") if c in self.matches.columns]
        return self.matches.select(
            "match_id", date_key("match_date").alias("date_key"), self._key("competition_code").alias("competition_key"), period_key(label, self.method).alias("season_key"),
            self._key("home_team_id").alias("home_team_key"), self._key("away_team_id").alias("away_team_key"), "matchday", "stage", "group_name", "match_status", "is_finished",
            "home_goals", "away_goals", *optional, F.when(counts, home + away).alias("total_goals"), F.when(counts, home - away).alias("goal_difference"), "result",
            points(counts, home, away).alias("home_points"), points(counts, away, home).alias("away_points"),
        )

    def fact_team_match(self, facts: DataFrame | None = None) -> DataFrame:
        """A row for each side of a match, from ``facts`` if fact_matches is written already."""
        names = ["match_id", "date_key", "competition_key", "season_key", "matchday", "stage", "group_name", "match_status", "is_finished", *[c for c in ["kickoff_utc"] if c in self.matches.columns]]
        base = (self.fact_matches() if facts is None else facts).select(*names, "home_team_key", "away_team_key", "home_goals", "away_goals")
        side = lambda own, other: {"team_key": f"{own}_team_key", "opponent_key": f"{other}_team_key", "goals_for": f"{own}_goals", "goals_against": f"{other}_goals"}
        both = two_sided(base, {"HOME": side("home", "away"), "AWAY": side("away", "home")}, "venue")
        own, other = F.col("goals_for"), F.col("goals_against")
        counts = decided(F.col("is_finished"), own, other)
        return both.withColumns({
            "goal_difference": F.when(counts, own - other), "result": verdict(counts, own, other), "points": points(counts, own, other), "is_clean_sheet": F.when(counts, other == 0),
        })

    def fact_top_scorers(self) -> DataFrame:
        label = period_label(F.col("season_start_date"), F.col("season_end_date"))
        seasons = self.matches.select("competition_code", "season_id", label.alias("season_label")).groupBy("competition_code", "season_id").agg(F.min("season_label").alias("season_label"))
        joined = self.scorers.join(seasons, ["competition_code", "season_id"], "left")
        return joined.select(
            self._key("competition_code").alias("competition_key"), period_key("season_label", self.method).alias("season_key"), date_key("snapshot_date").alias("snapshot_date_key"), "snapshot_date",
            self._key("player_id").alias("player_key"), self._key("team_id").alias("team_key"), "played_matches", "goals", "assists", "penalties",
            (F.col("goals") - F.col("penalties")).alias("non_penalty_goals"), rate(F.col("goals"), F.col("played_matches"), 2).alias("goals_per_match"),
        )


def agg_team_season(fact: DataFrame) -> DataFrame:
    return season_table(fact, "team_key", SEASON)


def agg_home_away(fact: DataFrame) -> DataFrame:
    return venue_table(fact, ["team_key", *SEASON, "venue"])


def agg_matchday_progress(fact: DataFrame) -> DataFrame:
    rows = fact.where(F.col("stage").isin(*TABLE_STAGES))
    return progress_table(rows, "team_key", [*SEASON, "stage", "group_name"], "matchday").withColumnRenamed("position", "league_position")


#: Key, and whether the table is merged by it or made anew.
TABLES: dict[str, tuple[tuple[str, ...], bool]] = {
    "dim_date": (("date_key",), False),
    "dim_competition": (("competition_key",), True),
    "dim_season": (("season_key",), True),
    "dim_team": (("team_key",), True),
    "dim_player": (("player_key",), True),
    "fact_matches": (("match_id",), True),
    "fact_team_match": (("match_id", "venue"), True),
    "fact_top_scorers": (("competition_key", "snapshot_date_key", "player_key"), True),
    "agg_team_season": (("team_key", *SEASON), False),
    "agg_home_away": (("team_key", *SEASON, "venue"), False),
    "agg_matchday_progress": (("team_key", *SEASON, "stage", "group_name", "matchday"), False),
}
#: Natural keys: a dimension is merged by these as well, so that members whose surrogate keys clash stay apart, and the grain check sees them.
NATURAL = {"dim_competition": "competition_code", "dim_season": "season_label", "dim_team": "team_id", "dim_player": "player_id"}
#: (column, dimension, its key) that each table refers by.
REFERENCES: dict[str, list[tuple[str, str, str]]] = {
    "fact_matches": [("date_key", "dim_date", "date_key"), ("competition_key", "dim_competition", "competition_key"), ("season_key", "dim_season", "season_key"), ("home_team_key", "dim_team", "team_key"), ("away_team_key", "dim_team", "team_key")],
    "fact_team_match": [("date_key", "dim_date", "date_key"), ("competition_key", "dim_competition", "competition_key"), ("season_key", "dim_season", "season_key"), ("team_key", "dim_team", "team_key"), ("opponent_key", "dim_team", "team_key")],
    "fact_top_scorers": [("snapshot_date_key", "dim_date", "date_key"), ("competition_key", "dim_competition", "competition_key"), ("season_key", "dim_season", "season_key"), ("player_key", "dim_player", "player_key"), ("team_key", "dim_team", "team_key")],
} | {t: [("competition_key", "dim_competition", "competition_key"), ("season_key", "dim_season", "season_key"), ("team_key", "dim_team", "team_key")] for t in ("agg_team_season", "agg_home_away", "agg_matchday_progress")}


def validation_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All grain and reference checks of the given star tables, a row each."""
    grains = {t: keys for t, (keys, _) in TABLES.items() if t in tables}
    references = {t: [r for r in refs if r[1] in tables] for t, refs in REFERENCES.items() if t in tables}
    return checks_report(tables, grains, references)
