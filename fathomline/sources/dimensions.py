"""Hand-kept tables of grounds, camps, referees, fixtures and ratings, brought to the library's columns.

Each function takes a table whose columns may go by other names, and gives those of one
dimension: ids of the source, trimmed names, nulls where the table has no such column.
Rows without what identifies them are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.names import aliased
from fathomline.functions.scalars import lenient_bool, rate_or_value
from fathomline.sources.feeds import source_id

#: Roofs under which a ground counts as indoor; fixed values.
CLOSED_ROOFS = ("fixed", "retractable", "closed")


def _text(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def _numbers(names: list[str]) -> list[Column]:
    return [F.expr(f"try_cast(`{n}` AS double)").alias(n) for n in names]


def venues(df: DataFrame, source: str = "manual") -> DataFrame:
    """Grounds; where ``indoor`` isn't said, the roof tells."""
    named = aliased(df, {"venue_id": [], "venue_name": ["stadium_name"], "city": [], "country": [], "latitude": ["lat"], "longitude": ["lon"], "altitude_m": [], "indoor": [], "roof_type": [], "surface": [], "timezone": []})
    roof = F.coalesce(F.lower(_text("roof_type")).isin(*CLOSED_ROOFS), F.lit(False))
    return named.select(
        source_id(source, "venue", _text("venue_id"), _text("venue_name")).alias("venue_id"), _text("venue_name").alias("venue_name"), "city", "country", *_numbers(["latitude", "longitude", "altitude_m"]),
        F.when(F.col("indoor").isNull(), roof).otherwise(lenient_bool(F.col("indoor"))).alias("indoor"), "roof_type", "surface", "timezone")


def base_camps(df: DataFrame, source: str = "manual", tournament: str = "") -> DataFrame:
    """Where teams stay; one row a team and tournament is meant, and the tournament of rows that don't say it is ``tournament``."""
    named = aliased(df, {"team_id": [], "team_name": ["team"], "city": [], "country": [], "accommodation": ["hotel"], "training_site": [], "latitude": ["lat"], "longitude": ["lon"], "altitude_m": [], "timezone": [], "tournament": []})
    return named.where(_text("team_name") != "").select(
        source_id(source, "team", _text("team_id"), _text("team_name")).alias("team_id"), _text("team_name").alias("team_name"), F.coalesce("tournament", F.lit(tournament)).alias("tournament"), "city", "country", "accommodation", "training_site",
        *_numbers(["latitude", "longitude", "altitude_m"]), "timezone")


def referees(df: DataFrame, source: str = "manual", tournament: str = "All") -> DataFrame:
    """Referees with their rates: given ones, else counts by matches."""
    counts = ["matches", "yellow_cards", "red_cards", "penalties_awarded", "yellow_per_match", "red_per_match", "fouls_per_match", "penalties_per_match"]
    other = {"matches": ["matches_officiated"], "penalties_awarded": ["penalties"]}
    named = aliased(df, {"referee_id": [], "referee_name": ["name"], "nationality": ["country"], "confederation": [], "tournament": ["competition"]} | {c: other.get(c, []) for c in counts})
    rows = named.where(_text("referee_name") != "").select(
        source_id(source, "referee", _text("referee_id"), _text("referee_name")).alias("referee_id"), _text("referee_name").alias("referee_name"), "nationality", "confederation", F.coalesce("tournament", F.lit(tournament)).alias("tournament"), *_numbers(counts))
    n = F.col("matches")
    return rows.withColumns({f"{k}_per_match": rate_or_value(F.col(f"{k}_per_match"), F.col(c), n) for k, c in (("yellow", "yellow_cards"), ("red", "red_cards"), ("penalties", "penalties_awarded"))})


#: What a fixture may say about the game besides who plays where.
_FIXTURE_NUMBERS = ["home_score", "away_score", "home_rest_days", "away_rest_days", "home_travel_km", "away_travel_km", "temperature_c", "humidity_pct"]


def fixtures(df: DataFrame, source: str = "manual", competition: str = "", season: str = "", knockout: bool = False) -> DataFrame:
    """Fixtures of a group stage, or of a knockout stage, whose sides are slots and which has no groups. Null neutral grounds count as neutral."""
    home, away = ("home_slot", "away_slot") if knockout else ("home_team", "away_team")
    wanted = ["match_number", home, away, "competition", "season", "stage", "group", "match_date", "kickoff_local", "venue_id", "referee_id", "neutral", "home_team_id", "away_team_id", *_FIXTURE_NUMBERS]
    named = aliased(df, {c: [] for c in wanted})
    side = lambda name, own: source_id(source, "slot", _text(name)) if knockout else source_id(source, "team", _text(own), _text(name))
    rows = named.where(F.col("match_number").isNotNull() & (_text(home) != "") & (_text(away) != ""))
    return rows.select(
        source_id(source, "match", _text("match_number")).alias("match_id"), F.coalesce("competition", F.lit(competition)).alias("competition"), F.coalesce(F.col("season").cast("string"), F.lit(season)).alias("season"),
        (F.col("stage") if knockout else F.coalesce("stage", F.lit("Group Stage"))).alias("stage"), (F.lit(None).cast("string") if knockout else F.col("group").cast("string")).alias("group"), F.to_date(F.col("match_date")).alias("match_date"), F.col("kickoff_local").cast("string").alias("kickoff_local"),
        side(home, "home_team_id").alias("home_team_id"), side(away, "away_team_id").alias("away_team_id"), F.when(_text("venue_id") != "", source_id(source, "venue", _text("venue_id"))).alias("venue_id"), F.col("referee_id").cast("string").alias("referee_id"),
        F.when(F.col("neutral").isNull(), True).otherwise(lenient_bool(F.col("neutral"))).alias("neutral"), *_numbers(_FIXTURE_NUMBERS))


def team_ratings(df: DataFrame, source: str, ids: str = "manual") -> DataFrame:
    """Ratings by team and day; the team's id is of the source ``ids``, so that it meets the fixtures' one."""
    named = aliased(df, {"team_id": [], "team_name": ["team"], "rating_date": ["date"], "elo_rating": ["rating"], "rank": [], "one_year_change": ["1_year_change"], "confederation": []})
    return named.where((_text("team_name") != "") & F.col("rating_date").isNotNull()).select(
        source_id(ids, "team", _text("team_id"), _text("team_name")).alias("team_id"), _text("team_name").alias("team_name"), F.to_date("rating_date").alias("rating_date"), F.lit(source).alias("source"), *_numbers(["elo_rating", "rank", "one_year_change"]), "confederation")
