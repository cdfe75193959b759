"""The tables the library works with: columns, types and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "matches": "match_id string, date timestamp_ntz, home_team string, away_team string, home_score double, away_score double, tournament string, neutral boolean",
    "teams": "team_id string, team_name string, confederation string",
    "team_ratings": "team_id string, rating_date timestamp_ntz, rating double, rank double, source string",
    "players": "player_id string, player_name string, team_id string, club string, position string, birth_date timestamp_ntz, height_cm double, market_value_eur double",
    "lineups": "match_id string, team_id string, player_id string, is_starter boolean, position string, shirt_number double, minute_on double, minute_off double, minutes_played double",
    "player_match_stats": "match_id string, team_id string, player_id string, minutes_played double, goals double, assists double, shots double, shots_on_target double, xg double, key_passes double, corners_taken double, fouls_committed double, fouls_won double, yellow_cards double, red_cards double",
    "venues": "venue_id string, stadium_name string, city string, country string, lat double, lon double, altitude_m double, timezone string",
    "weather_hourly": "venue_id string, datetime timestamp, temperature_2m double, relative_humidity_2m double, apparent_temperature double, precipitation double, wind_speed_10m double",
    "base_camps": "team_id string, tournament string, city string, country string, lat double, lon double, altitude_m double",
    "referees": "referee_id string, referee_name string, tournament string, matches double, yellow_per_match double, red_per_match double",
    "odds": "odds_id string, match_id string, bookmaker string, is_sharp boolean, market string, selection string, line double, odds double, implied double, quote_time timestamp, is_opening boolean, is_closing boolean",
}
KEYS = {
    "matches": ["match_id"], "teams": ["team_id"], "team_ratings": ["team_id", "rating_date", "source"], "players": ["player_id"],
    "lineups": ["match_id", "team_id", "player_id"], "player_match_stats": ["match_id", "team_id", "player_id"], "venues": ["venue_id"],
    "weather_hourly": ["venue_id", "datetime"], "base_camps": ["team_id", "tournament"], "referees": ["referee_id", "tournament"], "odds": ["odds_id"],
}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def catalogue(spark: SparkSession) -> DataFrame:
    """(table, column, type, is_key): a row for each column of each table."""
    return spark.createDataFrame(
        [(t, f.name, f.dataType.simpleString(), f.name in KEYS[t]) for t in SCHEMAS for f in schema_of(t)], "table string, column string, type string, is_key boolean")


def checked(df: DataFrame, name: str) -> list[str]:
    """The columns of the table that ``df`` lacks."""
    return [f.name for f in schema_of(name) if f.name not in df.columns]


def faults(df: DataFrame, name: str) -> DataFrame:
    """(column, fault, wanted, found): columns that are missing, too many or of another type than the table's, and key columns that hold nulls or don't tell rows apart.

    Types are read from the plan; keys are counted, by one aggregate over the groups.
    """
    wanted = {f.name: f.dataType.simpleString() for f in schema_of(name)}
    own = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, "missing", t, None) for c, t in wanted.items() if c not in own] + [(c, "extra", None, t) for c, t in own.items() if c not in wanted]
    rows += [(c, "type", t, own[c]) for c, t in wanted.items() if c in own and own[c] != t]
    found = df.sparkSession.createDataFrame(rows, "column string, fault string, wanted string, found string")
    keys = [c for c in KEYS[name] if c in own]
    if len(keys) < len(KEYS[name]):
        return found
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.agg(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_again"), *[F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)).alias(c) for c in keys])
    said = [F.struct(F.lit(c).alias("column"), F.lit("null key").alias("fault"), F.lit("0").alias("wanted"), F.col(c).cast("string").alias("found")) for c in keys]
    said.append(F.struct(F.lit(",".join(keys)).alias("column"), F.lit("repeated key").alias("fault"), F.lit("0").alias("wanted"), F.col("_again").cast("string").alias("found")))
    return found.unionByName(sums.select(F.inline(F.array(*said))).where("found > 0"))
