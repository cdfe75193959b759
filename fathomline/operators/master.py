"""Players, teams and what links them to other sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.names import identity_key, underscored
from fathomline.operators.views import person_keys


def teams_of(squads: DataFrame) -> DataFrame:
    """(team_id, team, players): every team of ``squads`` (team, name, club, position)."""
    return squads.groupBy("team").agg(F.count(F.lit(1)).alias("players")).select(underscored(identity_key(F.col("team"))).alias("team_id"), "team", "players")


def players_master(squads: DataFrame, tie: str) -> DataFrame:
    """One row a player: a readable key of team and name, which club, position and place tell apart where it isn't one player's alone, and the normalised names."""
    keyed = person_keys(squads, "team", "name", ["club", "position"], tie)
    return keyed.select(
        F.col("key").alias("player_key"), underscored(identity_key(F.col("team"))).alias("team_id"), "team", "name", identity_key(F.col("name")).alias("name_normalized"), "club", identity_key(F.col("club")).alias("club_normalized"), "position")


def source_bridge(master: DataFrame, matches: dict[str, DataFrame], review: float = 0.92) -> DataFrame:
    """(player_key, source, source_id, confidence, method, needs_review): each player in each source.

    ``matches`` has the result of ``best_match`` for each source, with player_key as the
    left id and source_id as the right one. Unmatched players are there too, with
    confidence 0; whatever lies below ``review`` is for a person to look at.
    """
    whole = None
    for source, found in matches.items():
        one = master.select("player_key").join(found.select("player_key", F.col("source_id").cast("string").alias("source_id"), "score", "method"), "player_key", "left")
        score = F.coalesce("score", F.lit(0.0))
        rows = one.select("player_key", F.lit(source).alias("source"), "source_id", score.alias("confidence"), F.coalesce("method", F.lit("unmatched")).alias("method"), (score < review).alias("needs_review"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def master_report(master: DataFrame, players: int = 26) -> DataFrame:
    """One row: players, teams, keys that repeat or are empty, names without letters, and teams that don't have ``players``."""
    keys = master.groupBy("player_key").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1).otherwise(0)).alias("duplicate_keys"))
    sizes = master.groupBy("team").agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("teams"), F.count(F.when(F.col("_n") != players, 1)).alias("odd_teams"))
    rows = master.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("player_key") == "", 1)).alias("empty_keys"), F.count(F.when(F.col("name_normalized") == "", 1)).alias("empty_names"))
    return rows.crossJoin(keys).crossJoin(sizes)  # one row each
