"""Views for those who read results: signals in order, readiness, scopes, phases, keys across sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions.names import identity_key, underscored
from fathomline.operators.rules import inside

#: Actions that are shown, in the order of their priority.
ACTIONS = ["manual_review_if_odds_available", "radar_watch", "card_radar_watch", "low_confidence_review", "longshot_manual_only"]


def scope(market: Column, selection: Column) -> Column:
    """How a priced bet may be used: results but for draws by the core filters, everything else for watching."""
    draw = F.coalesce(F.lower(F.trim(selection)) == "draw", F.lit(False))
    return F.when((market == "h2h") & draw, "excluded_draw").when(market == "h2h", "use_core_filters").otherwise("radar_only")


def with_phase(df: DataFrame, fixtures: DataFrame, home: str, away: str, otherwise: str = "Knockout") -> DataFrame:
    """``phase`` by the two teams in either order. ``fixtures`` (one, two, phase) is a small table, one row a pair."""
    both = fixtures.select(F.col("one").alias(home), F.col("two").alias(away), F.col("phase").alias("_p"), F.lit(0).alias("_turned")).union(fixtures.select("two", "one", "phase", F.lit(1)))
    one = both.groupBy(home, away).agg(F.min_by("_p", "_turned").alias("_p"))
    return df.join(F.broadcast(one), [home, away], "left").withColumn("phase", F.coalesce("_p", F.lit(otherwise))).drop("_p")


def signal_rows(df: DataFrame, tie: list[str], matches: list[int] | None = None, most: int = 600) -> DataFrame:
    """The ``most`` first actionable signals of fair odds from 1.35 to 8: by match, then priority, then whether tracking is allowed, then the chance.

    A top-k, which no task sorts whole. ``matches`` restricts the scope; without it all count.
    """
    rows = df.where(F.col("action").isin(ACTIONS) & inside(F.col("fair_odds"), 1.35, 8.0))
    rows = rows.where(F.col("match").isin(matches)) if matches is not None else rows
    priority = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action")).cast("int")
    shown = rows.withColumn("priority", priority).withColumn("least_odds", F.round(F.col("fair_odds") * 1.10, 3))
    return shown.orderBy("match", "priority", F.col("allowed").desc(), F.col("prob").desc_nulls_last(), *tie).limit(most)


def readiness(df: DataFrame, wanted: Column, odds_rows: DataFrame, tested_rows: DataFrame) -> DataFrame:
    """One row: candidates, quotes and tested bets of a market, and what that makes it ready for; also of empty tables."""
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(wanted, 1)).alias("candidates")).crossJoin(count(odds_rows, "odds_rows")).crossJoin(count(tested_rows, "tested_rows"))  # one row each
    return one.withColumn("decision", F.when((F.col("odds_rows") > 0) & (F.col("tested_rows") > 0), "ready_for_backtest").when(F.col("odds_rows") > 0, "ready_for_paper_tracking").otherwise("waiting_for_odds"))


def ready_flags(df: DataFrame, flags: dict[str, Column], enough: int) -> DataFrame:
    """Every flag as a column (false for null), how many hold, and ``is_ready`` where at least ``enough`` do."""
    out = df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    n = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in flags])
    return out.withColumn("n_ready", n).withColumn("is_ready", n >= enough)


def person_keys(df: DataFrame, team: str, name: str, extra: list[str], tie: str) -> DataFrame:
    """``key``: team and name as one slug; where it isn't the row's own, the ``extra`` columns and the place within the key are added."""
    key = F.concat_ws("_", underscored(identity_key(F.col(team))), underscored(identity_key(F.col(name))))
    keyed = df.withColumn("key", key)
    more = F.concat_ws("_", *[F.when(k != "", k) for k in (underscored(identity_key(F.col(c))) for c in extra)])
    n = F.count(F.lit(1)).over(W.partitionBy("key"))
    at = F.row_number().over(W.partitionBy("key").orderBy(tie))
    numbered = keyed.withColumn("_n", n).withColumn("_at", at).withColumn("_more", more)
    return numbered.withColumn("key", F.when(F.col("_n") > 1, F.concat_ws("_", "key", F.when(F.col("_more") != "", F.col("_more")), F.col("_at").cast("string"))).otherwise(F.col("key"))).drop("_n", "_at", "_more")
