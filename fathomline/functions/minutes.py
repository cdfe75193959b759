"""Players' minutes, roles, cards and props."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions.scalars import clip, ladder, log_score, poisson_over

# Minutes of starters and of players from the bench; the chance to start by rank within a position.
STARTER = {"Goalkeeper": 90, "Defender": 82, "Midfielder": 76, "Forward": 72}
BENCH = {"Goalkeeper": 0, "Defender": 12, "Midfielder": 22, "Forward": 25}
START = {
    "Goalkeeper": [(1, 0.78), (2, 0.16), (None, 0.04)], "Defender": [(4, 0.68), (7, 0.34), (None, 0.12)],
    "Midfielder": [(4, 0.66), (8, 0.34), (None, 0.14)], "Forward": [(3, 0.64), (7, 0.34), (None, 0.13)],
}
TIER_SHIFT = {"A": 0.08, "B": 0.04, "C": -0.04, "D": -0.10}
MEAN_CARDS = 4.27
STATUS = [(0.75, "locked_starter"), (0.52, "probable_starter"), (0.20, "rotation")]
STATUS_PROBABILITY = {"confirmed_starter": 1.0, "locked_starter": 0.9, "confirmed_bench": 0.0, "suspended": 0.0, "out": 0.0, "not_in_squad": 0.0}


def position(text: Column) -> Column:
    """Goalkeeper, Defender, Midfielder, Forward or Unknown, from a word in the text or from a short form."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.contains(t, F.lit("goalkeeper")) | (t == "gk"), "Goalkeeper").when(F.contains(t, F.lit("defender")) | t.isin("df", "cb", "lb", "rb"), "Defender").when(
        F.contains(t, F.lit("midfielder")) | t.isin("mf", "cm", "dm", "am"), "Midfielder").when(F.contains(t, F.lit("forward")) | t.isin("fw", "st", "winger"), "Forward").otherwise("Unknown")


def _by(position: Column, values: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(*[F.when(position == p, F.lit(float(v))) for p, v in values.items()], F.lit(float(otherwise)))


def role_score(season_minutes: Column, recent_minutes: Column, market_value: Column, caps: Column) -> Column:
    part = lambda x, most: F.coalesce(clip(x / most, 0.0, 1.0), F.lit(0.0))
    return F.bround(0.45 * part(season_minutes, 3000.0) + 0.25 * part(recent_minutes, 3000.0) + 0.20 * log_score(market_value, 100_000_000) + 0.10 * part(caps, 80.0), 4)


def role_ranks(df: DataFrame, by: list[str], score: Column, tie: str) -> DataFrame:
    """``rank`` from 1 within ``by``, the highest score first, of equal ones the smaller ``tie``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(score.desc(), tie)))


def start_probability(position: Column, rank: Column, tier: Column | None = None, role: Column | None = None) -> Column:
    """The chance to start by position and rank; with a tier and a role score moved by both and cut to 0.01 and 0.95."""
    base = F.lit(0.20)
    for p, steps in START.items():
        inner = F.lit(steps[-1][1])
        for bound, value in reversed(steps[:-1]):
            inner = F.when(rank <= bound, value).otherwise(inner)
        base = F.when(position == p, inner).otherwise(base)
    if tier is None:
        return base
    moved = base + _by(tier, TIER_SHIFT, -0.10) + 0.08 * F.coalesce(role, F.lit(0.0))
    return F.bround(clip(moved, 0.01, 0.95), 3)


def lineup_status(prob: Column) -> Column:
    return ladder(prob, STATUS, "bench_option")


def expected_minutes(position: Column, prob: Column) -> Column:
    return prob * _by(position, STARTER, 70) + (1 - prob) * _by(position, BENCH, 18)


def overlaid(df: DataFrame, manual: DataFrame, key: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Manual values over the automatic ones, column by column; of repeated manual rows the last by ``seq`` counts. A manual status alone gives its own chance to start."""
    last = manual.groupBy(*key).agg(F.max_by(F.struct("lineup_status", *columns), seq).alias("_m"))
    both = df.join(last, key, "left")
    known = F.coalesce(*[F.when(F.col("_m.lineup_status") == s, F.lit(p)) for s, p in STATUS_PROBABILITY.items()])
    out = both.withColumns({c: F.coalesce(F.col(f"_m.{c}"), *([known] if c == "start_probability" else []), F.col(c)) for c in columns})
    return out.withColumn("is_manual", F.col("_m").isNotNull()).drop("_m")


def card_rate(home_per90: Column, away_per90: Column, referee: Column, minutes: float = 95.0) -> Column:
    """Cards to be expected: the teams' rate times the referee's share of the mean; what is unknown is left out, without either the mean."""
    teams = (home_per90 + away_per90) / 90.0 * minutes
    return F.coalesce(teams * (referee / MEAN_CARDS), teams, referee, F.lit(MEAN_CARDS))


def prop_probability(rate: Column, line: float, market: Column, caps: dict[str, float], prior: Column, weight: float = 0.35) -> Column:
    """The chance of more than ``line``: drawn to ``prior`` where there is one (weight of the model: ``weight``), else no more than the market's cap."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(rate > 0, poisson_over(rate, line)).otherwise(0.0)))
    cap = F.coalesce(*[F.when(market == m, F.lit(c)) for m, c in caps.items()], F.lit(1.0))
    return F.coalesce(weight * raw + (1 - weight) * prior, F.least(raw, cap))


def prop_action(prob: Column, tier: Column, market: Column, odds: Column) -> Column:
    good, fair = tier.isin("A", "B"), tier == "C"
    on_target = F.when(good & (prob >= 0.18), "radar_watch").when(fair & (prob >= 0.22), "low_confidence_review").otherwise("no_action")
    return F.when(odds < 1.45, "price_too_short_watch_only").when(odds > 8.0, "longshot_manual_only").when(market == "shots_on_target", on_target).when(
        good & (prob >= 0.22), "manual_review_if_odds_available").when(good & (prob >= 0.14), "radar_watch").when(fair & (prob >= 0.22), "low_confidence_review").when(
        (market == "yellow_card") & (prob >= 0.16) & tier.isin("A", "B", "C"), "card_radar_watch").otherwise("no_action")
