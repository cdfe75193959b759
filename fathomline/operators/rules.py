"""Rules over bets and signals: tagging filters, strategy filters, temporal splits, short lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.scalars import ordinal
from fathomline.operators.windows import best_per_key

LEVELS = ["VERY LOW", "LOW", "MEDIUM", "HIGH", "VERY HIGH"]
CONFIDENCE = ["low", "medium", "high"]


def inside(x: Column, low: float, high: float) -> Column:
    """Both ends included; false for null."""
    return F.coalesce(x.between(low, high), F.lit(False))


def close_to(x: Column, value: float, within: float = 1e-6) -> Column:
    return F.coalesce(F.abs(x - value) <= within, F.lit(False))


def tag_values(df: DataFrame, allowed: Column, ev: str, low: float = 10.0, high: float = 40.0) -> DataFrame:
    """``market_ok``, ``ev_ok``, ``bet_allowed`` and the first reason against; drops no row."""
    market, value = F.coalesce(allowed, F.lit(False)), inside(F.col(ev), low, high)
    return df.withColumns({
        "market_ok": market, "ev_ok": value, "bet_allowed": market & value,
        "reason": F.when(~market, "excluded_market_or_draw").when(~value, "ev_outside_range").otherwise("allowed")})


@dataclass(frozen=True)
class Strategy:
    low_ev: float = 10.0
    high_ev: float = 40.0
    low_odds: float = 1.5
    high_odds: float = 2.5


def apply_strategy(df: DataFrame, allowed: Column, s: Strategy, ev: str = "ev_pct", odds: str = "odds", profit: str = "profit") -> DataFrame:
    """Tags by market, then value, then odds; rows without a value, odds or profit are left out, bets not allowed count no profit."""
    rows = df.where(F.col(ev).isNotNull() & F.col(odds).isNotNull() & F.col(profit).isNotNull())
    market, value, price = F.coalesce(allowed, F.lit(False)), inside(F.col(ev), s.low_ev, s.high_ev), inside(F.col(odds), s.low_odds, s.high_odds)
    return rows.withColumns({
        "market_ok": market, "ev_ok": value, "odds_ok": price, "bet_allowed": market & value & price,
        "reason": F.when(~market, "excluded_market").when(~value, "ev_outside_range").when(~price, "odds_outside_range").otherwise("allowed"),
        "profit_strategy": F.when(market & value & price, F.col(profit)).otherwise(0.0)})


def paper_filter(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``paper_allowed`` where all checks hold, and the names of those that don't, joined by plus signs ("paper_track" for none); a null check fails."""
    held = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    why = F.concat_ws("+", *[F.when(~c, F.lit(n)) for n, c in held.items()])
    every = F.lit(True)
    for c in held.values():
        every = every & c
    return df.withColumn("paper_allowed", every).withColumn("paper_reason", F.when(why == "", "paper_track").otherwise(why))


def temporal_split(df: DataFrame, day: str, cut: int, end: int) -> DataFrame:
    """``part``: train before the year ``cut``, val from it to before ``end``, later after; null without a day."""
    y = F.year(day)
    return df.withColumn("part", F.when(y < cut, "train").when(y < end, "val").when(y >= end, "later"))


def latest_year_split(df: DataFrame, day: str, target: str) -> DataFrame:
    """``part``: val in the latest year that has a target, train before it; rows without a target are left out."""
    kept = df.where(F.col(target).isNotNull() & F.col(day).isNotNull())
    last = kept.agg(F.max(F.year(day)).alias("_last"))  # one row
    return kept.crossJoin(F.broadcast(last)).withColumn("part", F.when(F.year(day) == F.col("_last"), "val").otherwise("train")).drop("_last")


def placeholder(columns: list[str]) -> Column:
    """Whether all of the columns are null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNull()
    return out


def name_faults(name: Column, longest: int = 28) -> Column:
    """What is wrong with a name, joined by bars: letters run together, a word twice in a row, too long."""
    return F.concat_ws("|", F.when(name.rlike("[a-z][A-Z]"), "run_together"), F.when(name.rlike(r"\b(\w+)\s+\1\b"), "repeated"), F.when(F.length(name) > longest, "long"))


def wanted_markets(said: str, known: list[str]) -> list[str]:
    """The markets a comma-separated list names, or all of them for "all"; raises on an unknown one."""
    names = [m.strip() for m in said.split(",") if m.strip()]
    if names == ["all"]:
        return known
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown markets: {unknown}")
    return names


def short_list(df: DataFrame, by: list[str], level: str, pct: str, ev: str, odds: str, tie: list[str], low: float = 1.5, high: float = 2.5, least: str = "MEDIUM") -> DataFrame:
    """Allowed bets of enough reliability and odds within bounds; of one match the most reliable, then the most valuable."""
    good = df.where(F.col("bet_allowed") & (ordinal(F.col(level), LEVELS) >= LEVELS.index(least)) & inside(F.col(odds), low, high))
    return best_per_key(good, by, [F.col(pct).desc_nulls_last(), F.col(ev).desc_nulls_last(), *tie])


def review_list(df: DataFrame, listed: DataFrame, key: list[str], by: list[str], level: str, pct: str, ev: str, odds: str, tie: list[str], low: float = 1.5, high: float = 2.5, least: str = "MEDIUM") -> DataFrame:
    """Allowed bets that the short list left out, with why, and whether someone should look (odds above ``high`` and up to 4); one a match."""
    reliable = ordinal(F.col(level), LEVELS) >= LEVELS.index(least)
    priced = inside(F.col(odds), low, high)
    why = F.concat_ws("+", F.when(~priced, F.when(F.col(odds) > high, "high_odds").otherwise("low_odds")), F.when(~reliable, "low_reliability"))
    rest = df.where("bet_allowed").join(listed.select(*key), key, "left_anti")
    said = rest.withColumn("review_reason", F.when(why == "", "manual_review").otherwise(why)).withColumn(
        "review_action", F.when(reliable & (F.col(odds) <= 4.0) & (F.col(odds) > high), "manual_check").otherwise("paper_only"))
    return best_per_key(said, by, [F.col(pct).desc_nulls_last(), F.col(ev).desc_nulls_last(), *tie])
