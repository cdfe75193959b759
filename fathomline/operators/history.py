"""Histories of both sides of a game: roles, rest, form, runs, fallbacks, standings, ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: K by the first of these strings, in order, that a tournament's name holds, letter case apart. Fixed values.
K_FACTORS = [
    ("FIFA World Cup", 60.0), ("FIFA World Cup qualification", 40.0), ("UEFA Euro", 60.0), ("UEFA Euro qualification", 40.0), ("Copa América", 60.0),
    ("Africa Cup of Nations", 60.0), ("AFC Asian Cup", 60.0), ("CONCACAF Gold Cup", 60.0), ("Friendly", 20.0), ("Confederations Cup", 50.0), ("Nations League", 40.0),
]


def by_role(games: DataFrame, shared: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Two rows a game, one for each side: the shared columns, is_home, and of each pair (home's column, away's column) the side's own as its name and the other's as ``other_`` name."""
    def side(home: bool) -> DataFrame:
        own = [F.col(p[not home]).alias(n) for n, p in pairs.items()]
        other = [F.col(p[home]).alias(f"other_{n}") for n, p in pairs.items()]
        return games.select(*shared, F.lit(home).alias("is_home"), *own, *other)

    return side(True).unionByName(side(False))


def to_sides(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row a game again, each value as home_ and away_ columns: one aggregate, no join."""
    return rows.groupBy(*key).agg(*[F.max(F.when(F.col("is_home") == home, F.col(v))).alias(f"{side}_{v}") for side, home in (("home", True), ("away", False)) for v in values])


def rest_days(rows: DataFrame, team: str, day: str, seq: str, out: str = "rest_days") -> DataFrame:
    """Days since the team's game before, in either role."""
    return rows.withColumn(out, F.datediff(day, F.lag(day).over(W.partitionBy(team).orderBy(day, seq))))


def form(rows: DataFrame, team: str, day: str, seq: str, result: str, means: dict[str, str], n: int = 10, reach: int = 3) -> DataFrame:
    """Form of the last ``n`` games with a result among the ``reach`` x ``n`` games before the day (strictly).

    ``result`` is the side's own (W, D, L, or null). Adds form_n, form_wins, form_draws,
    form_losses, form_ppg, the means (nulls don't count) and form_streak: the signed run
    of wins or losses up to the last game, which a draw ends. The history is an array of
    at most reach x n entries, read in a frame before the first game of the day, so games
    of one day don't see each other.
    """
    entry = F.struct(F.col(result).alias("r"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(means.values())])
    before = W.partitionBy(team).orderBy(day, seq).rowsBetween(-reach * n, -1)
    first = W.partitionBy(team, day).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("_all", F.collect_list(entry).over(before)).withColumn("_all", F.first("_all").over(first))
    had = seen.withColumn("_h", F.filter("_all", lambda e: e["r"].isNotNull()))
    had = had.withColumn("_h", F.slice("_h", F.greatest(F.lit(1), F.size("_h") - (n - 1)), F.lit(n)))
    count = lambda r: F.size(F.filter("_h", lambda e: e["r"] == r))
    played = F.size("_h")
    share = lambda x: F.when(played > 0, x / played)

    def mean(i: int) -> Column:
        some = F.filter(F.transform("_h", lambda e: e[f"m{i}"]), lambda v: v.isNotNull())
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some))

    run = F.aggregate(
        F.reverse("_h"), F.struct(F.lit(0).alias("n"), F.lit(False).alias("over")),
        lambda s, e: F.when(s["over"], s)
        .when((e["r"] == "W") & (s["n"] >= 0), F.struct((s["n"] + 1).alias("n"), F.lit(False).alias("over")))
        .when((e["r"] == "L") & (s["n"] <= 0), F.struct((s["n"] - 1).alias("n"), F.lit(False).alias("over")))
        .otherwise(F.struct(s["n"].alias("n"), F.lit(True).alias("over"))),
        lambda s: s["n"])
    return had.withColumns({
        "form_n": played, "form_wins": share(count("W")), "form_draws": share(count("D")), "form_losses": share(count("L")),
        "form_ppg": share(3 * count("W") + count("D")), "form_streak": run, **{f"form_{name}": mean(i) for i, name in enumerate(means)}}).drop("_all", "_h")


def line_fallback(totals: DataFrame, team: str, value: str, ratings: DataFrame, rating: str, default: float = 5.0, least_games: int = 3, least_teams: int = 5, low: float = 2.0, high: float = 8.0) -> DataFrame:
    """(team, fallback) of every rated team: a line through the rated teams' means over their rating, cut to the bounds; the mean of all values where too few teams are known.

    ``totals`` has a row for each game and team. The line's points are teams with at
    least ``least_games`` values. ``default`` stands where there is no value at all.
    """
    each = totals.groupBy(team).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    points = each.join(ratings.select(team, rating), team).where(F.col("_c") >= least_games)
    line = points.agg(F.regr_slope(F.col("_s") / F.col("_c"), rating).alias("_slope"), F.regr_intercept(F.col("_s") / F.col("_c"), rating).alias("_cut"), F.count(rating).alias("_n"))
    whole = each.agg(F.coalesce(F.try_divide(F.sum("_s"), F.sum("_c")), F.lit(default)).alias("_all"))
    guess = F.when((F.col("_n") >= least_teams) & F.col(rating).isNotNull(), F.least(F.greatest(F.col("_slope") * F.col(rating) + F.col("_cut"), F.lit(low)), F.lit(high)))
    return ratings.crossJoin(F.broadcast(line)).crossJoin(F.broadcast(whole)).select(team, F.coalesce(guess, "_all").alias("fallback"))  # one row each


def k_factor(tournament: Column, factors: list[tuple[str, float]] = K_FACTORS, default: float = 30.0) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for name, k in factors:
        out = out.when(F.contains(F.lower(tournament), F.lit(name.lower())), F.lit(k))
    return out.otherwise(F.lit(default))


def margin_factor(home: Column, away: Column) -> Column:
    """1 up to a margin of one goal, 1.5 for two, (11 + margin) / 8 beyond."""
    d = F.abs(home - away)
    return F.when(d <= 1, 1.0).when(d == 2, 1.5).otherwise((11 + d) / 8.0)


def weighted_run(rows: DataFrame, team: str, other: str, day: str, seq: str, points: str, strength: DataFrame, bar: float, n: int = 10, enough: int = 5) -> DataFrame:
    """(team, run, games): points of the last ``n`` games as a share of the most possible, each weighted by the rival's strength.

    Only rivals of strength ``bar`` or more count, unless a team met fewer than
    ``enough`` of them: then all do. Unknown rivals have strength 0 for the bar and half
    a weight. A team whose weights sum to 0 gets 0.5. ``strength`` (team, strength) is a
    small table, one row a team.
    """
    s = strength.select(F.col(team).alias(other), F.col("strength").alias("_f"))
    met = rows.join(F.broadcast(s), other, "left").withColumn("_strong", F.coalesce(F.col("_f"), F.lit(0.0)) >= bar)
    some = met.withColumn("_k", F.count(F.when(F.col("_strong"), 1)).over(W.partitionBy(team))).where((F.col("_k") < enough) | F.col("_strong"))
    last = some.withColumn("_r", F.row_number().over(W.partitionBy(team).orderBy(F.col(day).desc(), F.col(seq).desc()))).where(F.col("_r") <= n)
    w = F.coalesce(F.col("_f"), F.lit(0.5))
    return last.groupBy(team).agg(
        F.coalesce(F.try_divide(F.sum(F.col(points) * w), 3.0 * F.sum(w)), F.lit(0.5)).alias("run"), F.count(F.lit(1)).alias("games"))


def standings(rows: DataFrame, group: str, team: str) -> DataFrame:
    """Points, goal difference, goals and place of each team in its group, from two rows a game (goals, other_goals); equal ones by name."""
    g, o = F.col("goals"), F.col("other_goals")
    table = rows.where(g.isNotNull() & o.isNotNull()).groupBy(group, team).agg(
        F.sum(F.when(g > o, 3).when(g == o, 1).otherwise(0)).alias("points"), F.sum(g - o).alias("difference"), F.sum(g).alias("goals"))
    w = W.partitionBy(group).orderBy(F.desc("points"), F.desc("difference"), F.desc("goals"), team)
    return table.withColumn("place", F.row_number().over(w))


def strengths(rows: DataFrame, team: str, scored: str, conceded: str) -> DataFrame:
    """(team, attack, defence, overall): means over both roles, and the mean of all."""
    each = rows.groupBy(team).agg(F.avg(scored).alias("attack"), F.avg(conceded).alias("defence"))
    return each.crossJoin(F.broadcast(rows.agg(F.avg(scored).alias("overall"))))  # one row


def composite(df: DataFrame, parts: dict[str, tuple[Column, float]], out: str = "rating") -> DataFrame:
    """The parts, each scaled to 0..1 over all rows (0.5 where constant), weighted, and their sum scaled to 0..100.

    A null takes its part's mean. Extremes come from one-row aggregates, so nothing is ordered or gathered.
    """
    wide = df.withColumns({f"_{n}": c for n, (c, _) in parts.items()})
    ends = wide.agg(*[f(f"_{n}").alias(f"_{k}_{n}") for n in parts for k, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))])
    both = wide.crossJoin(F.broadcast(ends))  # one row
    scaled = {f"{n}_norm": F.when(F.col(f"_hi_{n}") > F.col(f"_lo_{n}"), (F.coalesce(f"_{n}", f"_mean_{n}") - F.col(f"_lo_{n}")) / (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).otherwise(0.5) for n in parts}
    raw = both.withColumns(scaled).withColumn("_raw", reduce(lambda a, b: a + b, [w * F.col(f"{n}_norm") for n, (_, w) in parts.items()]))
    whole = raw.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    done = raw.crossJoin(F.broadcast(whole)).withColumn(out, F.bround(100 * F.when(F.col("_hi") > F.col("_lo"), (F.col("_raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5), 2))
    return done.select(*df.columns, *scaled, out)


def context(df: DataFrame, home: str, away: str, neutral: str, host: Column, groups: DataFrame | None = None) -> DataFrame:
    """is_neutral (null counts as not), host_advantage (1 at home; 0.5 or -0.5 where the first or second side hosts on neutral ground; else 0) and same_group.

    ``host`` is the hosting team's name or null; ``groups`` (team, grp) a small table, one row a team, unknown ones "OTHER".
    """
    out = df.withColumn("is_neutral", F.coalesce(neutral, F.lit(False)))
    out = out.withColumn("host_advantage", F.when(~F.col("is_neutral"), 1.0).when(F.coalesce(host == F.col(home), F.lit(False)), 0.5).when(F.coalesce(host == F.col(away), F.lit(False)), -0.5).otherwise(0.0))
    if groups is not None:
        for side, c in (("home", home), ("away", away)):
            out = out.join(F.broadcast(groups.select(F.col("team").alias(c), F.col("grp").alias(f"_{side}_grp"))), c, "left")
        a, b = F.coalesce("_home_grp", F.lit("OTHER")), F.coalesce("_away_grp", F.lit("OTHER"))
        out = out.withColumn("same_group", a == b).drop("_home_grp", "_away_grp")
    return out


def targets(home: Column, away: Column) -> dict[str, Column]:
    """Result (H, D, A), more than 2.5 goals, both scored, all goals; null without scores."""
    goals = home + away
    return {"result": F.when(home > away, "H").when(home < away, "A").when(home == away, "D"), "over25": goals > 2.5, "both_scored": (home > 0) & (away > 0), "goals": goals}
