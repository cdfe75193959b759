"""Reports: strategy summaries, validation, availability, tracker counts, betting results, signals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.aggregates import normal_interval, wilson
from fathomline.operators.joins import join_null_safe


def _falls_of_parts(batches):
    """For rows (variant, market, profit) in order: each variant's and each of its markets' sum, highest, lowest and deepest fall below the highest, from 0."""
    state, types = {}, None
    for batch in batches:
        types = [batch.schema.field(0).type, batch.schema.field(1).type]
        code, names = [], []
        for c in batch.columns[:2]:
            kinds = c.dictionary_encode()
            code.append(kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64))
            names.append([*kinds.dictionary.to_pylist(), None])
        profit = batch.column(2).to_numpy(zero_copy_only=False)
        both = code[0] * len(names[1]) + code[1]
        for overall, codes in ((True, code[0]), (False, both)):
            for k in np.unique(codes).tolist():
                run = np.cumsum(profit[codes == k])
                key = (overall, names[0][k], None) if overall else (overall, names[0][k // len(names[1])], names[1][k % len(names[1])])
                total, high, low, fall = state.get(key, (0.0, 0.0, np.inf, np.inf))
                least = float(run.min())
                deepest = float((run - np.maximum(np.maximum.accumulate(run), 0.0)).min())
                state[key] = (total + float(run[-1]), max(high, total + float(run.max())), min(low, total + least), min(fall, deepest, total + least - high))
    if state:
        part = TaskContext.get().partitionId()
        columns = list(zip(*[(part, *key, *found) for key, found in state.items()], strict=True))
        kinds = [pa.int32(), pa.bool_(), *types, *[pa.float64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "overall", "variant", "market", "total", "high", "low", "fall"])


def deepest_falls(placed: DataFrame, variant: str, market: str, profit: str, order: list[str]) -> DataFrame:
    """(overall, variant, market, fall): how far the running sum of ``profit``, in ``order``, falls below its highest (0 at first) at most, of each variant and of each of its markets.

    Rows are dealt by ranges of variant and order. A part's sum, highest, lowest and
    deepest fall are all that later parts need, so no variant is one task's work.
    """
    kind = lambda c: placed.schema[c].dataType.simpleString()
    keys = [F.col(variant).alias("_variant"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]]
    names = ["_variant", *[f"_o{i}" for i in range(len(order))]]
    rows = placed.select(*keys, F.col(market).alias("_market"), F.col(profit).cast("double").alias("_profit")).repartitionByRange(*names).sortWithinPartitions(*names)
    parts = rows.select("_variant", "_market", "_profit").mapInArrow(_falls_of_parts, f"part int, overall boolean, variant {kind(variant)}, market {kind(market)}, total double, high double, low double, fall double")
    every = parts.groupBy("overall", "variant", "market").agg(F.array_sort(F.collect_list(F.struct("part", "total", "high", "low", "fall"))).alias("parts"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("high"), F.lit(float("inf")).alias("fall"))
    joined = F.aggregate("parts", start, lambda a, x: F.struct(
        (a.total + x.total).alias("total"), F.greatest(a.high, a.total + x.high).alias("high"), F.least(a.fall, x.fall, a.total + x.low - a.high).alias("fall")))
    return every.select("overall", F.col("variant").alias(variant), F.col("market").alias(market), joined["fall"].alias("fall"))


def strategy_summary(df: DataFrame, variant: str, market: str, match: str, odds: str, ev: str, won: str, order: list[str]) -> DataFrame:
    """One row for each variant ("overall") and each of its markets with a bet: bets, wins, hit rate, profit, intervals, drawdown, odds, value, matches.

    ``df`` is tagged by ``apply_strategy``. Overall rows come even where no bet was
    allowed. Equity runs in ``order``, over all of a variant and over each market; its
    falls are put together from ranges of it. Percentages are rounded half to even.
    """
    placed = df.where("bet_allowed")
    falls = deepest_falls(placed, variant, market, "profit_strategy", order)
    falls = falls.select(variant, F.when(F.col("overall"), "overall").otherwise(F.col(market)).alias("segment"), F.col("fall").alias("_d"))
    n, wins = F.count(F.lit(1)), F.count(F.when(F.col(won), 1))
    profit, mean, std = F.sum("profit_strategy"), F.avg("profit_strategy"), F.stddev_samp("profit_strategy")
    sets = placed.groupingSets([[variant], [variant, market]], variant, market).agg(
        n.alias("bets"), wins.alias("wins"), profit.alias("_p"), mean.alias("_m"), std.alias("_s"),
        F.avg(odds).alias("_ao"), F.min(odds).alias("_no"), F.max(odds).alias("_xo"), F.avg(ev).alias("_ev"), F.countDistinct(match).alias("matches"), F.grouping(market).alias("_g"))
    segment = F.when(F.col("_g") == 1, "overall").otherwise(F.col(market))
    every = df.groupingSets([[variant], [variant, market]], variant, market).agg(F.count(F.lit(1)).alias("candidates"), F.grouping(market).alias("_g"))
    every = every.select(variant, segment.alias("segment"), "candidates")
    found = sets.withColumn("segment", segment)
    both = every.join(found.drop(market, "_g"), [variant, "segment"], "left").join(falls, [variant, "segment"], "left").where(F.col("bets").isNotNull() | (F.col("segment") == "overall"))
    low, high = wilson(F.col("wins"), F.col("bets"))
    r_low, r_high = normal_interval(F.col("_m"), F.col("_s"), F.col("bets"))
    r = lambda c, d: F.coalesce(F.bround(c, d), F.lit(0.0))
    drawdown = F.least("_d", F.lit(0.0))
    return both.select(
        variant, "segment", "candidates", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bets", "wins")], r(100 * F.try_divide("wins", "bets"), 2).alias("hit_rate_pct"),
        r(100 * F.greatest(low, F.lit(0.0)), 2).alias("hit_low_pct"), r(100 * F.least(high, F.lit(1.0)), 2).alias("hit_high_pct"), r(F.col("_p"), 3).alias("profit_units"),
        r(100 * F.try_divide("_p", "bets"), 2).alias("roi_pct"), r(100 * r_low, 2).alias("roi_low_pct"), r(100 * r_high, 2).alias("roi_high_pct"),
        r(drawdown, 3).alias("max_drawdown"), r(F.col("_ao"), 3).alias("avg_odds"), r(F.col("_no"), 3).alias("min_odds"), r(F.col("_xo"), 3).alias("max_odds"),
        r(F.col("_ev"), 2).alias("avg_ev_pct"), F.coalesce("matches", F.lit(0)).alias("matches"))


def validate(df: DataFrame, name: str, key: list[str], required: list[str]) -> DataFrame:
    """One row: columns missing and not expected, rows, rows whose key isn't their own, and rows with an empty key."""
    missing = [c for c in required if c not in df.columns]
    extra = [c for c in df.columns if c not in required]
    own = [c for c in key if c in df.columns]
    counts = df.groupBy(*own).agg(F.count(F.lit(1)).alias("n")) if own else df.agg(F.count(F.lit(1)).alias("n"))
    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in own], F.lit(False))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("empty_keys")).select(
        F.lit(name).alias("table"), F.lit(",".join(missing)).alias("missing"), F.lit(",".join(extra)).alias("extra"), "rows", "duplicate_rows", "empty_keys",
        (F.lit(not missing) & (F.col("duplicate_rows") == 0) & (F.col("empty_keys") == 0)).alias("ok"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): values that only one of the two has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return join_null_safe(a, b, [key], "left_anti").withColumn("side", F.lit("left_only")).union(join_null_safe(b, a, [key], "left_anti").withColumn("side", F.lit("right_only")))


def group_sizes(df: DataFrame, by: list[str], group: str, low: int, high: int) -> DataFrame:
    """Groups whose number of rows lies outside the bounds."""
    return df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(low, high))


def availability(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """One row for each key of any source: its rows in every source (0 where it has none) and what that makes possible.

    Sources are reduced to counts and put together by one union and one aggregate. The
    status follows the sources' order: the last one, of those without a gap before it.
    """
    counts = reduce(lambda a, b: a.unionByName(b), [
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, *[(F.col("n") if s == name else F.lit(0).cast("long")).alias(f"{s}_rows") for s in sources]) for name, df in sources.items()])
    found = counts.groupBy(key).agg(*[F.sum(f"{s}_rows").alias(f"{s}_rows") for s in sources])
    status = F.lit("complete")
    for s in reversed(list(sources)):
        status = F.when(F.col(f"{s}_rows") == 0, F.lit(f"no_{s}")).otherwise(status)
    return found.withColumn("status", status)


def flag_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: all rows and how many each flag holds for; also of an empty table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(n) for n, c in flags.items()])


def betting_result(df: DataFrame, prob: Column, odds: Column, won: Column, stake: float = 1.0, method: str = "flat") -> DataFrame:
    """One row: bets, staked, profit, return and win rate of flat stakes or Kelly's."""
    s = F.lit(stake) if method == "flat" else stake * F.greatest(F.lit(0.0), (prob * odds - 1) / (odds - 1))
    rows = df.select(s.alias("s"), F.when(won, s * (odds - 1)).otherwise(-s).alias("p"), won.alias("w"))
    return rows.agg(
        F.count(F.lit(1)).alias("bets"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("staked"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("profit"),
        F.coalesce(F.try_divide(F.sum("p"), F.sum("s")), F.lit(0.0)).alias("roi"), F.coalesce(F.avg(F.col("w").cast("double")), F.lit(0.0)).alias("win_rate"))


def value_bets(df: DataFrame, key: list[str], outcomes: dict[str, tuple[str, str]], least_value: float = 0.05, least_prob: float = 0.10) -> DataFrame:
    """Long rows (outcome, prob, odds, house_prob, value) of the outcomes (probability's column, odds' column) worth a bet."""
    rows = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(p).alias("prob"), F.col(q).alias("odds")) for o, (p, q) in outcomes.items()])
    value = F.col("prob") * F.col("odds") - 1
    return df.select(*key, F.inline(rows)).where((F.col("odds") > 1) & F.col("prob").isNotNull()).withColumn("value", value).withColumn("house_prob", 1 / F.col("odds")).where(
        (F.col("value") >= least_value) & (F.col("prob") >= least_prob))


def priced(odds: DataFrame, model: DataFrame) -> DataFrame:
    """Every quote with the model's probability, fair odds and value: h2h by either team's name or a draw's, totals at 2.5, both to score.

    ``odds``: home, away, market, selection, line, bookmaker, odds. ``model``: home,
    away and p_home, p_draw, p_away, p_over25, p_both; of several rows of a pair (in
    either order) the one of the latest ``seq`` counts. Quotes of other markets, of
    unknown pairs or of odds up to 1 are left out.
    """
    pair = lambda df: df.withColumn("_one", F.least("home", "away")).withColumn("_two", F.greatest("home", "away"))
    names = ["home", "away", "p_home", "p_draw", "p_away", "p_over25", "p_both"]
    last = pair(model).groupBy("_one", "_two").agg(F.max_by(F.struct(*names), "seq").alias("m"))
    both = pair(odds).join(last, ["_one", "_two"])
    market, said = F.lower(F.trim("market")), F.lower(F.trim("selection"))
    m = lambda c: F.col(f"m.{c}")
    h2h = F.when(F.col("selection") == m("home"), F.struct(F.lit("1X2-H").alias("label"), m("p_home").alias("p"))).when(
        F.col("selection") == m("away"), F.struct(F.lit("1X2-A").alias("label"), m("p_away").alias("p"))).when(
        said.isin("draw", "tie"), F.struct(F.lit("1X2-D").alias("label"), m("p_draw").alias("p")))
    totals = F.when(said == "over", F.struct(F.lit("Over 2.5").alias("label"), m("p_over25").alias("p"))).when(
        said == "under", F.struct(F.lit("Under 2.5").alias("label"), (1 - m("p_over25")).alias("p")))
    either = F.when(said == "yes", F.struct(F.lit("BTTS yes").alias("label"), m("p_both").alias("p"))).when(
        said == "no", F.struct(F.lit("BTTS no").alias("label"), (1 - m("p_both")).alias("p")))
    found = both.withColumn("f", F.when(market == "h2h", h2h).when((market == "totals") & (F.abs(F.col("line") - 2.5) <= 1e-6), totals).when(market == "btts", either))
    good = found.where((F.col("f.p") > 0) & (F.col("odds") > 1))
    return good.select(
        *[c for c in odds.columns], F.col("f.label").alias("label"), F.col("f.p").alias("prob"), F.bround(1 / F.col("f.p"), 3).alias("fair_odds"),
        F.bround((F.col("f.p") * F.col("odds") - 1) * 100, 2).alias("ev_pct"))


def market_key(home: Column, away: Column, market: Column, selection: Column, line: Column) -> list[Column]:
    """Four columns that name a bet alike in all sources: the pair, the market, the selection and, for totals, the line to two digits.

    Markets have several names; a draw is "draw" whatever the case; of a double chance only who wins with it matters.
    """
    name, said = F.lower(F.trim(market)), F.lower(F.trim(F.coalesce(selection, F.lit(""))))
    kind = F.when(name == "totals", "total_goals").when(name == "h2h_dnb", "draw_no_bet").otherwise(name)
    h, a = F.contains(said, F.lower(home)), F.contains(said, F.lower(away))
    draw = F.contains(said, F.lit("draw"))
    chance = F.when(h & draw, F.concat(F.lower(home), F.lit(" or draw"))).when(a & draw, F.concat(F.lower(away), F.lit(" or draw"))).when(
        h & a, F.concat_ws(" or ", F.least(F.lower(home), F.lower(away)), F.greatest(F.lower(home), F.lower(away)))).otherwise(said)
    return [
        F.concat_ws("|", F.least(home, away), F.greatest(home, away)).alias("k_pair"), kind.alias("k_market"),
        F.when(name == "double_chance", chance).otherwise(said).alias("k_selection"),
        F.when(kind == "total_goals", F.coalesce(F.format_string("%.2f", line), F.lit(""))).otherwise("").alias("k_line")]


def lookup_bets(odds: DataFrame, probs: DataFrame, prob: str) -> tuple[DataFrame, DataFrame]:
    """(quotes with the model's probability, skipped quotes by market): joined on the four-part key, of repeated probabilities the one of the latest ``seq``."""
    parts = ["k_pair", "k_market", "k_selection", "k_line"]
    key = lambda df: df.select("*", *market_key(F.col("home"), F.col("away"), F.col("market"), F.col("selection"), F.col("line")))
    last = key(probs).groupBy(*parts).agg(F.max_by(prob, "seq").alias(prob))
    keyed = key(odds)
    return keyed.join(last, parts), keyed.join(last, parts, "left_anti").groupBy("k_market").agg(F.count(F.lit(1)).alias("skipped"))


def market_radar(df: DataFrame, key: list[str], families: list[tuple[str, str, float | None, Column]], least: float = 0.0001) -> DataFrame:
    """One row for each selection (market, selection, line, probability): fair odds, and the odds that give a value of 5, 10 and 15 percent. Null and zero chances give none."""
    rows = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), F.lit(line).cast("double").alias("line"), p.cast("double").alias("prob")) for m, s, line, p in families])
    p = F.least(F.greatest(F.col("prob"), F.lit(least)), F.lit(1 - least))
    return df.select(*key, F.inline(rows)).where(F.col("prob") > 0).select(
        *key, "market", "selection", "line", F.bround(p, 4).alias("prob"), F.bround(1 / p, 3).alias("fair_odds"),
        *[F.bround(x / p, 3).alias(f"odds_ev{round(100 * (x - 1))}") for x in (1.05, 1.10, 1.15)])


def ready_specs(items: DataFrame, specs: DataFrame, ready: Column) -> DataFrame:
    """Every item with every spec it is ready for. ``specs`` is a literal table of a few rows, so this grows with the items alone."""
    return items.crossJoin(F.broadcast(specs)).where(ready)
