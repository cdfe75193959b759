"""Bets, quotes, prices and signals as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import scalars as S
from fathomline.operators import aggregates as A
from fathomline.operators import joins as J
from fathomline.operators import reports as P
from fathomline.operators import rules as R
from fathomline.plans.registry import OFF_TIES, query
from fathomline.sources import table

BETS = """SELECT l_orderkey AS match, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CASE l_returnflag WHEN 'A' THEN '1X2-H' WHEN 'N' THEN '1X2-D' ELSE 'Over 2.5' END AS market, 1 + l_quantity / 20 AS odds, round(l_discount * 100) * 4 AS ev_pct,
 round(l_tax * 100) * 10 AS pct, l_linestatus = 'F' AS won, CASE WHEN l_linestatus = 'F' THEN l_quantity / 20 ELSE -1.0 END AS profit, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS variant FROM lineitem"""
LEVEL = "CASE WHEN pct >= 80 THEN 'VERY HIGH' WHEN pct >= 65 THEN 'HIGH' WHEN pct >= 50 THEN 'MEDIUM' WHEN pct >= 35 THEN 'LOW' ELSE 'VERY LOW' END"
LEVELS = [(80, "VERY HIGH"), (65, "HIGH"), (50, "MEDIUM"), (35, "LOW")]
TIE = ["n", "p", "s", "odds"]


def bets(spark, d) -> DataFrame:
    flag = F.col("l_returnflag")
    df = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("match"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.when(flag == "A", "1X2-H").when(flag == "N", "1X2-D").otherwise("Over 2.5").alias("market"),
        (1 + F.col("l_quantity") / 20).alias("odds"), (F.round(F.col("l_discount") * 100) * 4).alias("ev_pct"), (F.round(F.col("l_tax") * 100) * 10).alias("pct"), (F.col("l_linestatus") == "F").alias("won"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") / 20).otherwise(-1.0).alias("profit"), F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd").alias("variant"))
    return df.withColumn("level", S.ladder(F.col("pct"), LEVELS, "VERY LOW"))


def tagged(spark, d) -> DataFrame:
    return R.tag_values(bets(spark, d), F.col("market") != "1X2-D", "ev_pct")


_TAGGED = f"SELECT *, {LEVEL} AS level, market <> '1X2-D' AS market_ok, ev_pct BETWEEN 10 AND 40 AS ev_ok, market <> '1X2-D' AND ev_pct BETWEEN 10 AND 40 AS bet_allowed FROM ({BETS})"


@query(f"""
SELECT match, n, p, s, odds, market_ok, ev_ok, bet_allowed, CASE WHEN NOT market_ok THEN 'excluded_market_or_draw' WHEN NOT ev_ok THEN 'ev_outside_range' ELSE 'allowed' END AS reason FROM ({_TAGGED})""")
def tag_value_bets(spark, d):
    return tagged(spark, d).select("match", "n", "p", "s", "odds", "market_ok", "ev_ok", "bet_allowed", "reason")


_STRATEGY = f"""SELECT *, market <> '1X2-D' AS m, ev_pct BETWEEN 10 AND 40 AS e, odds BETWEEN 1.5 AND 2.5 AS o FROM ({BETS})"""


@query(f"""
SELECT match, n, p, s, odds, CASE WHEN NOT m THEN 'excluded_market' WHEN NOT e THEN 'ev_outside_range' WHEN NOT o THEN 'odds_outside_range' ELSE 'allowed' END AS reason, CAST(CASE WHEN m AND e AND o THEN profit ELSE 0 END AS DOUBLE) AS profit_strategy FROM ({_STRATEGY})""")
def strategy_filter(spark, d):
    out = R.apply_strategy(bets(spark, d), F.col("market") != "1X2-D", R.Strategy())
    return out.select("match", "n", "p", "s", "odds", "reason", "profit_strategy")


@query(f"""
WITH a AS (SELECT *, m AND e AND o AS ok, CASE WHEN m AND e AND o THEN profit ELSE 0 END AS gain FROM ({_STRATEGY})), b AS (SELECT * FROM a WHERE ok),
 r AS (SELECT *, sum(gain) OVER (PARTITION BY variant ORDER BY match, market, odds, n, p, s ROWS UNBOUNDED PRECEDING) AS ea, sum(gain) OVER (PARTITION BY variant, market ORDER BY match, market, odds, n, p, s ROWS UNBOUNDED PRECEDING) AS eo FROM b),
 f AS (SELECT *, ea - greatest(max(ea) OVER (PARTITION BY variant ORDER BY match, market, odds, n, p, s ROWS UNBOUNDED PRECEDING), 0) AS da, eo - greatest(max(eo) OVER (PARTITION BY variant, market ORDER BY match, market, odds, n, p, s ROWS UNBOUNDED PRECEDING), 0) AS dw FROM r),
 g AS (SELECT variant, market, count(*) AS bets, count(*) FILTER (won) AS wins, sum(gain) AS g, avg(gain) AS gm, stddev_samp(gain) AS gs, min(da) AS da, min(dw) AS dw, avg(odds) AS ao, min(odds) AS no, max(odds) AS xo, avg(ev_pct) AS ev, count(DISTINCT match) AS matches
  FROM f GROUP BY GROUPING SETS ((variant), (variant, market))), c AS (SELECT variant, market, count(*) AS candidates FROM a GROUP BY GROUPING SETS ((variant), (variant, market)))
SELECT c.variant, coalesce(c.market, 'overall') AS segment, candidates, coalesce(bets, 0) AS bets, coalesce(wins, 0) AS wins, round(100.0 * wins / bets + 0.000013, 2) AS hit_rate_pct, round(g, 3) AS profit_units, round(100 * g / bets + 0.000013, 2) AS roi_pct,
 round(100 * CASE WHEN bets > 1 THEN gm - 1.96 * gs / sqrt(bets) ELSE 0 END + 0.000013, 2) AS roi_low_pct, round(least(CASE WHEN c.market IS NULL THEN da ELSE dw END, 0), 3) AS max_drawdown, round(ao, 3) AS avg_odds, round(no, 3) AS min_odds, round(xo, 3) AS max_odds, matches
FROM c JOIN g ON c.variant = g.variant AND c.market IS NOT DISTINCT FROM g.market""")
def strategy_summary(spark, d):
    out = R.apply_strategy(bets(spark, d), F.col("market") != "1X2-D", R.Strategy())
    s = P.strategy_summary(out, "variant", "market", "match", "odds", "ev_pct", "won", ["match", "market", "odds", "n", "p", "s"])
    keep = ["variant", "segment", "candidates", "bets", "wins", "hit_rate_pct", "profit_units", "roi_pct", "roi_low_pct", "max_drawdown", "avg_odds", "min_odds", "max_odds", "matches"]
    return s.select(*keep)


@query(f"""
WITH b AS (SELECT *, {LEVEL} AS level, CASE WHEN p % 3 = 0 THEN ' High ' WHEN p % 3 = 1 THEN 'medium' ELSE 'odd' END AS confidence, CASE WHEN n % 2 = 0 THEN 2.5 ELSE 3.5 END AS line FROM ({BETS})),
 c AS (SELECT *, market IN ('Over 2.5', '1X2-H') AS market_ok, market <> 'Over 2.5' OR abs(line - 2.5) <= 1e-6 AS line_ok, ev_pct BETWEEN 5 AND 25 AS ev_ok, odds BETWEEN 1.5 AND 2.5 AS odds_ok, pct >= 50 AS reliability_ok, p % 3 <> 2 AS confidence_ok FROM b)
SELECT match, n, p, s, odds, market_ok AND line_ok AND ev_ok AND odds_ok AND reliability_ok AND confidence_ok AS paper_allowed,
 CASE WHEN market_ok AND line_ok AND ev_ok AND odds_ok AND reliability_ok AND confidence_ok THEN 'paper_track' ELSE concat_ws('+', CASE WHEN NOT market_ok THEN 'market' END, CASE WHEN NOT line_ok THEN 'line' END, CASE WHEN NOT ev_ok THEN 'ev' END,
  CASE WHEN NOT odds_ok THEN 'odds' END, CASE WHEN NOT reliability_ok THEN 'reliability' END, CASE WHEN NOT confidence_ok THEN 'confidence' END) END AS paper_reason FROM c""")
def paper_filter(spark, d):
    b = bets(spark, d).withColumn("confidence", F.when(F.col("p") % 3 == 0, " High ").when(F.col("p") % 3 == 1, "medium").otherwise("odd")).withColumn("line", F.when(F.col("n") % 2 == 0, 2.5).otherwise(3.5))
    checks = {
        "market": F.col("market").isin("Over 2.5", "1X2-H"), "line": (F.col("market") != "Over 2.5") | R.close_to(F.col("line"), 2.5), "ev": R.inside(F.col("ev_pct"), 5, 25), "odds": R.inside(F.col("odds"), 1.5, 2.5),
        "reliability": S.ordinal(F.col("level"), R.LEVELS) >= R.LEVELS.index("MEDIUM"), "confidence": S.ordinal(F.col("confidence"), R.CONFIDENCE) >= 1}
    return R.paper_filter(b, checks).select("match", "n", "p", "s", "odds", "paper_allowed", "paper_reason")


_LIST = f"SELECT match, n, p, s, odds, pct, ev_pct FROM (SELECT *, row_number() OVER (PARTITION BY match ORDER BY pct DESC, ev_pct DESC, n, p, s, odds) AS r FROM ({_TAGGED}) WHERE bet_allowed AND pct >= 50 AND odds BETWEEN 1.5 AND 2.5) WHERE r = 1"


def _listed(spark, d):
    return R.short_list(tagged(spark, d), ["match"], "level", "pct", "ev_pct", "odds", TIE)


@query(_LIST)
def short_list(spark, d):
    return _listed(spark, d).select("match", "n", "p", "s", "odds", "pct", "ev_pct")


@query(f"""
WITH l AS ({_LIST}), b AS (SELECT t.* FROM ({_TAGGED}) t ANTI JOIN l USING (match, n, p, s, odds) WHERE bet_allowed), w AS (SELECT *, concat_ws('+', CASE WHEN odds > 2.5 THEN 'high_odds' WHEN odds < 1.5 THEN 'low_odds' END, CASE WHEN pct < 50 THEN 'low_reliability' END) AS why FROM b)
SELECT match, n, p, s, odds, CASE WHEN why = '' THEN 'manual_review' ELSE why END AS review_reason, CASE WHEN pct >= 50 AND odds <= 4 AND odds > 2.5 THEN 'manual_check' ELSE 'paper_only' END AS review_action
FROM (SELECT *, row_number() OVER (PARTITION BY match ORDER BY pct DESC, ev_pct DESC, n, p, s, odds) AS r FROM w) WHERE r = 1""")
def review_list(spark, d):
    out = R.review_list(tagged(spark, d), _listed(spark, d), ["match", *TIE], ["match"], "level", "pct", "ev_pct", "odds", TIE)
    return out.select("match", "n", "p", "s", "odds", "review_reason", "review_action")


_MODEL = """SELECT o_orderkey AS seq, 'T' || (o_custkey % 40) AS home, 'T' || ((o_custkey % 40 + 1 + o_orderkey % 39) % 40) AS away, 0.2 + (o_orderkey % 7) / 20 AS p_home, 0.2 AS p_draw, 0.6 - (o_orderkey % 7) / 20 AS p_away, 0.3 + (o_orderkey % 5) / 10 AS p_over25, 0.25 + (o_orderkey % 3) / 10 AS p_both FROM orders"""
_QUOTES = """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, 'T' || (l_suppkey % 40) AS home, 'T' || ((l_suppkey % 40 + 1 + l_partkey % 39) % 40) AS away, CASE l_linenumber WHEN 1 THEN 'h2h' WHEN 2 THEN ' H2H' WHEN 3 THEN 'totals' WHEN 4 THEN 'Totals' WHEN 5 THEN 'btts' ELSE 'corners' END AS market,
 CASE l_linenumber WHEN 1 THEN 'T' || (l_suppkey % 40) WHEN 2 THEN 'Draw' WHEN 3 THEN 'Over' WHEN 4 THEN 'Under' ELSE 'Yes' END AS selection, CASE l_linenumber WHEN 3 THEN 2.5 WHEN 4 THEN 2.5 + l_partkey % 2 END AS line, l_quantity / 12 AS odds FROM lineitem"""


def _model(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    from fathomline.plans.games import team

    return table(spark, d, "orders").select(
        k.alias("seq"), team(c % 40).alias("home"), team((c % 40 + 1 + k % 39) % 40).alias("away"), (0.2 + (k % 7) / 20).alias("p_home"), F.lit(0.2).alias("p_draw"), (0.6 - (k % 7) / 20).alias("p_away"),
        (0.3 + (k % 5) / 10).alias("p_over25"), (0.25 + (k % 3) / 10).alias("p_both"))


def _quotes(spark, d):
    from fathomline.plans.games import team

    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), n.alias("n"), p.alias("p"), s.alias("s"), team(s % 40).alias("home"), team((s % 40 + 1 + p % 39) % 40).alias("away"),
        F.when(n == 1, "h2h").when(n == 2, " H2H").when(n == 3, "totals").when(n == 4, "Totals").when(n == 5, "btts").otherwise("corners").alias("market"),
        F.when(n == 1, team(s % 40)).when(n == 2, "Draw").when(n == 3, "Over").when(n == 4, "Under").otherwise("Yes").alias("selection"), F.when(n == 3, 2.5).when(n == 4, 2.5 + p % 2).alias("line"), (F.col("l_quantity") / 12).alias("odds"))


_LAST = f"(SELECT least(home, away) AS one, greatest(home, away) AS two, arg_max(home, seq) AS mh, arg_max(away, seq) AS ma, arg_max(p_home, seq) AS p_home, arg_max(p_draw, seq) AS p_draw, arg_max(p_away, seq) AS p_away, arg_max(p_over25, seq) AS p_over25, arg_max(p_both, seq) AS p_both FROM ({_MODEL}) GROUP BY 1, 2)"


@query(f"""
WITH q AS (SELECT *, lower(trim(market)) AS m, lower(selection) AS x FROM ({_QUOTES})), j AS (SELECT q.*, CASE WHEN m = 'h2h' AND selection = mh THEN '1X2-H' WHEN m = 'h2h' AND selection = ma THEN '1X2-A' WHEN m = 'h2h' AND x = 'draw' THEN '1X2-D' WHEN m = 'totals' AND line = 2.5 AND x = 'over' THEN 'Over 2.5'
  WHEN m = 'totals' AND line = 2.5 AND x = 'under' THEN 'Under 2.5' WHEN m = 'btts' AND x = 'yes' THEN 'BTTS yes' END AS label, p_home, p_draw, p_away, p_over25, p_both FROM q JOIN {_LAST} l ON l.one = least(q.home, q.away) AND l.two = greatest(q.home, q.away)),
 r AS (SELECT *, CASE label WHEN '1X2-H' THEN p_home WHEN '1X2-A' THEN p_away WHEN '1X2-D' THEN p_draw WHEN 'Over 2.5' THEN p_over25 WHEN 'Under 2.5' THEN 1 - p_over25 WHEN 'BTTS yes' THEN p_both END::DOUBLE AS prob FROM j WHERE label IS NOT NULL)
SELECT k, n, p, s, odds, label, round(prob, 6) AS prob, round(1 / prob + 0.000013, 3) AS fair, round(prob * odds - 1 + 0.000013, 4) AS ev FROM r WHERE odds > 1 AND prob > 0""")
def priced_quotes(spark, d):
    out = P.priced(_quotes(spark, d), _model(spark, d))
    return out.select("k", "n", "p", "s", "odds", "label", F.round("prob", 6).alias("prob"), F.round(1 / F.col("prob") + OFF_TIES, 3).alias("fair"), F.round(F.col("prob") * F.col("odds") - 1 + OFF_TIES, 4).alias("ev"))


_PROBS = f"SELECT least(home, away) || '|' || greatest(home, away) AS pair, 'total_goals' AS market, 'over' AS selection, '2.50' AS line, arg_max(p_over25, seq) AS prob FROM ({_MODEL}) GROUP BY 1"
_KEYED = f"SELECT *, least(home, away) || '|' || greatest(home, away) AS pair, CASE lower(trim(market)) WHEN 'totals' THEN 'total_goals' ELSE lower(trim(market)) END AS mk, lower(selection) AS sk, CASE WHEN lower(trim(market)) = 'totals' THEN printf('%.2f', line::DOUBLE) ELSE '' END AS lk FROM ({_QUOTES})"


def _looked_up(spark, d):
    probs = _model(spark, d).select("seq", "home", "away", F.lit("totals").alias("market"), F.lit("OVER").alias("selection"), F.lit(2.5).alias("line"), F.col("p_over25").alias("prob"))
    return P.lookup_bets(_quotes(spark, d), probs, "prob")


@query(f"SELECT k, n, p, s, odds, mk AS market, round(m.prob, 6) AS prob FROM ({_KEYED}) q JOIN ({_PROBS}) m ON q.pair = m.pair AND q.mk = m.market AND q.sk = m.selection AND q.lk = m.line")
def key_lookup(spark, d):
    return _looked_up(spark, d)[0].select("k", "n", "p", "s", "odds", F.col("k_market").alias("market"), F.round("prob", 6).alias("prob"))


@query(f"SELECT mk AS market, count(*) AS skipped FROM ({_KEYED}) q ANTI JOIN ({_PROBS}) m ON q.pair = m.pair AND q.mk = m.market AND q.sk = m.selection AND q.lk = m.line GROUP BY 1")
def key_lookup_skipped(spark, d):
    return _looked_up(spark, d)[1].withColumnRenamed("k_market", "market")


_OUTCOMES = """SELECT o_orderkey AS k, outcome, prob, odds FROM (SELECT o_orderkey, unnest([{'outcome': 'A', 'prob': (o_orderkey % 11) / 20, 'odds': 1 + (o_custkey % 9) / 2}, {'outcome': 'D', 'prob': 0.25, 'odds': CASE WHEN o_custkey % 5 <> 0 THEN 3.5 END}, {'outcome': 'H', 'prob': 0.75 - (o_orderkey % 11) / 20, 'odds': 1 + (o_custkey % 7) / 2}], recursive := true) FROM orders)"""
_VALUE = f"SELECT *, prob * odds - 1 AS value FROM ({_OUTCOMES}) WHERE odds > 1 AND prob * odds - 1 >= 0.0501 AND prob >= 0.10"


def _value_bets(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wide = table(spark, d, "orders").select(
        k.alias("k"), ((k % 11) / 20).alias("p_a"), F.lit(0.25).alias("p_d"), (0.75 - (k % 11) / 20).alias("p_h"), (1 + (c % 9) / 2).alias("o_a"), F.when(c % 5 != 0, 3.5).alias("o_d"), (1 + (c % 7) / 2).alias("o_h"))
    return P.value_bets(wide, ["k"], {"A": ("p_a", "o_a"), "D": ("p_d", "o_d"), "H": ("p_h", "o_h")}, least_value=0.0501)


@query(f"SELECT k, outcome, round(prob, 6) AS prob, odds, round(1 / odds, 6) AS house_prob, round(value, 6) AS value FROM ({_VALUE})")
def value_bets(spark, d):
    return _value_bets(spark, d).select("k", "outcome", F.round("prob", 6).alias("prob"), "odds", F.round("house_prob", 6).alias("house_prob"), F.round("value", 6).alias("value"))


@query(f"""
WITH b AS (SELECT *, k % 3 = 0 AS won, greatest(0, (prob * odds - 1) / (odds - 1)) AS ks FROM ({_VALUE})), u AS (SELECT 'flat' AS method, 1.0 AS s, odds, won FROM b UNION ALL SELECT 'kelly', ks, odds, won FROM b)
SELECT method, count(*) AS bets, round(sum(s), 4) AS staked, round(sum(CASE WHEN won THEN s * (odds - 1) ELSE -s END), 4) AS profit, round(sum(CASE WHEN won THEN s * (odds - 1) ELSE -s END) / sum(s), 6) AS roi, round(avg(won::INT), 6) AS win_rate FROM u GROUP BY 1""")
def stake_methods(spark, d):
    b = _value_bets(spark, d)
    each = [P.betting_result(b, F.col("prob"), F.col("odds"), F.col("k") % 3 == 0, method=m).select(F.lit(m).alias("method"), "*") for m in ("flat", "kelly")]
    both = each[0].union(each[1])
    return both.select("method", "bets", *[F.round(c, n).alias(c) for c, n in (("staked", 4), ("profit", 4), ("roi", 6), ("win_rate", 6))])


_FAMILIES = "[{'market': 'h2h', 'selection': 'home', 'line': CAST(NULL AS DOUBLE), 'prob': h / 4}, {'market': 'h2h', 'selection': 'away', 'line': NULL, 'prob': a / 4}, {'market': 'double_chance', 'selection': 'home or away', 'line': NULL, 'prob': (h + a) / 4}, {'market': 'total_goals', 'selection': 'over', 'line': 1.5, 'prob': 1 - exp(-h - a) * (1 + h + a)}, {'market': 'total_goals', 'selection': 'over', 'line': 2.5, 'prob': 1 - exp(-h - a) * (1 + h + a + (h + a) ** 2 / 2)}, {'market': 'team_goals', 'selection': 'home over', 'line': 0.5, 'prob': 1 - exp(-h)}, {'market': 'btts', 'selection': 'yes', 'line': NULL, 'prob': (1 - exp(-h)) * (1 - exp(-a))}, {'market': 'none', 'selection': 'none', 'line': NULL, 'prob': h * 0}]"


@query(f"""
WITH r AS (SELECT n_nationkey AS k, 0.6 + n_nationkey / 20 AS h, 1.9 - n_nationkey / 25 AS a FROM nation), u AS (SELECT k, unnest({_FAMILIES}, recursive := true) FROM r), p AS (SELECT *, least(greatest(prob, 0.0001), 0.9999) AS q FROM u WHERE prob > 0)
SELECT k, market, selection, line, round(q, 4) AS prob, round(1 / q, 3) AS fair_odds, round(1.05 / q, 3) AS odds_ev5, round(1.10 / q, 3) AS odds_ev10, round(1.15 / q, 3) AS odds_ev15 FROM p""")
def market_radar(spark, d):
    k = F.col("n_nationkey")
    r = table(spark, d, "nation").select(k.alias("k"), (0.6 + k / 20).alias("h"), (1.9 - k / 25).alias("a"))
    h, a = F.col("h"), F.col("a")
    families = [
        ("h2h", "home", None, h / 4), ("h2h", "away", None, a / 4), ("double_chance", "home or away", None, (h + a) / 4), ("total_goals", "over", 1.5, S.poisson_over(h + a, 1.5)), ("total_goals", "over", 2.5, S.poisson_over(h + a, 2.5)),
        ("team_goals", "home over", 0.5, S.poisson_over(h, 0.5)), ("btts", "yes", None, S.poisson_over(h, 0.5) * S.poisson_over(a, 0.5)), ("none", "none", None, h * 0)]
    return P.market_radar(r, ["k"], families)


_PAIRS = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 101) / 100.0::DOUBLE END AS a, CASE WHEN o_custkey % 9 <> 0 THEN (o_custkey % 97) / 96.0::DOUBLE END AS b, CASE WHEN o_orderkey % 3 <> 0 THEN ((o_custkey % 21) - 10) / 16.0::DOUBLE END AS gap,
 CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 801) - 400.0::DOUBLE END AS elo FROM orders"""


def _pairs(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("k"), F.when(k % 8 != 0, (k % 101) / 100.0).alias("a"), F.when(c % 9 != 0, (c % 97) / 96.0).alias("b"), F.when(k % 3 != 0, ((c % 21) - 10) / 16.0).alias("gap"), F.when(k % 5 != 0, (c % 801) - F.lit(400.0)).alias("elo"))


@query(f"""
WITH s AS (SELECT *, coalesce(abs(gap), least(abs(elo) / 600, 1.0), 0.15) AS strength FROM ({_PAIRS})), w AS (SELECT *, 0.25 + least(greatest((strength - 0.15) / (0.45 - 0.15), 0.0), 1.0) * (0.80 - 0.25) AS weight FROM s)
SELECT k, round(weight + 0.000013, 3) AS weight, round(strength + 0.000013, 3) AS strength, CASE WHEN weight <= 0.35 THEN 'first_lean' WHEN weight >= 0.70 THEN 'second_lean' ELSE 'blend' END AS regime,
 round(coalesce((1 - weight) * a + weight * b, a, b) + 0.000013, 3) AS blended, CASE WHEN a IS NULL OR b IS NULL THEN 'N/A' WHEN abs(a - b) < 0.05 THEN 'high' WHEN abs(a - b) < 0.10 THEN 'medium' ELSE 'low' END AS agreement FROM w""")
def blend_curve(spark, d):
    p = _pairs(spark, d)
    strength = F.coalesce(F.abs("gap"), F.least(F.abs("elo") / 600.0, F.lit(1.0)), F.lit(0.15))
    raw = 0.25 + S.clip((strength - 0.15) / (0.45 - 0.15), 0.0, 1.0) * (0.80 - 0.25)
    _, _, regime = S.blend_weight(F.col("gap"), F.col("elo"))
    _, label = S.agreement(F.col("a"), F.col("b"))
    return p.select("k", F.round(raw + OFF_TIES, 3).alias("weight"), F.round(strength + OFF_TIES, 3).alias("strength"), regime.alias("regime"), F.round(S.blended(F.col("a"), F.col("b"), raw) + OFF_TIES, 3).alias("blended"), label.alias("agreement"))


_CURVE = "CASE WHEN {x} <= 0.0 THEN 0.05 WHEN {x} <= 1.0 THEN 0.05 + ({x} - 0.0) * ((0.9 - 0.05) / (1.0 - 0.0)) ELSE 0.9 END"


@query(f"""
WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 50) / 100.0::DOUBLE AS h, (o_custkey % 30) / 100.0::DOUBLE AS dr FROM orders), q AS (SELECT *, 1 - h - dr AS a FROM p),
 c AS (SELECT k, least(greatest({_CURVE.format(x="h")}, 1e-6), 1.0) AS h, least(greatest(dr, 1e-6), 1.0) AS dr, least(greatest({_CURVE.format(x="a")}, 1e-6), 1.0) AS a FROM q)
SELECT k, round(h / (h + dr + a), 6) AS h, round(dr / (h + dr + a), 6) AS dr, round(a / (h + dr + a), 6) AS a, CASE WHEN h >= dr AND h >= a THEN 'H' WHEN dr >= a THEN 'D' ELSE 'A' END AS guess FROM c""")
def calibrated_classes(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 50) / 100.0).alias("h"), ((F.col("o_custkey") % 30) / 100.0).alias("dr")).withColumn("a", 1 - F.col("h") - F.col("dr"))
    curve = ([0.0, 1.0], [0.05, 0.9])
    h, dr, a = S.calibrated([F.col("h"), F.col("dr"), F.col("a")], [curve, None, curve])
    done = p.select("k", h.alias("h"), dr.alias("dr"), a.alias("a"))
    return done.select("k", *[F.round(c, 6).alias(c) for c in ("h", "dr", "a")], S.arg_max({"H": F.col("h"), "D": F.col("dr"), "A": F.col("a")}).alias("guess"))


@query(f"""
WITH s AS (SELECT k, CASE WHEN a IS NULL AND b IS NULL AND gap IS NULL THEN NULL ELSE 100 * (0.40 * coalesce(a, 0) + 0.25 * coalesce(b, 0) + 0.35 * coalesce(abs(gap), 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.40 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN gap IS NULL THEN 0 ELSE 0.35 END) END::DOUBLE AS pct FROM ({_PAIRS}))
SELECT k, round(pct + 0.000013, 3) AS pct, CASE WHEN pct IS NULL THEN 'N/A' WHEN pct >= 80.000001 THEN 'VERY HIGH' WHEN pct >= 65.000001 THEN 'HIGH' WHEN pct >= 50.000001 THEN 'MEDIUM' WHEN pct >= 35.000001 THEN 'LOW' ELSE 'VERY LOW' END AS level FROM s""")
def signal_reliability(spark, d):
    pct = S.signal_score({"a": (F.col("a"), 0.40), "b": (F.col("b"), 0.25), "gap": (F.abs("gap"), 0.35)})
    out = _pairs(spark, d).select("k", pct.alias("pct"))
    return out.select("k", F.round(F.col("pct") + OFF_TIES, 3).alias("pct"), S.ladder(F.col("pct"), [(x + 0.000001, n) for x, n in LEVELS], "VERY LOW", "N/A").alias("level"))


@query(f"""
WITH o AS (SELECT k, CASE WHEN a > 0 THEN 1 / greatest(a, 0.01) END AS x, CASE WHEN b > 0 THEN 1 / greatest(b, 0.01) END AS y FROM ({_PAIRS})), e AS (SELECT *, abs(x - y) / ((x + y) / 2) AS diff FROM o), l AS (SELECT *, CASE WHEN diff IS NULL THEN 'N/A' WHEN diff < 0.1 THEN 'HIGH' WHEN diff < 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM e)
SELECT k, round((x + y) / 2 + 0.000013, 3) AS average, round(diff + 0.000013, 4) AS diff, level, CASE WHEN level = 'HIGH' AND k % 2 = 0 THEN 'MEDIUM' ELSE level END AS overall FROM l""")
def model_comparison(spark, d):
    p = _pairs(spark, d)
    x, y = (F.when(F.col(c) > 0, 1 / F.greatest(F.col(c), F.lit(0.01))) for c in ("a", "b"))
    o = p.select("k", x.alias("x"), y.alias("y"))
    diff, level = S.odds_agreement(F.col("x"), F.col("y"))
    out = o.select("k", F.round((F.col("x") + F.col("y")) / 2 + OFF_TIES, 3).alias("average"), F.round(diff + OFF_TIES, 4).alias("diff"), level.alias("level"))
    return out.withColumn("overall", S.worst_label([F.col("level"), F.when(F.col("k") % 2 == 0, "MEDIUM").otherwise("HIGH")], ["N/A", "LOW", "MEDIUM", "HIGH"]))


@query("""
WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'core_candidate' WHEN 1 THEN 'manual_check' ELSE 'paper' END AS action, (o_orderkey % 100) / 100.0::DOUBLE AS prob, 0.75 + (o_custkey % 40) / 8 AS odds, 0.5 + (o_orderkey % 33) / 8 AS closing,
 CASE o_custkey % 6 WHEN 0 THEN 'Won' WHEN 1 THEN ' lost' WHEN 2 THEN 'void' WHEN 3 THEN NULL WHEN 4 THEN 'WIN' ELSE 'later' END AS result FROM orders)
SELECT k, CAST(CASE WHEN action = 'core_candidate' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS fixed_stake, round(CAST(CASE WHEN action = 'core_candidate' AND odds > 1 THEN least(1.0, 25 * greatest(0.0, (prob * odds - 1) / (odds - 1))) WHEN action = 'core_candidate' THEN 0.5 ELSE 0 END AS DOUBLE) + 0.000013, 2) AS kelly_stake,
 round(CASE WHEN odds > 1 AND closing > 1 THEN (odds / closing - 1) * 100 END + 0.000013, 1) AS clv_pct, CAST(CASE WHEN odds <= 1 THEN NULL WHEN lower(trim(result)) IN ('won', 'win') THEN odds - 1 WHEN lower(trim(result)) = 'lost' THEN -1 WHEN lower(trim(result)) = 'void' THEN 0 END AS DOUBLE) AS paper_profit FROM t""")
def tracker_money(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = table(spark, d, "orders").select(
        k.alias("k"), F.when(k % 4 == 0, "core_candidate").when(k % 4 == 1, "manual_check").otherwise("paper").alias("action"), ((k % 100) / 100.0).alias("prob"), (0.75 + (c % 40) / 8).alias("odds"), (0.5 + (k % 33) / 8).alias("closing"),
        F.when(c % 6 == 0, "Won").when(c % 6 == 1, " lost").when(c % 6 == 2, "void").when(c % 6 == 4, "WIN").when(c % 6 == 5, "later").alias("result"))
    stake = lambda m: S.stake_units(F.col("action"), F.col("prob"), F.col("odds"), method=m, digits=9)
    clv = F.when((F.col("odds") > 1) & (F.col("closing") > 1), (F.col("odds") / F.col("closing") - 1) * 100)
    return t.select("k", stake("fixed").alias("fixed_stake"), F.round(stake("kelly") + OFF_TIES, 2).alias("kelly_stake"), F.round(clv + OFF_TIES, 1).alias("clv_pct"), S.paper_profit(F.col("result"), F.lit(1.0), F.col("odds")).alias("paper_profit"))


@query("""
WITH o AS (SELECT user_id AS id, max(value) AS latest, min(value) AS first_odds, 'old' AS seen, CASE WHEN user_id % 2 = 0 THEN 'placed' ELSE 'candidate' END AS status, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE 0.7 END AS stake, 'kept' AS note FROM events WHERE event_type = 'view' AND user_id % 5 <> 0 GROUP BY 1),
 n AS (SELECT user_id AS id, max(value) AS latest, 'new' AS seen FROM events WHERE event_type = 'click' AND user_id % 7 <> 0 GROUP BY 1)
SELECT id, coalesce(n.latest, o.latest) AS latest, CASE WHEN o.id IS NULL THEN n.latest ELSE o.first_odds END AS first_odds, coalesce(n.seen, o.seen) AS seen, CASE WHEN o.id IS NULL THEN 'candidate' ELSE o.status END AS status,
 CAST(CASE WHEN o.id IS NULL THEN 0.5 WHEN n.id IS NOT NULL AND o.status = 'candidate' AND o.stake = 0 THEN 0.5 ELSE o.stake END AS DOUBLE) AS stake, o.note FROM o FULL JOIN n USING (id)""")
def upsert_preserving(spark, d):
    e = table(spark, d, "events")
    u = F.col("user_id")
    old = e.where("event_type = 'view' AND user_id % 5 <> 0").groupBy(u.alias("id")).agg(F.max("value").alias("latest"), F.min("value").alias("first_odds")).select(
        "id", "latest", "first_odds", F.lit("old").alias("seen"), F.when(F.col("id") % 2 == 0, "placed").otherwise("candidate").alias("status"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(0.7).alias("stake"), F.lit("kept").alias("note"))
    new = e.where("event_type = 'click' AND user_id % 7 <> 0").groupBy(u.alias("id")).agg(F.max("value").alias("latest")).withColumn("seen", F.lit("new"))
    o, n = F.col("_o"), F.col("_n")
    refill = n.isNotNull() & (o["status"] == "candidate") & (F.coalesce(o["stake"], F.lit(0.0)) == 0)
    return J.upsert_kept(
        old, new, ["id"], ["first_odds", "status", "stake", "note"], {"first_odds": n["latest"], "status": F.lit("candidate")},
        {"stake": F.when(o.isNull() | F.coalesce(refill, F.lit(False)), 0.5).otherwise(o["stake"])})


@query("""
WITH p AS (SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1), l AS (SELECT 'Brand#' || s_nationkey AS key, count(*) AS n FROM supplier GROUP BY 1), s AS (SELECT 'Brand#' || (c_nationkey + 10) AS key, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT key FROM p UNION SELECT key FROM l UNION SELECT key FROM s)
SELECT key, coalesce(p.n, 0) AS model_rows, coalesce(l.n, 0) AS odds_rows, coalesce(s.n, 0) AS tracker_rows, CASE WHEN p.n IS NULL THEN 'no_model' WHEN l.n IS NULL THEN 'no_odds' WHEN s.n IS NULL THEN 'no_tracker' ELSE 'complete' END AS status FROM k LEFT JOIN p USING (key) LEFT JOIN l USING (key) LEFT JOIN s USING (key)""")
def market_availability(spark, d):
    brand = lambda t, c: table(spark, d, t).select(F.concat(F.lit("Brand#"), c.cast("string")).alias("key"))
    return P.availability({"model": table(spark, d, "part").select(F.col("p_brand").alias("key")), "odds": brand("supplier", F.col("s_nationkey")), "tracker": brand("customer", F.col("c_nationkey") + 10)}, "key")


_SPECS = [("goals", 0.5, 100.0, 0.30), ("shots", 1.5, 300.0, 1.40), ("cards", 0.5, 0.0, 0.20), ("shots", 2.5, 900.0, 1.40)]


@query(f"""
WITH s AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {line}, {least}, {rate})" for m, line, least, rate in _SPECS)}) t(market, line, least, rate)), x AS (SELECT c_custkey AS k, c_acctbal / 500 AS minutes, market, line, CAST(rate AS DOUBLE) * (c_acctbal / 500) / 10 AS lam FROM customer, s WHERE c_acctbal >= least)
SELECT k, market, CAST(line AS DOUBLE) AS line, round(lam, 6) AS lam, round(1 - exp(-lam) * (1 + CASE WHEN line >= 1 THEN lam ELSE 0 END + CASE WHEN line >= 2 THEN lam * lam / 2 ELSE 0 END), 6) AS prob FROM x""")
def cross_specs(spark, d):
    specs = spark.createDataFrame(_SPECS, "market string, line double, least double, rate double")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 500).alias("minutes"), "c_acctbal")
    x = P.ready_specs(c, specs, F.col("c_acctbal") >= F.col("least")).withColumn("lam", F.col("rate") * F.col("minutes") / 10)
    prob = F.when(F.col("line") == 0.5, S.poisson_over(F.col("lam"), 0.5)).when(F.col("line") == 1.5, S.poisson_over(F.col("lam"), 1.5)).otherwise(S.poisson_over(F.col("lam"), 2.5))
    return x.select("k", "market", "line", F.round("lam", 6).alias("lam"), F.round(prob, 6).alias("prob"))


@query("""
WITH p AS (SELECT (o_orderkey % 41) / 100.0::DOUBLE AS a, (o_custkey % 30) / 100.0::DOUBLE AS b, CAST(o_orderkey % 3 AS INTEGER) AS y, o_totalprice AS v, o_totalprice + (o_orderkey % 7) - 3 AS g FROM orders), q AS (SELECT *, 1 - a - b AS c FROM p),
 r AS (SELECT *, CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS hit, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS guess FROM q)
SELECT count(*) AS n, round(avg((guess = y)::INT), 6) AS accuracy, round(avg(-ln(least(greatest(hit, 1e-15), 1 - 1e-15))), 6) AS log_loss, round(avg((a - (y = 0)::INT) ** 2 + (b - (y = 1)::INT) ** 2 + (c - (y = 2)::INT) ** 2), 6) AS brier, round(avg(abs(g - v)), 6) AS mae, round(sqrt(avg((g - v) ** 2)), 6) AS rmse FROM r""")
def metrics_classes(spark, d):
    p = table(spark, d, "orders").select(
        ((F.col("o_orderkey") % 41) / 100.0).alias("a"), ((F.col("o_custkey") % 30) / 100.0).alias("b"), (F.col("o_orderkey") % 3).alias("y"), F.col("o_totalprice").alias("v"), (F.col("o_totalprice") + F.col("o_orderkey") % 7 - 3).alias("g"))
    p = p.withColumn("c", 1 - F.col("a") - F.col("b"))
    both = A.class_metrics(p, ["a", "b", "c"], F.col("y")).crossJoin(A.regression_metrics(p, "g", "v").select("mae", "rmse"))  # one row each
    return both.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "log_loss", "brier", "mae", "rmse")])


_BUCKETS = """SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Defender' WHEN 2 THEN 'Midfielder' ELSE 'Forward' END AS position, s_nationkey AS team, s_acctbal AS v FROM supplier"""


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY team, position ORDER BY least(greatest(v / 3000, 0), 1) DESC, k) AS rank FROM ({_BUCKETS})),
 b AS (SELECT *, CASE position WHEN 'Goalkeeper' THEN CASE WHEN rank = 1 THEN 0.78 WHEN rank = 2 THEN 0.16 ELSE 0.04 END WHEN 'Defender' THEN CASE WHEN rank <= 4 THEN 0.68 WHEN rank <= 7 THEN 0.34 ELSE 0.12 END
  WHEN 'Midfielder' THEN CASE WHEN rank <= 4 THEN 0.66 WHEN rank <= 8 THEN 0.34 ELSE 0.14 END ELSE CASE WHEN rank <= 3 THEN 0.64 WHEN rank <= 7 THEN 0.34 ELSE 0.13 END END::DOUBLE AS auto FROM r), m AS (SELECT *, CASE WHEN k % 10 = 0 THEN 0.9 WHEN k % 10 = 1 THEN 0.0 END::DOUBLE AS manual FROM b), f AS (SELECT *, coalesce(manual, auto) AS prob FROM m)
SELECT k, CAST(rank AS INTEGER) AS rank, prob, CASE WHEN prob >= 0.75 THEN 'locked_starter' WHEN prob >= 0.52 THEN 'probable_starter' WHEN prob >= 0.20 THEN 'rotation' ELSE 'bench_option' END AS status, manual IS NOT NULL AS is_manual,
 round(prob * CASE position WHEN 'Goalkeeper' THEN 90 WHEN 'Defender' THEN 82 WHEN 'Midfielder' THEN 76 ELSE 72 END + (1 - prob) * CASE position WHEN 'Goalkeeper' THEN 0 WHEN 'Defender' THEN 12 WHEN 'Midfielder' THEN 22 ELSE 25 END, 4) AS minutes FROM f""")
def expected_minutes(spark, d):
    from fathomline.functions import minutes as M

    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 == 0, "gk").when(F.col("s_suppkey") % 4 == 1, "Central Defender").when(F.col("s_suppkey") % 4 == 2, "midfielder").otherwise("Forward").alias("said"), F.col("s_nationkey").alias("team"), F.col("s_acctbal").alias("v"))
    s = s.withColumn("position", M.position(F.col("said")))
    ranked = M.role_ranks(s, ["team", "position"], S.clip(F.col("v") / 3000, 0.0, 1.0), "k")
    manual = F.when(F.col("k") % 10 == 0, 0.9).when(F.col("k") % 10 == 1, 0.0)
    out = ranked.withColumn("manual", manual).withColumn("prob", F.coalesce("manual", M.start_probability(F.col("position"), F.col("rank"))))
    return out.select("k", "rank", "prob", M.lineup_status(F.col("prob")).alias("status"), F.col("manual").isNotNull().alias("is_manual"), F.round(M.expected_minutes(F.col("position"), F.col("prob")), 4).alias("minutes"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size / 20 AS h, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 25 END AS a, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice / 400 END AS r FROM part)
SELECT k, round(CASE WHEN a IS NOT NULL AND r IS NOT NULL THEN (h + a) / 90 * 95 * (r / 4.27) WHEN a IS NOT NULL THEN (h + a) / 90 * 95 WHEN r IS NOT NULL THEN r ELSE 4.27 END + 0.000013, 3) AS cards FROM p""")
def card_rate(spark, d):
    from fathomline.functions import minutes as M

    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, d, "part").select(k.alias("k"), (s / 20).alias("h"), F.when(k % 4 != 0, s / 25).alias("a"), F.when(k % 3 != 0, F.col("p_retailprice") / 400).alias("r"))
    return p.select("k", F.round(M.card_rate(F.col("h"), F.col("a"), F.col("r")) + OFF_TIES, 3).alias("cards"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size / 10 AS rate, 20 + p_partkey % 70 AS minutes, CASE p_partkey % 3 WHEN 0 THEN 'shots' WHEN 1 THEN 'shots_on_target' ELSE 'yellow_card' END AS market, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS tier FROM part),
 l AS (SELECT *, rate * minutes / 90 AS lam FROM p), q AS (SELECT *, 1 - exp(-lam) AS raw FROM l), c AS (SELECT *, CASE market WHEN 'shots' THEN least(raw, 0.80) WHEN 'shots_on_target' THEN 0.35 * raw + 0.65 * 0.40 ELSE raw END AS prob FROM q)
SELECT k, round(prob, 6) AS prob, CASE WHEN 1 / prob < 1.45 THEN 'price_too_short_watch_only' WHEN 1 / prob > 8 THEN 'longshot_manual_only' WHEN market = 'shots_on_target' THEN CASE WHEN tier IN ('A', 'B') AND prob >= 0.18 THEN 'radar_watch' WHEN tier = 'C' AND prob >= 0.22 THEN 'low_confidence_review' ELSE 'no_action' END
 WHEN tier IN ('A', 'B') AND prob >= 0.22 THEN 'manual_review_if_odds_available' WHEN tier IN ('A', 'B') AND prob >= 0.14 THEN 'radar_watch' WHEN tier = 'C' AND prob >= 0.22 THEN 'low_confidence_review' WHEN market = 'yellow_card' AND prob >= 0.16 AND tier <> 'D' THEN 'card_radar_watch' ELSE 'no_action' END AS action FROM c""")
def prop_prices(spark, d):
    from fathomline.functions import minutes as M

    k = F.col("p_partkey")
    p = table(spark, d, "part").select(
        k.alias("k"), (F.col("p_size") / 10 * (20 + k % 70) / 90).alias("lam"), F.when(k % 3 == 0, "shots").when(k % 3 == 1, "shots_on_target").otherwise("yellow_card").alias("market"),
        F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").otherwise("D").alias("tier"))
    prob = M.prop_probability(F.col("lam"), 0.5, F.col("market"), {"shots": 0.80}, F.when(F.col("market") == "shots_on_target", 0.40))
    out = p.withColumn("prob", prob)
    return out.select("k", F.round("prob", 6).alias("prob"), M.prop_action(F.col("prob"), F.col("tier"), F.col("market"), 1 / F.col("prob")).alias("action"))


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS signal_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'closing' WHEN 'error' THEN 'result' ELSE 'signal' END AS kind, round(1.1 + value / 50, 2) AS odds, CASE WHEN event_type <> 'click' THEN CAST(event_id % 3 AS DOUBLE) END AS stake, CASE WHEN value > 60 THEN 'win' WHEN value > 20 THEN 'loss' ELSE 'void' END AS result FROM events),
 g AS (SELECT signal_id, min(ts) FILTER (kind = 'signal') AS first_seen, max(ts) FILTER (kind = 'signal') AS last_seen, arg_min(odds, (ts, event_id)) FILTER (kind = 'signal') AS first_odds, arg_max(odds, (ts, event_id)) FILTER (kind = 'signal') AS latest_odds,
 coalesce((min((ts, event_id, coalesce(stake, 0))) FILTER (kind = 'signal'))[3], 0) AS stake, arg_max(odds, (ts, event_id)) FILTER (kind = 'closing') AS closing_odds, arg_max(result, (ts, event_id)) FILTER (kind = 'result') AS result FROM e GROUP BY 1)
SELECT signal_id, first_seen, last_seen, first_odds, latest_odds, stake, closing_odds, result, round((first_odds / closing_odds - 1) * 100 + 0.000013, 2) AS clv_pct, round(CASE result WHEN 'win' THEN (first_odds - 1) * stake WHEN 'loss' THEN -stake WHEN 'void' THEN 0 END + 0.000013, 2) AS profit,
 CASE WHEN result IS NOT NULL THEN 'settled' WHEN last_seen + INTERVAL 72 HOUR < (SELECT max(ts) FROM e) THEN 'expired' ELSE 'open' END AS status FROM g WHERE first_seen IS NOT NULL""")
def tracker_replay(spark, d):
    """The stateful tracker's rows over the whole table of events; on a stream, ``streaming.tracker.track`` gives the same."""
    from fathomline.streaming.tracker import replayed

    # odds at half a hundredth are rounded as the double times 100 tells, which is what SQL's engine does
    e, v = F.col("event_type"), F.col("value")
    events = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("signal_id"), "event_id", "ts", F.when(e == "purchase", "closing").when(e == "error", "result").otherwise("signal").alias("kind"), (F.round((1.1 + v / 50) * 100) / 100).alias("odds"),
        F.when(e != "click", (F.col("event_id") % 3).cast("double")).alias("stake"), F.when(v > 60, "win").when(v > 20, "loss").otherwise("void").alias("result"))
    rows = replayed(events, digits=None)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return rows.select("signal_id", ntz("first_seen"), ntz("last_seen"), "first_odds", "latest_odds", "stake", "closing_odds", "result", F.round(F.col("clv_pct") + 0.000013, 2).alias("clv_pct"), F.round(F.col("profit") + 0.000013, 2).alias("profit"), "status")
