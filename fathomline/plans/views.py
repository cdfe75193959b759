"""Signals, readiness, scopes, phases, keys and player sheets as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import views as V
from fathomline.plans.bets import BETS, LEVEL, bets
from fathomline.plans.registry import OFF_TIES, query
from fathomline.sources import feeds as N
from fathomline.sources import table

_ACTION = "CASE p % 7 WHEN 0 THEN 'manual_review_if_odds_available' WHEN 1 THEN 'radar_watch' WHEN 2 THEN 'card_radar_watch' WHEN 3 THEN 'low_confidence_review' WHEN 4 THEN 'longshot_manual_only' ELSE 'no_action' END"


@query(f"""
WITH b AS (SELECT *, {_ACTION} AS action, n % 2 = 0 AS allowed, pct / 100 AS prob FROM ({BETS})), r AS (SELECT *, CASE action WHEN 'manual_review_if_odds_available' THEN 1 WHEN 'radar_watch' THEN 2 WHEN 'card_radar_watch' THEN 3 WHEN 'low_confidence_review' THEN 4 ELSE 5 END AS priority FROM b WHERE action <> 'no_action' AND odds BETWEEN 1.35 AND 8)
SELECT match, n, p, s, action, CAST(priority AS INTEGER) AS priority, allowed, round(odds * 1.1 + {OFF_TIES}, 3) AS least_odds FROM r ORDER BY match, priority, allowed DESC, prob DESC, n, p, s, odds LIMIT 600""")
def signal_rows(spark, d):
    k = F.col("p") % 7
    action = F.when(k == 0, "manual_review_if_odds_available").when(k == 1, "radar_watch").when(k == 2, "card_radar_watch").when(k == 3, "low_confidence_review").when(k == 4, "longshot_manual_only").otherwise("no_action")
    b = bets(spark, d).withColumn("action", action).withColumn("allowed", F.col("n") % 2 == 0).withColumn("prob", F.col("pct") / 100).withColumn("fair_odds", F.col("odds"))
    return V.signal_rows(b, ["n", "p", "s", "odds"]).select("match", "n", "p", "s", "action", "priority", "allowed", F.round(F.col("fair_odds") * 1.1 + OFF_TIES, 3).alias("least_odds"))


@query(f"""
SELECT 'Over 2.5' AS market, count(*) AS "rows", count(*) FILTER (pct >= 50 AND ev_pct >= 20) AS candidates, (SELECT count(*) FROM ({BETS}) WHERE market = '1X2-H') AS odds_rows, CAST(0 AS BIGINT) AS tested_rows, 'ready_for_paper_tracking' AS decision FROM ({BETS}) WHERE market = 'Over 2.5'""")
def readiness_report(spark, d):
    b = bets(spark, d)
    out = V.readiness(b.where("market = 'Over 2.5'"), (F.col("pct") >= 50) & (F.col("ev_pct") >= 20), b.where("market = '1X2-H'"), b.where("false"))
    return out.select(F.lit("Over 2.5").alias("market"), *out.columns)


@query(f"""
WITH b AS (SELECT *, {LEVEL} AS level FROM ({BETS})), f AS (SELECT match, n, p, s, odds, won, pct >= 50 AS reliable, ev_pct > 20 AS valued, CASE WHEN n = 3 THEN false ELSE odds < 2 END AS short FROM b)
SELECT match, n, p, s, odds, reliable, valued, short, reliable::INT + valued::INT + short::INT AS n_ready, reliable::INT + valued::INT + short::INT >= 2 AS is_ready FROM f""")
def readiness_flags(spark, d):
    flags = {"reliable": F.col("pct") >= 50, "valued": F.col("ev_pct") > 20, "short": F.when(F.col("n") != 3, F.col("odds") < 2)}
    return V.ready_flags(bets(spark, d), flags, 2).select("match", "n", "p", "s", "odds", *flags, "n_ready", "is_ready")


@query("""
WITH g AS (SELECT o_orderkey AS k, 'T' || (o_custkey % 6) AS home, 'T' || (o_orderkey % 5 + 1) AS away, CASE WHEN o_orderkey % 3 = 0 THEN 'totals' ELSE 'h2h' END AS market, CASE o_orderkey % 4 WHEN 0 THEN ' Draw' WHEN 1 THEN NULL ELSE 'x' END AS selection FROM orders),
 f AS (SELECT * FROM (VALUES ('T1', 'T2', 'Group A'), ('T3', 'T4', 'Group B'), ('T2', 'T1', 'Final')) t(one, two, phase))
SELECT k, CASE WHEN market = 'h2h' AND lower(trim(selection)) = 'draw' THEN 'excluded_draw' WHEN market = 'h2h' THEN 'use_core_filters' ELSE 'radar_only' END AS scope, coalesce(a.phase, b.phase, 'Knockout') AS phase FROM g LEFT JOIN f a ON a.one = home AND a.two = away LEFT JOIN f b ON b.two = home AND b.one = away""")
def scopes_and_phases(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = lambda n: F.concat(F.lit("T"), n.cast("string"))
    g = table(spark, d, "orders").select(k.alias("k"), t(c % 6).alias("home"), t(k % 5 + 1).alias("away"), F.when(k % 3 == 0, "totals").otherwise("h2h").alias("market"), F.when(k % 4 == 0, " Draw").when(k % 4 != 1, "x").alias("selection"))
    fixtures = spark.createDataFrame([("T1", "T2", "Group A"), ("T3", "T4", "Group B"), ("T2", "T1", "Final")], "one string, two string, phase string")
    return V.with_phase(g, fixtures, "home", "away").select("k", V.scope(F.col("market"), F.col("selection")).alias("scope"), "phase")


@query("""
WITH p AS (SELECT p_partkey AS k, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS key, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS more FROM part),
 n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY k) AS i FROM p) SELECT k, CASE WHEN n > 1 THEN key || '_' || more || '_' || i ELSE key END AS key FROM n""")
def person_keys(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_name", "p_type")
    return V.person_keys(p, "p_brand", "p_name", ["p_type"], "k").select("k", "key")


@query("""
SELECT 'feed:match:' || (event_id // 40) AS match_id, 'feed:team:' || (user_id % 2) AS team_id, 'feed:player:p-' || user_id AS player_id, CAST(event_id % 90 AS INTEGER) AS minutes_played, CASE WHEN event_type = 'click' THEN CAST(event_id % 3 AS INTEGER) END AS goals, CAST(event_id % 5 AS INTEGER) AS shots, CAST(event_id % 2 AS INTEGER) AS yellow_cards, event_id,
 CASE WHEN event_type = 'click' THEN CAST(event_id % 4 AS INTEGER) END AS assists, CAST(event_id % 5 // 2 AS INTEGER) AS shots_on_target, CASE WHEN event_type <> 'error' THEN CAST(event_id % 7 AS INTEGER) END AS key_passes, CAST(event_id % 11 AS INTEGER) AS fouls_won, CAST(event_id % 13 AS INTEGER) AS red_cards FROM events""")
def player_sheets(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    stat = F.struct(
        F.struct((i % 90).cast("int").alias("minutes")).alias("games"), F.struct((i % 5).cast("int").alias("total"), F.floor(i % 5 / 2).cast("int").alias("on")).alias("shots"),
        F.when(F.col("event_type") == "click", F.struct((i % 3).cast("int").alias("total"), (i % 4).cast("int").alias("assists"))).alias("goals"), F.when(F.col("event_type") != "error", F.struct((i % 7).cast("int").alias("key"))).alias("passes"),
        F.struct(i.cast("int").alias("committed"), (i % 11).cast("int").alias("drawn")).alias("fouls"), F.struct((i % 2).cast("int").alias("yellow"), (i % 13).cast("int").alias("red")).alias("cards"))
    player = F.struct(F.struct(F.concat(F.lit("P "), u.cast("string")).alias("name")).alias("player"), F.array(stat).alias("statistics"))
    rows = table(spark, d, "events").select(F.floor(i / 40).cast("long").alias("m"), (u % 2).cast("string").alias("team"), player.alias("p"))
    teams = rows.groupBy("m", "team").agg(F.collect_list("p").alias("players")).select("m", F.struct(F.struct(F.col("team").alias("id")).alias("team"), "players").alias("t"))
    feed = teams.groupBy("m").agg(F.to_json(F.collect_list("t")).alias("payload"))
    out = N.player_sheets(feed, "m", "payload")
    return out.select("match_id", "team_id", "player_id", "minutes_played", "goals", "shots", "yellow_cards", F.col("fouls_committed").cast("long").alias("event_id"), "assists", "shots_on_target", "key_passes", "fouls_won", "red_cards")
