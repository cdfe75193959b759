"""Nested feeds, built from the driver's tables as JSON and flattened again, with SQL over the flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import lifecycle as L
from fathomline.plans.registry import query
from fathomline.sources import feeds as N
from fathomline.sources import table

_FLAT = """SELECT l_orderkey AS m, CASE l_returnflag WHEN 'A' THEN 'pinnacle' WHEN 'N' THEN 'Matchbook' ELSE 'other' END AS book, CASE l_linestatus WHEN 'F' THEN 'totals' ELSE 'h2h' END AS market, 'S' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN ' (Over 2.5)' ELSE '' END AS said,
 CASE WHEN l_quantity > 3 THEN l_quantity / 8 END AS price, CASE WHEN l_linenumber = 3 THEN 1.5 END AS point, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS tm, l_suppkey AS s FROM lineitem"""
_QUOTES = f"""SELECT 'feed:match:' || m AS match_id, book AS bookmaker, lower(book) IN ('pinnacle', 'betfair_ex_uk', 'betfair_ex_eu', 'matchbook') AS is_sharp, market, CASE WHEN point IS NULL AND said LIKE '%(Over 2.5)' THEN replace(said, '(Over 2.5)', 'Over') ELSE said END AS selection,
 CAST(CASE WHEN point IS NOT NULL THEN point WHEN said LIKE '%(Over 2.5)' THEN 2.5 END AS DOUBLE) AS line, price AS odds, tm FROM ({_FLAT}) WHERE price IS NOT NULL"""


def _flat(spark, d) -> DataFrame:
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("m"), F.when(flag == "A", "pinnacle").when(flag == "N", "Matchbook").otherwise("other").alias("book"), F.when(F.col("l_linestatus") == "F", "totals").otherwise("h2h").alias("market"),
        F.concat(F.lit("S"), F.col("l_partkey").cast("string"), F.when(n % 2 == 0, " (Over 2.5)").otherwise("")).alias("said"), F.when(F.col("l_quantity") > 3, F.col("l_quantity") / 8).alias("price"), F.when(n == 3, 1.5).alias("point"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


def _quotes(spark, d) -> DataFrame:
    """One JSON document a match: books > markets > outcomes; the time stands at the market, the book or the match."""
    flat = _flat(spark, d)
    outcomes = flat.groupBy("m", "book", "market", "at").agg(F.collect_list(F.struct(F.col("said").alias("name"), F.col("price"), F.col("point"))).alias("outcomes"))
    named = outcomes.select("m", "book", F.struct(F.col("market").alias("key"), F.col("at").alias("last_update"), "outcomes").alias("market"))
    books = named.groupBy("m", "book").agg(F.collect_list("market").alias("markets")).select("m", F.struct(F.col("book").alias("key"), "markets").alias("book"))
    feed = books.groupBy("m").agg(F.collect_list("book").alias("bookmakers")).select(F.to_json(F.struct(F.col("m").cast("string").alias("id"), "bookmakers")).alias("payload"))
    return N.flatten_quotes(feed, "payload")


_SHOWN = ["match_id", "bookmaker", "is_sharp", "market", "selection", "line", "odds"]
_ID = "'feed:odds:' || substr(sha1(match_id || '|' || bookmaker || '|' || market || '|' || selection || '|' || coalesce(CAST(line AS VARCHAR), '') || '|' || tm), 1, 16)"
_SQL = f"SELECT {', '.join(_SHOWN)}, round(1 / odds, 6) AS implied, {_ID} AS odds_id FROM ({_QUOTES})"


@query(_SQL)
def odds_flatten(spark, d):
    return _quotes(spark, d).select(*_SHOWN, F.round("implied", 6).alias("implied"), "odds_id")


def _flat_quotes(spark, d):
    return N.flat_quotes(_flat(spark, d).select(F.col("m").alias("match_id"), F.col("book").alias("bookmaker"), "market", F.col("said").alias("selection"), F.col("point").alias("line"), F.col("price").alias("odds"), F.col("at").alias("quote_time")))


@query(_SQL)
def odds_flat(spark, d):
    return _flat_quotes(spark, d).select(*_SHOWN, F.round("implied", 6).alias("implied"), "odds_id")


@query(f"""
WITH q AS (SELECT *, {_ID} AS id FROM ({_QUOTES})), w AS (SELECT *, row_number() OVER (PARTITION BY match_id, bookmaker, market, selection, line ORDER BY tm, id) AS f, row_number() OVER (PARTITION BY match_id, bookmaker, market, selection, line ORDER BY tm DESC, id) AS l FROM q)
SELECT match_id, bookmaker, market, selection, line, max(odds) FILTER (f = 1 AND l <> 1) AS opening, max(odds) FILTER (l = 1) AS closing FROM w GROUP BY 1, 2, 3, 4, 5""")
def open_close_pivot(spark, d):
    return N.open_close_table(_flat_quotes(spark, d))


_E = """SELECT event_id // 40 AS match_id, event_id % 40 AS seq, CAST(user_id % 2 AS VARCHAR) AS team, CAST(user_id AS VARCHAR) AS player, CAST(event_id % 90 AS INTEGER) AS minute, CAST(event_id % 60 AS INTEGER) AS second,
 CASE event_type WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Shot' WHEN 'signup' THEN 'Substitution' WHEN 'purchase' THEN 'Foul Committed' ELSE CASE WHEN value > 50 THEN 'Foul Won' ELSE 'Bad Behaviour' END END AS kind, CAST(event_id % 4 AS INTEGER) AS x, value, CAST((user_id + 2) % 150 AS VARCHAR) AS other FROM events"""


def _events(spark, d) -> DataFrame:
    """The events table as a provider's feed: one JSON array for forty events, then read back."""
    i, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    x, named = i % 4, lambda c: F.struct(c.cast("string").alias("id"), F.concat(F.lit("N"), c.cast("string")).alias("name"))
    card = F.struct(F.struct(F.when(x == 0, "Yellow Card").when(x == 1, "Red Card").when(x == 2, "Second Yellow").alias("name")).alias("card"))
    squad = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(named((u + k * 2) % 150).alias("player"), F.struct(F.lit("Wing").alias("name")).alias("position"), k.cast("int").alias("jersey_number")))
    kind = F.when(i % 40 < 2, "Starting XI").when(t == "view", "Pass").when(t == "click", "Shot").when(t == "signup", "Substitution").when(t == "purchase", "Foul Committed").when(F.col("value") > 50, "Foul Won").otherwise("Bad Behaviour")
    e = F.struct(
        F.struct(kind.alias("name")).alias("type"), named(u % 2).alias("team"), F.when(kind != "Starting XI", named(u)).alias("player"), (i % 90).cast("int").alias("minute"), (i % 60).cast("int").alias("second"),
        F.when(kind == "Shot", F.struct(F.struct(F.when(x == 0, "Goal").when(x == 1, "Saved").otherwise("Off T").alias("name")).alias("outcome"), F.col("value").alias("statsbomb_xg"))).alias("shot"),
        F.when(kind == "Pass", F.struct(F.struct(F.when(x == 0, "Corner").alias("name")).alias("type"), (x == 1).alias("shot_assist"), (x == 2).alias("goal_assist"))).alias("pass"),
        F.when(kind == "Foul Committed", card).alias("foul_committed"), F.when(kind == "Bad Behaviour", card).alias("bad_behaviour"),
        F.when(kind == "Substitution", F.struct(named((u + 2) % 150).alias("replacement"))).alias("substitution"), F.when(kind == "Starting XI", F.struct(squad.alias("lineup"))).alias("tactics"))
    rows = table(spark, d, "events").select((F.floor(i / 40)).cast("long").alias("match_id"), F.struct((i % 40).alias("o"), e.alias("e")).alias("x"))
    feed = rows.groupBy("match_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"])).alias("payload"))
    return N.events_of(feed, "match_id", "payload")


_P = f"SELECT * FROM ({_E}) WHERE seq >= 2"
_COUNTS = """count(*) FILTER (kind = 'Shot') AS shots, count(*) FILTER (kind = 'Shot' AND x <= 1) AS shots_on_target, count(*) FILTER (kind = 'Shot' AND x = 0) AS goals, round(coalesce(sum(value) FILTER (kind = 'Shot'), 0), 4) AS xg, count(*) FILTER (kind = 'Pass' AND x = 0) AS corners_taken,
 count(*) FILTER (kind = 'Pass' AND x = 1) AS key_passes, count(*) FILTER (kind = 'Pass' AND x = 2) AS assists, count(*) FILTER (kind = 'Foul Committed') AS fouls_committed, count(*) FILTER (kind IN ('Foul Committed', 'Bad Behaviour') AND x = 0) AS yellow_cards,
 count(*) FILTER (kind IN ('Foul Committed', 'Bad Behaviour') AND x IN (1, 2)) AS red_cards, count(*) FILTER (kind = 'Foul Won') AS fouls_won"""


@query(f"SELECT CAST(match_id AS VARCHAR) AS match_id, team, player, {_COUNTS} FROM ({_P}) GROUP BY 1, 2, 3")
def event_player_stats(spark, d):
    out = N.player_stats(_events(spark, d))
    return out.withColumn("xg", F.round("xg", 4))


@query(f"""
SELECT CAST(match_id AS VARCHAR) AS match_id, count(*) FILTER (team = '0' AND kind = 'Pass' AND x = 0) AS corners_home, count(*) FILTER (team = '1' AND kind = 'Pass' AND x = 0) AS corners_away,
 count(*) FILTER (team = '0' AND kind IN ('Foul Committed', 'Bad Behaviour') AND x = 0) AS yellow_home, count(*) FILTER (team = '1' AND kind IN ('Foul Committed', 'Bad Behaviour') AND x = 0) AS yellow_away,
 count(*) FILTER (team = '0' AND kind = 'Shot') AS shots_home, count(*) FILTER (team = '1' AND kind = 'Shot') AS shots_away, count(*) FILTER (team = '0' AND kind = 'Shot' AND x <= 1) AS on_target_home, count(*) FILTER (team = '1' AND kind = 'Shot' AND x <= 1) AS on_target_away,
 count(*) FILTER (team = '0' AND kind IN ('Foul Committed', 'Bad Behaviour') AND x IN (1, 2)) AS red_home, count(*) FILTER (team = '1' AND kind IN ('Foul Committed', 'Bad Behaviour') AND x IN (1, 2)) AS red_away,
 round(coalesce(sum(value) FILTER (team = '0' AND kind = 'Shot'), 0), 4) AS xg_home, round(coalesce(sum(value) FILTER (team = '1' AND kind = 'Shot'), 0), 4) AS xg_away FROM ({_P}) GROUP BY 1""")
def event_match_stats(spark, d):
    events = _events(spark, d)
    home = events.select("match_id").distinct().withColumn("home_team", F.lit("0"))
    return N.match_stats(events, home).withColumns({c: F.round(c, 4) for c in ("xg_home", "xg_away")})


@query(f"""
WITH e AS (SELECT * FROM ({_E})), s AS (SELECT match_id, team, CAST((CAST(player AS INTEGER) + 2 * k) % 150 AS VARCHAR) AS player, seq, true AS starter, CAST(k AS INTEGER) AS shirt, 0.0::DOUBLE AS on_at FROM e, (SELECT unnest(range(5)) AS k) WHERE seq < 2),
 n AS (SELECT match_id, team, other AS player, seq, false, NULL, minute + second / 60 FROM e WHERE seq >= 2 AND kind = 'Substitution'), l AS (SELECT match_id, team, player, arg_max({{'s': starter, 'h': shirt, 'o': on_at, 'q': seq}}, seq) AS v FROM (SELECT * FROM s UNION ALL SELECT * FROM n) GROUP BY 1, 2, 3),
 o AS (SELECT match_id, team, player, max(seq) AS q, arg_max(minute + second / 60, seq) AS off_at FROM e WHERE seq >= 2 AND kind = 'Substitution' GROUP BY 1, 2, 3)
SELECT CAST(match_id AS VARCHAR) AS match_id, team, player, coalesce(l.v.s, true) AS is_starter, l.v.h AS shirt, round(coalesce(l.v.o, 0), 4) AS minute_on, round(CASE WHEN l.v IS NULL OR o.q > l.v.q THEN off_at END, 4) AS minute_off FROM l FULL JOIN o USING (match_id, team, player)""")
def event_lineups(spark, d):
    out = N.lineups(_events(spark, d))
    return out.select("match_id", "team", "player", "is_starter", "shirt", F.round("minute_on", 4).alias("minute_on"), F.round("minute_off", 4).alias("minute_off"))


@query(f"""
WITH e AS (SELECT * FROM ({_E})), u AS (SELECT match_id, seq, team, CAST((CAST(player AS INTEGER) + 2 * k) % 150 AS VARCHAR) AS player, 'Wing' AS position FROM e, (SELECT unnest(range(5)) AS k) WHERE seq < 2 UNION ALL SELECT match_id, seq, team, player, NULL FROM e WHERE seq >= 2
 UNION ALL SELECT match_id, seq, team, other, NULL FROM e WHERE seq >= 2 AND kind = 'Substitution')
SELECT player, 'N' || player AS name, arg_max(team, (CAST(match_id AS VARCHAR), seq)) AS team, max(position) AS position FROM u GROUP BY 1""")
def event_players(spark, d):
    return N.players_of(_events(spark, d))


_H = "SELECT user_id % 20 AS place, ts, value, row_number() OVER (PARTITION BY user_id % 20, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events"


def _weather(spark, d):
    """An array document for each place and day, whose second array lacks its last three entries."""
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("place"), F.to_date("ts").alias("day"), F.struct("ts", "event_id", "value").alias("x"))
    days = e.groupBy("place", "day").agg(F.array_sort(F.collect_list("x")).alias("x"))
    hourly = F.struct(F.transform("x", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm:ss")).alias("time"), F.transform("x", lambda x: x["value"]).alias("temperature_2m"),
                      F.transform(F.slice("x", F.lit(1), F.greatest(F.size("x") - 3, F.lit(0))), lambda x: x["value"] * 2).alias("precipitation"))
    return N.weather_hours(days.select("place", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload")), "place", "payload")


@query(f"""
WITH h AS (SELECT *, count(*) OVER (PARTITION BY place, CAST(ts AS DATE)) AS n FROM ({_H})) SELECT place, date_trunc('second', ts) AS time, value AS temperature_2m, CASE WHEN i <= n - 3 THEN value * 2 END AS precipitation FROM h""")
def weather_hours(spark, d):
    out = _weather(spark, d)
    return out.select("place", F.col("time").cast("timestamp_ntz").alias("time"), "temperature_2m", "precipitation")


@query("""
WITH w AS (SELECT user_id % 20 AS place, date_trunc('hour', ts) AS hour, max(value) AS t FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT event_id, t AS temperature_2m FROM events e LEFT JOIN w ON w.place = e.user_id % 20 AND w.hour = date_trunc('hour', e.ts) WHERE event_type = 'error'""")
def weather_join(spark, d):
    e = table(spark, d, "events").withColumn("venue", F.col("user_id") % 20)
    hours = e.where("event_type <> 'error'").groupBy(F.col("venue").alias("place"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time")).agg(F.max("value").alias("temperature_2m"))
    return N.weather_at(e.where("event_type = 'error'"), hours, "venue", "ts").select("event_id", "temperature_2m")


def long_quotes(spark, d) -> DataFrame:
    """Line items as quotes: a supplier's price by flag and status, at the day of shipping."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("match_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("bookmaker"), F.col("l_linestatus").alias("selection"), F.col("l_shipdate").alias("quote_time"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("tie"), (1 + F.floor(F.col("l_quantity") / 20)).cast("double").alias("odds"))


QUOTE_KEY = ["match_id", "bookmaker", "selection"]
_LIFE = """WITH q AS (SELECT l_suppkey AS match_id, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS bookmaker, l_linestatus AS selection, l_shipdate AS tm, arg_max(1 + floor(l_quantity / 20), (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS odds FROM lineitem GROUP BY 1, 2, 3, 4),
 n AS (SELECT *, CASE WHEN lag(odds) OVER w = odds THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY match_id, bookmaker, selection ORDER BY tm)), i AS (SELECT *, sum(new) OVER (PARTITION BY match_id, bookmaker, selection ORDER BY tm ROWS UNBOUNDED PRECEDING) AS island FROM n),
 g AS (SELECT match_id, bookmaker, selection, island, min(odds) AS odds, min(tm) AS valid_from, max(tm) AS last_seen, count(*) AS quotes FROM i GROUP BY 1, 2, 3, 4), l AS (SELECT *, lead(valid_from) OVER (PARTITION BY match_id, bookmaker, selection ORDER BY valid_from) AS valid_to FROM g)"""


@query(f"{_LIFE} SELECT match_id, bookmaker, selection, odds, valid_from, valid_to, last_seen, quotes, valid_to IS NULL AS is_current FROM l")
def odds_lifecycle(spark, d):
    """Intervals over half of the days, brought up to date with the others' quotes, of which most come late."""
    q = long_quotes(spark, d)
    early = F.dayofmonth("quote_time") % 2 == 0
    history, new = q.where(early), q.where(~early)
    found = L.intervals(history, QUOTE_KEY, "quote_time", "tie", "odds")
    return L.merged(found, history, new, QUOTE_KEY, "quote_time", "tie", "odds")


@query(f"{_LIFE} SELECT match_id, bookmaker, selection, odds, valid_from, last_seen FROM l WHERE valid_to IS NULL")
def odds_current(spark, d):
    return L.current(L.intervals(long_quotes(spark, d), QUOTE_KEY, "quote_time", "tie", "odds"), QUOTE_KEY, "odds")
