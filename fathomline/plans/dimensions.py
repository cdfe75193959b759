"""Readers and writers by round trip, dimensions, masters, manual values and column aliases as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline import sources as R
from fathomline.functions import minutes as T
from fathomline.functions import names as M
from fathomline.operators import master as P
from fathomline.operators import matching as K
from fathomline.plans.registry import query
from fathomline.sources import dimensions as D
from fathomline.sources import feeds as N
from fathomline.sources import schemas as C
from fathomline.sources import table


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer")
def csv_round_trip(spark, d):
    """Written as CSV with a header, read back under a schema, four of five columns; an empty field is a null number."""
    path = R.scratch(spark, "csv")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    R.write_csv(c, path)
    return R.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS s_nationkey FROM supplier")
def strings_round_trip(spark, d):
    """Read back as trimmed strings, "" for what is missing."""
    path = R.scratch(spark, "strings")
    R.write_csv(table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" "), "s_name", F.lit("  ")).alias("s_name"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey")).alias("s_nationkey")), path)
    return R.read_strings(spark, path, ["s_suppkey", "s_name", "s_nationkey"])


@query("SELECT event_type, event_id, user_id, value FROM events")
def tree_round_trip(spark, d):
    """Written as a tree of Parquet by event type, some of it twice, and read back once with names in snake case."""
    path = R.scratch(spark, "tree")
    e = table(spark, d, "events").select(F.col("event_id").alias("eventId"), F.col("user_id").alias("User-ID"), "value", F.col("event_type").alias("eventType"))
    R.write_parquet(e.union(e), path, ["eventType"])
    return R.read_parquet_tree(spark, path).select("event_type", "event_id", "user_id", "value")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_round_trip(spark, d):
    """A nested JSON document for each user, read back and flattened."""
    path = R.scratch(spark, "json")
    table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "value")).alias("events")).write.json(path)
    back = R.read_json(spark, f"{path}/*.json", "user_id long, events array<struct<event_id:long,value:double>>", lines=True)
    return back.select("user_id", F.size("events").cast("long").alias("n"), F.round(F.aggregate("events", F.lit(0.0), lambda s, e: s + e.value), 4).alias("total"))


@query("""
SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'manual:venue:' || lower(replace(n_name, '_', '-')) ELSE 'manual:venue:' || n_nationkey END AS venue_id, n_name AS venue_name, CAST(n_regionkey * 1.5 AS DOUBLE) AS latitude, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) END AS longitude,
 CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 ELSE n_nationkey % 7 IN (1, 2, 3) END AS indoor, CAST(NULL AS VARCHAR) AS surface FROM nation""")
def dim_venues(spark, d):
    k = F.col("n_nationkey")
    roof = F.when(k % 7 == 1, " Fixed").when(k % 7 == 2, "retractable").when(k % 7 == 3, "CLOSED ").when(k % 7 == 4, "open")
    raw = table(spark, d, "nation").select(
        F.when(k % 5 != 0, k).alias("venue_id"), F.concat(F.lit(" "), "n_name").alias("stadium_name"), (F.col("n_regionkey") * 1.5).alias("lat"), F.when(k % 4 == 0, "unknown").otherwise(k.cast("string")).alias("lon"), F.when(k % 3 == 0, F.when(k % 2 == 0, "Yes").otherwise("no")).alias("indoor"), roof.alias("roof_type"))
    return D.venues(raw).select("venue_id", "venue_name", "latitude", "longitude", "indoor", "surface")


@query("""
SELECT 'manual:team:' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE lower(replace(s_name, '#', '-')) END AS team_id, s_name AS team_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Cup' ELSE 'World' END AS tournament, 'H' || s_nationkey AS accommodation, CAST(s_acctbal AS DOUBLE) AS altitude_m FROM supplier WHERE s_suppkey % 10 <> 7""")
def dim_base_camps(spark, d):
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select(
        F.when(k % 2 == 0, k).alias("team_id"), F.when(k % 10 == 7, " ").otherwise(F.col("s_name")).alias("team"), F.when(k % 3 == 0, "Cup").alias("tournament"), F.concat(F.lit("H"), F.col("s_nationkey").cast("string")).alias("hotel"), F.col("s_acctbal").alias("altitude_m"))
    return D.base_camps(raw, tournament="World").select("team_id", "team_name", "tournament", "accommodation", "altitude_m")


@query("""
SELECT 'manual:referee:' || c_custkey AS referee_id, c_name AS referee_name, 'All' AS tournament, CAST(c_nationkey AS DOUBLE) AS matches, round(CASE WHEN c_custkey % 2 = 0 THEN 4.5 WHEN c_nationkey = 0 THEN NULL ELSE c_custkey % 50 / c_nationkey END, 6) AS yellow_per_match, CAST(NULL AS DOUBLE) AS red_per_match FROM customer""")
def dim_referees(spark, d):
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(k.alias("referee_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("matches_officiated"), (k % 50).alias("yellow_cards"), F.when(k % 2 == 0, 4.5).alias("yellow_per_match"))
    return D.referees(raw).select("referee_id", "referee_name", "tournament", "matches", F.round("yellow_per_match", 6).alias("yellow_per_match"), "red_per_match")


_GAMES = """SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS day FROM orders"""


@query(f"""
SELECT 'manual:match:' || k AS match_id, 'Cup' AS competition, '2026' AS season, 'Group Stage' AS stage, s AS "group", day AS match_date, 'manual:team:t' || c AS home_team_id, 'manual:team:' || (c + 1) AS away_team_id, CASE WHEN k % 4 <> 0 THEN 'manual:venue:' || (k % 16) END AS venue_id, k % 3 <> 1 AS neutral, CAST(k % 5 AS DOUBLE) AS home_score FROM ({_GAMES}) WHERE k % 11 <> 0
UNION ALL SELECT 'manual:match:' || k, 'Cup', '2026', s, NULL, day, 'manual:slot:W' || k, 'manual:slot:R' || c, 'manual:venue:' || (k % 16), true, NULL FROM ({_GAMES}) WHERE k % 11 = 0""")
def dim_fixtures(spark, d):
    """Group games, and knockout games between slots, under one set of columns."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders")
    shown = ["match_id", "competition", "season", "stage", "group", "match_date", "home_team_id", "away_team_id", "venue_id", "neutral", "home_score"]
    groups = o.select(
        F.when(k % 11 != 0, k).alias("match_number"), F.col("o_orderstatus").alias("group"), F.col("o_orderdate").alias("match_date"), F.concat(F.lit(" T"), c.cast("string")).alias("home_team"), F.lit("x").alias("away_team"), (c + 1).alias("away_team_id"),
        F.when(k % 4 != 0, k % 16).alias("venue_id"), F.when(k % 3 == 1, "no").when(k % 3 == 2, "yes").alias("neutral"), (k % 5).alias("home_score"))
    slots = o.select(
        F.when(k % 11 == 0, k).alias("match_number"), F.col("o_orderstatus").alias("stage"), F.lit("ignored").alias("group"), F.col("o_orderdate").alias("match_date"), F.concat(F.lit("W"), k.cast("string")).alias("home_slot"), F.concat(F.lit("R"), c.cast("string")).alias("away_slot"), (k % 16).alias("venue_id"))
    return D.fixtures(groups, competition="Cup", season="2026").select(*shown).unionByName(D.fixtures(slots, competition="Cup", season="2026", knockout=True).select(*shown))


@query("""
SELECT 'manual:team:' || lower(replace(c_name, '#', '-')) AS team_id, c_name AS team_name, DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS rating_date, 'elo' AS source, c_acctbal AS elo_rating, CAST(c_nationkey AS DOUBLE) AS one_year_change FROM customer WHERE c_custkey % 9 <> 0""")
def dim_ratings(spark, d):
    k = F.col("c_custkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).cast("string")
    raw = table(spark, d, "customer").select(F.col("c_name").alias("team"), F.when(k % 9 != 0, day).alias("date"), F.col("c_acctbal").alias("rating"), F.col("c_nationkey").alias("1_year_change"))
    return D.team_ratings(raw, "elo").select("team_id", "team_name", "rating_date", "source", "elo_rating", "one_year_change")


@query("""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_custkey % 10 = 0) AS nulls FROM orders), r AS (SELECT coalesce(sum(n) FILTER (n > 1), 0) AS again FROM (SELECT count(*) AS n FROM orders GROUP BY CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END, o_orderstatus))
SELECT 'matches' AS "column", 'type' AS fault, 'double' AS wanted, 'bigint' AS found UNION ALL SELECT 'referee_name', 'missing', 'string', NULL UNION ALL SELECT 'yellow_per_match', 'missing', 'double', NULL UNION ALL SELECT 'red_per_match', 'missing', 'double', NULL
 UNION ALL SELECT 'o_totalprice', 'extra', NULL, 'double' UNION ALL SELECT 'referee_id', 'null key', '0', CAST(nulls AS VARCHAR) FROM c WHERE nulls > 0 UNION ALL SELECT 'referee_id,tournament', 'repeated key', '0', CAST(CAST(again AS BIGINT) AS VARCHAR) FROM r WHERE again > 0""")
def schema_faults(spark, d):
    """Orders held against the table of referees: columns, types and keys."""
    k = F.col("o_custkey")
    o = table(spark, d, "orders").select(F.when(k % 10 != 0, k.cast("string")).alias("referee_id"), F.col("o_orderstatus").alias("tournament"), k.alias("matches"), "o_totalprice")
    return C.faults(o, "referees")


def squads(spark, d):
    """Customers as squads: the nation is the team, the segment the club; every name is shared by a few."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), F.concat(F.lit("Team "), F.col("c_nationkey").cast("string")).alias("team"), F.concat(F.lit("Player "), (k % 700).cast("string")).alias("name"), F.initcap("c_mktsegment").alias("club"), F.when(k % 3 == 0, "GK").otherwise("").alias("position"))


_SQUADS = "SELECT c_custkey AS k, 'team_' || c_nationkey AS team_id, 'Team ' || c_nationkey AS team, 'Player ' || (c_custkey % 700) AS name, 'player ' || (c_custkey % 700) AS name_normalized, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS club, lower(c_mktsegment) AS club_normalized, CASE WHEN c_custkey % 3 = 0 THEN 'GK' ELSE '' END AS position FROM customer"
_MASTER = f"SELECT *, CASE WHEN n > 1 THEN key || '_' || club_normalized || CASE WHEN position = '' THEN '' ELSE '_gk' END || '_' || i ELSE key END AS player_key FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY k) AS i FROM (SELECT *, team_id || '_' || replace(name_normalized, ' ', '_') AS key FROM ({_SQUADS})))"


@query(f"SELECT player_key, team_id, team, name, name_normalized, club, club_normalized, position FROM ({_MASTER})")
def players_master(spark, d):
    return P.players_master(squads(spark, d), "k")


@query(f"""WITH m AS ({_MASTER}), t AS (SELECT count(*) AS teams, count(*) FILTER (n <> 26) AS odd_teams FROM (SELECT team, count(*) AS n FROM m GROUP BY 1))
SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS empty_keys, CAST(0 AS BIGINT) AS empty_names, count(*) - count(DISTINCT player_key) AS duplicate_keys, any_value(teams) AS teams, any_value(odd_teams) AS odd_teams FROM m, t""")
def players_master_report(spark, d):
    return P.master_report(P.players_master(squads(spark, d), "k"))


@query(f"""
WITH m AS ({_MASTER}), b AS (SELECT lower(s_name) AS n, s_suppkey FROM supplier), one AS (SELECT team_id AS x, min(player_key) AS player_key FROM m GROUP BY 1)
SELECT player_key, 'registry' AS source, CASE WHEN CAST(regexp_extract(team_id, '[0-9]+') AS INTEGER) % 2 = 0 THEN player_key END AS source_id, CASE WHEN CAST(regexp_extract(team_id, '[0-9]+') AS INTEGER) % 2 = 0 THEN 1.0 ELSE 0.0 END AS confidence,
 CASE WHEN CAST(regexp_extract(team_id, '[0-9]+') AS INTEGER) % 2 = 0 THEN 'exact_name_club' ELSE 'unmatched' END AS method, CAST(regexp_extract(team_id, '[0-9]+') AS INTEGER) % 2 <> 0 AS needs_review FROM m""")
def players_bridge(spark, d):
    """Players in a registry that has those of every other team, under their keys."""
    m = P.players_master(squads(spark, d), "k")
    even = F.regexp_extract("team_id", "[0-9]+", 0).cast("int") % 2 == 0
    sides = m.select("player_key", F.when(even, M.identity_key(F.col("player_key"))).otherwise("").alias("key"), F.col("club_normalized").alias("club"), F.col("team").alias("country"), F.lit("x").alias("position"))
    return P.source_bridge(m, {"registry": K.best_match(sides, sides.where("key <> ''").withColumnRenamed("player_key", "source_id"), "player_key", "source_id")})


@query("""
WITH a AS (SELECT c_custkey AS k, c_custkey % 9 * 10.0 AS expected_minutes, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 7 / 10 END AS start_probability FROM customer), m AS (SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 1 THEN 'confirmed_starter' WHEN 3 THEN 'nonsense' END AS status, CASE WHEN c_custkey % 8 <> 5 THEN c_custkey % 90 + 1.0 END AS mins FROM customer WHERE c_custkey % 2 = 1)
SELECT a.k, coalesce(m.mins, a.expected_minutes) AS expected_minutes, m.k IS NOT NULL AS is_manual FROM a LEFT JOIN m ON m.k = a.k""")
def minutes_overlaid(spark, d):
    """Manual minutes over automatic ones, the last of two manual rows."""
    k = F.col("c_custkey")
    auto = table(spark, d, "customer").select(k.alias("k"), (k % 9 * 10.0).alias("expected_minutes"), F.when(k % 4 != 0, k % 7 / 10).alias("start_probability"))
    once = table(spark, d, "customer").where(k % 2 == 1).select(
        k.alias("k"), F.lit(2).alias("seq"), F.when(k % 8 == 1, "confirmed_starter").when(k % 8 == 3, "nonsense").alias("lineup_status"), F.when(k % 8 != 5, k % 90 + 1.0).alias("expected_minutes"), F.lit(None).cast("double").alias("start_probability"))
    manual = once.union(once.withColumn("seq", F.lit(1)).withColumn("expected_minutes", F.lit(1.0)))
    return T.overlaid(auto, manual, ["k"], "seq", ["expected_minutes", "start_probability"]).select("k", "expected_minutes", "is_manual")


@query("SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS club, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def column_aliases(spark, d):
    """Columns by whichever of their names the table has."""
    raw = table(spark, d, "supplier").select(F.col("s_suppkey").alias("PLAYER_ID"), F.col("s_name").alias("Pretty_Name"), F.col("s_nationkey").cast("string").alias("citizenship"))
    return M.aliased(raw, {"id": ["player_id"], "name": ["player_name", "pretty_name"], "club": ["club_name"], "nation": ["nationality", "citizenship"]})


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'short ' || split_part(lower(p_name), ' ', 2) WHEN 2 THEN lower(p_name) WHEN 3 THEN lower(p_name) ELSE 'fc' END AS key FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'Long ' || split_part(p_name, ' ', 2) ELSE p_name END AS p_name FROM part)""")
def club_keys(spark, d):
    """Club names with tags, ordinals, company words and an alias, by key."""
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    name = F.when(k == 0, F.concat(n, F.lit(" FC (ENG)"))).when(k == 1, F.concat(F.lit("Long Winded "), F.element_at(F.split(n, " "), 2))).when(k == 2, F.concat(F.lit("1. "), n, F.lit("-GER"))).when(k == 3, F.concat(F.lit("Club "), F.upper(n), F.lit(" (Alemania)"))).otherwise("FC")
    return table(spark, d, "part").select("p_partkey", M.club_key(name, {"long winded": "short"}).alias("key"))


@query("""
WITH r AS (SELECT event_id // 30 AS match_id, user_id AS player, 'T' || (user_id % 4) AS team, CASE WHEN event_type = 'view' THEN 'yes' ELSE 'no' END AS starter, event_type AS position, value AS minute_on, event_id AS seq FROM events)
SELECT match_id, team, player, starter = 'yes' AS is_starter, position, CASE WHEN starter = 'yes' THEN 0.0 ELSE minute_on END AS minute_on FROM r""")
def lineups(spark, d):
    r = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 30).alias("match_id"), F.concat(F.lit("T"), (F.col("user_id") % 4).cast("string")).alias("team"), F.col("user_id").alias("player"), F.lit("n").alias("name"), F.col("event_type").alias("position"), F.when(F.col("event_type") == "view", "Yes ").otherwise("no").alias("starter"),
        F.col("value").alias("minute_on"), F.col("event_id").alias("seq"))
    return N.lineup_rows(r)[1]
