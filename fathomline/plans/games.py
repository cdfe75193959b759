"""Games, bets and quotes derived from the driver's tables, as DataFrames and as SQL, and queries over histories of games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions import scalars as S
from fathomline.operators import history as H
from fathomline.operators import windows as V
from fathomline.plans.registry import OFF_TIES, query
from fathomline.sources import table

GAMES = """SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS day, 'T' || (o_custkey % 40) AS home, 'T' || ((o_custkey % 40 + 1 + o_orderkey % 39) % 40) AS away,
 CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 5 AS INTEGER) END AS home_score, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_custkey + o_orderkey) % 4 AS INTEGER) END AS away_score,
 CASE WHEN o_orderkey % 4 <> 0 THEN CAST((o_custkey * 3 + o_orderkey) % 9 AS INTEGER) END AS home_corners, CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_custkey + o_orderkey * 5) % 8 AS INTEGER) END AS away_corners,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS neutral, o_orderpriority AS tournament FROM orders"""
ROLES = f"""SELECT match_id, day, true AS is_home, home AS team, away AS other_team, home_score AS goals, away_score AS other_goals, home_corners AS corners, away_corners AS other_corners FROM ({GAMES})
 UNION ALL SELECT match_id, day, false, away, home, away_score, home_score, away_corners, home_corners FROM ({GAMES})"""


def team(n: Column) -> Column:
    return F.concat(F.lit("T"), n.cast("string"))


def games(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    played = F.col("o_orderstatus") != "P"
    return table(spark, d, "orders").select(
        k.alias("match_id"), F.to_date("o_orderdate").alias("day"), team(c % 40).alias("home"), team((c % 40 + 1 + k % 39) % 40).alias("away"),
        F.when(played, k % 5).cast("int").alias("home_score"), F.when(played, (c + k) % 4).cast("int").alias("away_score"),
        F.when(k % 4 != 0, (c * 3 + k) % 9).cast("int").alias("home_corners"), F.when(k % 7 != 0, (c + k * 5) % 8).cast("int").alias("away_corners"),
        F.when(k % 6 != 0, k % 3 == 0).alias("neutral"), F.col("o_orderpriority").alias("tournament"))


def roles(spark, d) -> DataFrame:
    pairs = {"team": ("home", "away"), "goals": ("home_score", "away_score"), "corners": ("home_corners", "away_corners")}
    return H.by_role(games(spark, d), ["match_id", "day"], pairs)


def result() -> Column:
    g, o = F.col("goals"), F.col("other_goals")
    return F.when(g > o, "W").when(g < o, "L").when(g == o, "D")


RESULT = "CASE WHEN goals > other_goals THEN 'W' WHEN goals < other_goals THEN 'L' WHEN goals = other_goals THEN 'D' END"


@query(f"SELECT match_id, team, other_team, is_home, goals, other_goals FROM ({ROLES})")
def role_unpivot(spark, d):
    return roles(spark, d).select("match_id", "team", "other_team", "is_home", "goals", "other_goals")


@query(f"""
WITH r AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY team ORDER BY day, match_id), day) AS rest FROM ({ROLES}))
SELECT match_id, CAST(max(rest) FILTER (is_home) AS INTEGER) AS home_rest_days, CAST(max(rest) FILTER (NOT is_home) AS INTEGER) AS away_rest_days FROM r GROUP BY 1""")
def rest_days_both_roles(spark, d):
    return H.to_sides(H.rest_days(roles(spark, d), "team", "day", "match_id"), ["match_id"], ["rest_days"])


@query(f"""
WITH r AS (SELECT *, {RESULT} AS result, row_number() OVER (PARTITION BY team ORDER BY day, match_id) AS i FROM ({ROLES})), f AS (SELECT *, min(i) OVER (PARTITION BY team, day) AS f FROM r),
 h AS (SELECT a.match_id, a.team, b.result AS b_result, b.goals AS b_goals, b.other_goals AS b_other, b.corners AS b_corners, b.i AS b_i, row_number() OVER (PARTITION BY a.match_id, a.team ORDER BY b.i DESC) AS n
  FROM f a JOIN r b ON a.team = b.team AND b.i BETWEEN a.f - 30 AND a.f - 1 AND b.result IS NOT NULL),
 g AS (SELECT match_id, team, count(*) AS n, count(*) FILTER (b_result = 'W') AS w, count(*) FILTER (b_result = 'D') AS dr, count(*) FILTER (b_result = 'L') AS l, avg(b_goals) AS gf, avg(b_other) AS ga, avg(b_corners) AS co,
  list(b_result ORDER BY b_i DESC) AS rs FROM h WHERE n <= 10 GROUP BY 1, 2)
SELECT f.match_id, f.team, CAST(coalesce(n, 0) AS INTEGER) AS form_n, round(w / n, 4) AS form_wins, round(dr / n, 4) AS form_draws, round(l / n, 4) AS form_losses, round((3 * w + dr) / n, 4) AS form_ppg,
 round(gf + 0.000013, 4) AS form_goals, round(ga + 0.000013, 4) AS form_conceded, round(co + 0.000013, 4) AS form_corners,
 CAST(coalesce(CASE rs[1] WHEN 'W' THEN 1 WHEN 'L' THEN -1 ELSE 0 END * coalesce(list_position(list_transform(rs, lambda x: x <> rs[1]), true) - 1, len(rs)), 0) AS INTEGER) AS form_streak
FROM f LEFT JOIN g ON f.match_id = g.match_id AND f.team = g.team""")
def form_both_roles(spark, d):
    rows = roles(spark, d).withColumn("result", result())
    out = H.form(rows, "team", "day", "match_id", "result", {"goals": "goals", "conceded": "other_goals", "corners": "corners"})
    return out.select(
        "match_id", "team", "form_n", *[F.round(c, 4).alias(c) for c in ("form_wins", "form_draws", "form_losses", "form_ppg")],
        *[F.round(F.col(c) + OFF_TIES, 4).alias(c) for c in ("form_goals", "form_conceded", "form_corners")], "form_streak")


_RATINGS = "SELECT 'T' || k AS team, CASE WHEN k % 10 <> 0 THEN k / 40 END AS rating FROM (SELECT CAST(unnest(range(40)) AS BIGINT) AS k)"


@query(f"""
WITH r AS (SELECT * FROM ({ROLES})), e AS (SELECT team, sum(corners) AS s, count(corners) AS c FROM r GROUP BY 1), t AS (SELECT * FROM ({_RATINGS})),
 l AS (SELECT regr_slope(s / c, rating) AS slope, regr_intercept(s / c, rating) AS cut, count(rating) AS n FROM e JOIN t USING (team) WHERE c >= 3), w AS (SELECT coalesce(sum(s) / sum(c), 5.0) AS whole FROM e),
 b AS (SELECT team, CASE WHEN n >= 5 AND rating IS NOT NULL THEN least(greatest(slope * rating + cut, 2.0), 8.0) ELSE whole END AS fallback FROM t, l, w),
 p AS (SELECT a.match_id, a.team, sum(x.corners) AS s, count(x.corners) AS c FROM r a LEFT JOIN r x ON a.team = x.team AND x.day < a.day GROUP BY 1, 2)
SELECT match_id, team, round(CASE WHEN c > 0 THEN s / c ELSE fallback END + 0.000013, 4) AS corners_before FROM p JOIN b USING (team)""")
def corners_prefix_cascade(spark, d):
    rows = roles(spark, d)
    k = F.col("id")
    rated = spark.range(40).select(team(k).alias("team"), F.when(k % 10 != 0, k / 40.0).alias("rating"))
    back = H.line_fallback(rows, "team", "corners", rated, "rating")
    out = V.prefix_mean_before(rows.join(F.broadcast(back), "team"), ["team"], "day", "corners", F.col("fallback"))  # one row a team
    return out.select("match_id", "team", F.round(F.col("past_mean") + OFF_TIES, 4).alias("corners_before"))


_POOLED = """SELECT o_custkey % 100 AS pool, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS seq, o_orderkey % 6 AS h, (o_orderkey % 6 + 1 + o_orderkey % 5) % 6 AS a,
 o_orderkey % 5 AS hs, (o_custkey + o_orderkey) % 4 AS sc, CASE o_orderpriority WHEN '1-URGENT' THEN 60 WHEN '2-HIGH' THEN 20 WHEN '3-MEDIUM' THEN 40 WHEN '4-NOT SPECIFIED' THEN 30 ELSE 60 END AS k,
 CASE WHEN o_orderkey % 6 = 0 THEN true ELSE o_orderkey % 3 = 0 END AS neutral FROM orders"""


@query(f"""
WITH RECURSIVE g AS (SELECT pool, seq, h + 1 AS h, a + 1 AS a, CASE WHEN hs > sc THEN 1.0 WHEN hs = sc THEN 0.5 ELSE 0.0 END::DOUBLE AS w, k * CASE WHEN abs(hs - sc) <= 1 THEN 1.0 WHEN abs(hs - sc) = 2 THEN 1.5 ELSE (11 + abs(hs - sc)) / 8 END::DOUBLE AS kw,
  CASE WHEN neutral THEN 0.0 ELSE 100.0 END::DOUBLE AS edge FROM ({_POOLED})),
 s AS (SELECT DISTINCT pool, CAST(0 AS BIGINT) AS seq, [1500.0, 1510.0, 1520.0, 1530.0, 1540.0, 1550.0]::DOUBLE[] AS r, 0.0::DOUBLE AS hb, 0.0::DOUBLE AS ab, 0.0::DOUBLE AS ch FROM g
  UNION ALL SELECT x.pool, x.seq, list_transform(range(1, 7), lambda i: CASE WHEN i = x.h THEN x.r[i] + x.ch WHEN i = x.a THEN x.r[i] - x.ch ELSE x.r[i] END), x.r[x.h], x.r[x.a], x.ch
   FROM (SELECT g.pool, g.seq, g.h, g.a, s.r, g.kw * (g.w - 1 / (1 + 10 ** ((s.r[g.a] - s.r[g.h] - g.edge) / 400))) AS ch FROM s JOIN g ON g.pool = s.pool AND g.seq = s.seq + 1) x)
SELECT pool, seq, round(hb, 5) AS home_before, round(ab, 5) AS away_before, round(hb + ch, 5) AS home_after, round(ab - ch, 5) AS away_after FROM s WHERE seq > 0""")
def rating_history(spark, d):
    """Ratings in a hundred pools of six players: K by the tournament's name, factor by the margin, home advantage, given first ratings."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = {"1-URGENT": "FIFA World Cup qualification", "2-HIGH": "Friendly", "3-MEDIUM": "UEFA Nations League", "4-NOT SPECIFIED": "Other Cup"}
    tournament = F.coalesce(*[F.when(F.col("o_orderpriority") == p, n) for p, n in names.items()], F.lit("Copa América"))
    hs, sc = k % 5, (c + k) % 4
    h, a = k % 6, (k % 6 + 1 + k % 5) % 6
    rows = table(spark, d, "orders").select(
        (c % 100).alias("pool"), F.row_number().over(W.partitionBy(c % 100).orderBy(F.to_date("o_orderdate"), k)).alias("seq"), h.cast("string").alias("home"), a.cast("string").alias("away"),
        F.when(hs > sc, 1.0).when(hs == sc, 0.5).otherwise(0.0).alias("score"), (H.k_factor(tournament) * H.margin_factor(hs, sc)).alias("weight"), F.when(k % 6 != 0, k % 3 == 0).alias("neutral"),
        (1500.0 + 10 * h).alias("home_start"), (1500.0 + 10 * a).alias("away_start"))
    out = V.rating_fold(rows, "pool")
    return out.select("pool", "seq", *[F.round(x, 5).alias(x) for x in ("home_before", "away_before", "home_after", "away_after")])


@query(f"""
WITH r AS (SELECT *, CASE WHEN goals > other_goals THEN 3 WHEN goals = other_goals THEN 1 ELSE 0 END AS points FROM ({ROLES}) WHERE goals IS NOT NULL), s AS (SELECT 'T' || k AS other_team, (k % 10) / 9 AS f FROM (SELECT CAST(unnest(range(36)) AS BIGINT) AS k)),
 m AS (SELECT r.*, f, coalesce(f, 0) >= 0.9 AS strong FROM r LEFT JOIN s USING (other_team)), c AS (SELECT *, count(*) FILTER (strong) OVER (PARTITION BY team) AS k FROM m),
 l AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day DESC, match_id DESC) AS n FROM c WHERE k < 5 OR strong)
SELECT team, round(coalesce(sum(points * coalesce(f, 0.5)) / nullif(3.0 * sum(coalesce(f, 0.5)), 0), 0.5), 6) AS run, count(*) AS games FROM l WHERE n <= 10 GROUP BY 1""")
def weighted_run(spark, d):
    rows = roles(spark, d).where("goals IS NOT NULL").withColumn("points", F.when(F.col("goals") > F.col("other_goals"), 3).when(F.col("goals") == F.col("other_goals"), 1).otherwise(0))
    known = spark.range(36).select(team(F.col("id")).alias("team"), ((F.col("id") % 10) / 9.0).alias("strength"))
    return H.weighted_run(rows, "team", "other_team", "day", "match_id", "points", known, 0.9).select("team", F.round("run", 6).alias("run"), "games")


_TABLE = f"""SELECT CAST(substr(team, 2) AS INTEGER) % 8 AS grp, team, CAST(sum(CASE WHEN goals > other_goals THEN 3 WHEN goals = other_goals THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(goals - other_goals) AS BIGINT) AS difference, CAST(sum(goals) AS BIGINT) AS goals
 FROM ({ROLES}) WHERE goals IS NOT NULL GROUP BY 1, 2"""


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY points DESC, difference DESC, goals DESC, team) AS INTEGER) AS place FROM ({_TABLE})")
def group_standings(spark, d):
    rows = roles(spark, d).withColumn("grp", F.substring("team", 2, 9).cast("int") % 8)
    return H.standings(rows, "grp", "team")


@query(f"SELECT team, points, difference, goals FROM ({_TABLE}) ORDER BY points DESC, difference DESC, goals DESC, team LIMIT 8")
def best_eight(spark, d):
    rows = roles(spark, d).withColumn("grp", F.substring("team", 2, 9).cast("int") % 8)
    ordered = H.standings(rows, "grp", "team").orderBy(F.desc_nulls_last("points"), F.desc_nulls_last("difference"), F.desc_nulls_last("goals"), F.asc_nulls_last("team"))
    return ordered.limit(8).select("team", "points", "difference", "goals")


@query(f"SELECT team, round(avg(goals), 6) AS attack, round(avg(other_goals), 6) AS defence, round((SELECT avg(goals) FROM ({ROLES})), 6) AS overall FROM ({ROLES}) GROUP BY 1")
def team_strengths(spark, d):
    return H.strengths(roles(spark, d), "team", "goals", "other_goals").select("team", *[F.round(c, 6).alias(c) for c in ("attack", "defence", "overall")])


@query("""
WITH c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS elo, ln(1 + sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END)) AS value, avg(c_custkey % 7) AS run FROM customer GROUP BY 1), e AS (SELECT k, CASE WHEN k % 9 <> 0 THEN elo END AS elo, value, run FROM c),
 m AS (SELECT min(elo) AS e0, max(elo) AS e1, avg(elo) AS em, min(value) AS v0, max(value) AS v1, min(run) AS r0, max(run) AS r1 FROM e),
 n AS (SELECT k, (coalesce(elo, em) - e0) / (e1 - e0) AS elo_norm, (value - v0) / (v1 - v0) AS value_norm, (run - r0) / (r1 - r0) AS run_norm FROM e, m), w AS (SELECT *, 0.2 * elo_norm + 0.6 * value_norm + 0.2 * run_norm AS raw FROM n)
SELECT k, round(elo_norm, 6) AS elo_norm, round(value_norm, 6) AS value_norm, round(run_norm, 6) AS run_norm, round(100 * (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 2) AS rating FROM w""")
def composite_rating(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.avg("c_acctbal").alias("elo"), F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0)).alias("value"), F.avg(F.col("c_custkey") % 7).alias("run"))
    out = H.composite(c, {"elo": (F.when(F.col("k") % 9 != 0, F.col("elo")), 0.2), "value": (F.log1p("value"), 0.6), "run": (F.col("run"), 0.2)})
    return out.select("k", *[F.round(f"{n}_norm", 6).alias(f"{n}_norm") for n in ("elo", "value", "run")], "rating")


@query(f"""
WITH g AS (SELECT *, coalesce(neutral, false) AS is_neutral, CASE WHEN match_id % 11 = 0 THEN home WHEN match_id % 13 = 0 THEN away END AS host, CASE WHEN CAST(substr(home, 2) AS INTEGER) < 30 THEN 'G' || (CAST(substr(home, 2) AS INTEGER) % 4) ELSE 'OTHER' END AS hg,
 CASE WHEN CAST(substr(away, 2) AS INTEGER) < 30 THEN 'G' || (CAST(substr(away, 2) AS INTEGER) % 4) ELSE 'OTHER' END AS ag FROM ({GAMES}))
SELECT match_id, is_neutral, CAST(CASE WHEN NOT is_neutral THEN 1.0 WHEN host = home THEN 0.5 WHEN host = away THEN -0.5 ELSE 0.0 END AS DOUBLE) AS host_advantage, hg = ag AS same_group FROM g""")
def game_context(spark, d):
    g = games(spark, d).withColumn("host", F.when(F.col("match_id") % 11 == 0, F.col("home")).when(F.col("match_id") % 13 == 0, F.col("away")))
    groups = spark.range(30).select(team(F.col("id")).alias("team"), F.concat(F.lit("G"), (F.col("id") % 4).cast("string")).alias("grp"))
    return H.context(g, "home", "away", "neutral", F.col("host"), groups).select("match_id", "is_neutral", "host_advantage", "same_group")


@query(f"""
SELECT match_id, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' WHEN home_score = away_score THEN 'D' END AS result, home_score + away_score > 2.5 AS over25, home_score > 0 AND away_score > 0 AS both_scored, home_score + away_score AS goals FROM ({GAMES})""")
def game_targets(spark, d):
    return games(spark, d).select("match_id", *[c.alias(n) for n, c in H.targets(F.col("home_score"), F.col("away_score")).items()])


@query(f"""
SELECT part, count(*) AS n, count(*) FILTER (missing) AS missing FROM (SELECT CASE WHEN year(day) < 1997 THEN 'train' WHEN year(day) < 2000 THEN 'val' ELSE 'later' END AS part, home_score IS NULL AND home_corners IS NULL AS missing FROM ({GAMES})) GROUP BY 1
 UNION ALL SELECT 'latest:' || part, count(*), 0 FROM (SELECT CASE WHEN year(day) = (SELECT max(year(day)) FROM ({GAMES}) WHERE home_corners IS NOT NULL) THEN 'val' ELSE 'train' END AS part FROM ({GAMES}) WHERE home_corners IS NOT NULL) GROUP BY 1""")
def temporal_splits(spark, d):
    from fathomline.operators import rules as R

    g = games(spark, d).withColumn("missing", R.placeholder(["home_score", "home_corners"]))
    a = R.temporal_split(g, "day", 1997, 2000).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("missing"), 1)).alias("missing"))
    b = R.latest_year_split(g, "day", "home_corners").groupBy(F.concat(F.lit("latest:"), "part").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("missing"))
    return a.union(b)


@query(f"""
WITH q AS (SELECT o_orderkey AS id, o_custkey % 50 AS k, o_orderpriority AS book, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS tm FROM orders),
 w AS (SELECT *, row_number() OVER (PARTITION BY k, book, tm IS NOT NULL ORDER BY tm, id) AS f, row_number() OVER (PARTITION BY k, book, tm IS NOT NULL ORDER BY tm DESC, id) AS l FROM q)
SELECT id, tm IS NOT NULL AND f = 1 AS is_opening, tm IS NOT NULL AND l = 1 AS is_closing FROM w""")
def quote_flags(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("k"), F.col("o_orderpriority").alias("book"), F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")).alias("at"))
    return V.quote_flags(o, ["k", "book"], "at", "id").select("id", "is_opening", "is_closing")


_STARTS = "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS m, least(greatest(l_quantity / 50, 0.02), 0.95) AS q FROM lineitem"


@query(f"""
WITH a AS (SELECT *, least(greatest(q * 1.5 / sum(q) OVER w, 0.01), 0.98) AS x FROM ({_STARTS}) WINDOW w AS (PARTITION BY k)), b AS (SELECT *, least(greatest(x * 1.5 / sum(x) OVER w, 0.01), 0.98) AS y FROM a WINDOW w AS (PARTITION BY k)),
 c AS (SELECT *, coalesce(sum(m) FILTER (n = 1) OVER w, 0) AS held, coalesce(sum(m) FILTER (n <> 1) OVER w, 0) AS free, sum(m) OVER w AS every FROM b WINDOW w AS (PARTITION BY k))
SELECT k, n, p, s, m, round(y + 0.000013, 4) AS start_prob, round(CASE WHEN held >= 90 THEN m * 90 / every WHEN n <> 1 AND free > 0 THEN m * (90 - held) / free ELSE m END + 0.000013, 4) AS minutes FROM c""")
def rescale_twice_and_fill(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("m"), S.clip(F.col("l_quantity") / 50, 0.02, 0.95).alias("q"))
    out = V.fill_to(V.rescale_to(li, ["k"], "q", 1.5, 0.98, 0.01, passes=2), ["k"], "m", F.col("n") == 1, 90.0)
    return out.select("k", "n", "p", "s", "m", F.round(F.col("rescaled") + OFF_TIES, 4).alias("start_prob"), F.round(F.col("filled") + OFF_TIES, 4).alias("minutes"))


@query(f"""
WITH g AS (SELECT home, away, home_score, away_score, false AS flipped FROM ({GAMES}) UNION ALL SELECT away, home, away_score, home_score, true FROM ({GAMES}))
SELECT home AS team, count(*) AS games, CAST(sum(home_score) AS BIGINT) AS scored, CAST(sum(away_score) AS BIGINT) AS conceded, count(*) FILTER (flipped) AS away_games FROM g GROUP BY 1""")
def oriented_games(spark, d):
    from fathomline.operators import joins as J

    g = J.oriented(games(spark, d).select("home", "away", "home_score", "away_score"), "home", "away", {"home_score": "away_score"})
    return g.groupBy(F.col("home").alias("team")).agg(F.count(F.lit(1)).alias("games"), F.sum("home_score").alias("scored"), F.sum("away_score").alias("conceded"), F.count(F.when(F.col("flipped"), 1)).alias("away_games"))
