"""Every operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.functions import scalars as S
from fathomline.operators import aggregates as A
from fathomline.operators import joins as J
from fathomline.operators import windows as V
from fathomline.plans.registry import OFF_TIES, query
from fathomline.sources import table

def r4(c: str):
    return F.round(c, 4).alias(c)


@query("""
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total,
 round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, bool_or(o_orderstatus = 'P') AS any_pending
FROM orders GROUP BY 1""")
def multi_agg(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"))


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, 1 + l_quantity / 10 AS odds FROM lineitem), i AS (SELECT *, CASE WHEN odds > 1 THEN 1 / odds END AS implied FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, round(implied, 6) AS implied, round(implied / sum(implied) OVER (PARTITION BY l_orderkey) + 0.000013, 4) AS no_vig, round(sum(implied) OVER (PARTITION BY l_orderkey) - 1 + 0.000013, 4) AS overround FROM i""")
def novig_share(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (1 + F.col("l_quantity") / 10).alias("odds"))
    out = A.no_vig(df, ["l_orderkey"], "odds")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("implied", 6).alias("implied"), *[F.round(F.col(c) + OFF_TIES, 4).alias(c) for c in ("no_vig", "overround")])


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_per_key(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return V.best_per_key(df, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_per_key(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return V.latest_per_key(df, ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("""
SELECT l_linestatus, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0.0), 2) AS "A", round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0.0), 2) AS "N",
 round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0.0), 2) AS "R" FROM lineitem GROUP BY 1""")
def pivot_side(spark, d):
    out = A.pivot_sum(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag", ["A", "N", "R"], "l_quantity")
    return out.select("l_linestatus", *[F.round(c, 2).alias(c) for c in ("A", "N", "R")])


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) AS total, count(DISTINCT o_custkey) AS distinct_o_custkey FROM orders GROUP BY 1""")
def pivot_count_fill(spark, d):
    return A.pivot_count(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "o_custkey")


_OPEN_CLOSE = """SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS opening, arg_max(value, (ts, event_id)) AS closing, count(*) AS quotes FROM events GROUP BY 1, 2"""


def _open_close(spark, d):
    return V.open_close(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", "value")


@query(_OPEN_CLOSE)
def open_close(spark, d):
    return _open_close(spark, d)


@query(f"""SELECT user_id, event_type, round(CASE WHEN closing <> 0 THEN opening / closing - 1 END, 4) AS clv FROM ({_OPEN_CLOSE}) WHERE quotes > 1""")
def clv(spark, d):
    df = _open_close(spark, d).where("quotes > 1")
    return df.select("user_id", "event_type", F.round(F.when(F.col("closing") != 0, F.col("opening") / F.col("closing") - 1), 4).alias("clv"))


@query("""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
 f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS first FROM v GROUP BY 1),
 last AS (SELECT p.event_id, arg_max(v.value, (v.ts, v.event_id)) AS value, count(v.event_id) AS n FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts < p.ts GROUP BY 1)
SELECT p.event_id, p.user_id, CASE WHEN last.n > 0 THEN last.value ELSE f.first END AS value_before FROM p JOIN last USING (event_id) LEFT JOIN f ON f.user_id = p.user_id""")
def asof_strict(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return J.asof_before(left, e.where("event_type = 'view'").drop("event_type"), ["user_id"], "ts", "event_id", "value").select("event_id", "user_id", "value_before")


@query("""
WITH j AS (SELECT o_orderkey, l_linenumber, l_partkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS day_step
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey), k AS (SELECT *, CASE day_step WHEN 0 THEN 0 WHEN -1 THEN 1 WHEN 1 THEN 2 END AS turn FROM j WHERE day_step BETWEEN -1 AND 1)
SELECT o_orderkey, l_linenumber, l_partkey, CAST(day_step AS INTEGER) AS day_step FROM (SELECT *, min(turn) OVER (PARTITION BY o_orderkey) AS best FROM k) WHERE turn = best""")
def tolerance_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("key"), "o_orderdate")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_shipdate")
    found = J.tolerance_join(o, li, ["key"], "o_orderdate", "l_shipdate")
    best = found.withColumn("best", F.min("turn").over(W.partitionBy("o_orderkey"))).where("turn = best")
    return best.select("o_orderkey", "l_linenumber", "l_partkey", "day_step")


@query("""
WITH c AS (SELECT c_nationkey AS a, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS b, count(*) AS m FROM supplier GROUP BY 1),
 f AS (SELECT least(a, b) AS one, greatest(a, b) AS two, n * m AS flow FROM c, s)
SELECT one, two, CAST(sum(flow) AS BIGINT) AS flow FROM f GROUP BY 1, 2""")
def pair_key_join(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    one, two = J.pair_key("a", "b")
    flows = c.crossJoin(F.broadcast(s))  # one row for each nation
    return flows.groupBy(one.alias("one"), two.alias("two")).agg(F.sum(F.col("n") * F.col("m")).alias("flow"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def anti_review(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_ids(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query("""
WITH p AS (SELECT p_brand, CASE WHEN p_size > 10 THEN p_size END AS size FROM part), l AS (SELECT p_brand, size, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT size, count(*) AS m FROM p GROUP BY ALL)
SELECT p_brand, l.size, n, m FROM l JOIN r ON l.size IS NOT DISTINCT FROM r.size""")
def null_safe_join(spark, d):
    p = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"))
    left = p.groupBy("p_brand", "size").agg(F.count(F.lit(1)).alias("n"))
    right = p.groupBy(F.col("size").alias("size2")).agg(F.count(F.lit(1)).alias("m"))
    return left.join(right, F.col("size").eqNullSafe(F.col("size2"))).select("p_brand", "size", "n", "m")


@query("""
WITH a AS (SELECT 2 * l_partkey AS key, count(*) AS sold FROM lineitem GROUP BY 1), b AS (SELECT 3 * l_suppkey AS key, max(l_discount) AS best FROM lineitem GROUP BY 1), c AS (SELECT p_partkey AS key, p_size AS size FROM part)
SELECT key, sold, best, size FROM a FULL JOIN b USING (key) FULL JOIN c USING (key)""")
def outer_fold(spark, d):
    li = table(spark, d, "lineitem")
    a = li.groupBy((2 * F.col("l_partkey")).alias("key")).agg(F.count(F.lit(1)).alias("sold"))
    b = li.groupBy((3 * F.col("l_suppkey")).alias("key")).agg(F.max("l_discount").alias("best"))
    c = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    return A.outer_fold([a, b, c], ["key"])


@query("""
SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS lines, round(sum(l_extendedprice), 2) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""")
def role_playing(spark, d):
    n = table(spark, d, "nation")
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    keyed = li.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").groupBy("c_nationkey", "s_nationkey").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return keyed.join(cn, "c_nationkey").join(sn, "s_nationkey").select("customer_nation", "supplier_nation", "lines", "value")


@query("""
WITH e AS (SELECT p_name, p_brand, min(p_partkey) AS k FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2), u AS (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1 HAVING count(*) = 1)
SELECT p.p_partkey, coalesce(e.k, u.k) AS matched, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN u.k IS NOT NULL THEN 'name' ELSE 'none' END AS method
FROM part p LEFT JOIN e ON p.p_name = e.p_name AND p.p_brand = e.p_brand LEFT JOIN u ON p.p_name = u.p_name""")
def unique_name_match(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_partkey % 3 <> 0").select("p_name", "p_brand", F.col("p_partkey").alias("key"))
    return J.unique_name_match(p.select("p_partkey", "p_name", "p_brand"), known, ["p_name", "p_brand"], "p_name", "key").select("p_partkey", "matched", "method")


_BANDS = [(a, b, round(0.02 * a, 2), round(0.02 * (a + 1), 2), round(0.02 * b, 2)) for a in range(8) for b in range(4)]


@query(f"""
WITH g AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}, {lo:.2f}, {hi:.2f}, {tax:.2f})" for a, b, lo, hi, tax in _BANDS)}) t(a, b, lo, hi, tax))
SELECT g.a, g.b, count(l_orderkey) AS bets, round(sum(l_quantity), 2) AS stake, round(100.0 * count(*) FILTER (l_returnflag = 'R') / nullif(count(l_orderkey), 0), 4) AS hit_rate
FROM g LEFT JOIN lineitem ON l_discount >= lo AND l_discount < hi AND l_tax >= tax AND l_tax < 9 GROUP BY 1, 2""")
def grid_strategy(spark, d):
    li = table(spark, d, "lineitem").select("l_discount", "l_tax", "l_quantity", "l_returnflag")
    limits = {"l_discount": [(lo, hi) for _, _, lo, hi, _ in _BANDS], "l_tax": [(tax, 9.0) for *_, tax in _BANDS]}
    sums = {"n": F.lit(1), "s": F.col("l_quantity"), "h": F.when(F.col("l_returnflag") == "R", 1).otherwise(0)}
    out = J.strategy_grid(li, [(a, b) for a, b, *_ in _BANDS], ["a", "b"], limits, sums, upper_open=True)
    return out.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.coalesce("n", F.lit(0)).alias("bets"), F.round("s", 2).alias("stake"), F.round(100.0 * F.col("h") / F.col("n"), 4).alias("hit_rate"))


@query("""
SELECT p_size, string_agg(p_brand, ',' ORDER BY p_brand) AS listed FROM (SELECT p_size, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY p_brand) AS r FROM (SELECT DISTINCT p_size, p_brand FROM part)) WHERE r <= 8 GROUP BY 1""")
def distinct_list(spark, d):
    return A.distinct_list(table(spark, d, "part"), ["p_size"], "p_brand", 8)


@query("""
WITH c AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5)
SELECT c_nationkey, round(avg(total / n), 4) AS mean_ratio, count(*) AS customers FROM c JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def two_level_ratio(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    j = c.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return j.groupBy("c_nationkey").agg(F.round(F.avg(F.col("total") / F.col("n")), 4).alias("mean_ratio"), F.count(F.lit(1)).alias("customers"))


@query("""
WITH l AS (SELECT l_returnflag, CASE WHEN l_linenumber <> 2 THEN l_discount END AS v, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS w FROM lineitem)
SELECT l_returnflag, round(coalesce(sum(v * w) FILTER (v IS NOT NULL AND w > 0) / sum(w) FILTER (v IS NOT NULL AND w > 0), avg(v)), 6) AS mean, coalesce(sum(w) FILTER (v IS NOT NULL AND w > 0), 0) AS weight FROM l GROUP BY 1""")
def weighted_mean(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("v"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("w"))
    return A.weighted_mean(li, ["l_returnflag"], "v", "w").select("l_returnflag", F.round("mean", 6).alias("mean"), "weight")


@query("""
WITH c AS (SELECT c_nationkey, n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT n_regionkey, avg(c_acctbal) AS prior FROM c GROUP BY 1)
SELECT c_nationkey, n_regionkey, count(c_acctbal) AS n, round(max(prior), 4) AS prior, round((sum(c_acctbal) + 12 * max(prior)) / (count(c_acctbal) + 12), 4) AS shrunk FROM c JOIN p USING (n_regionkey) GROUP BY 1, 2""")
def shrinkage(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    df = table(spark, d, "customer").select("c_nationkey", "c_acctbal").join(n, "c_nationkey")
    return A.shrink(df, ["c_nationkey", "n_regionkey"], ["n_regionkey"], "c_acctbal", 12.0).select("c_nationkey", "n_regionkey", "n", r4("prior"), r4("shrunk"))


@query("""
WITH m AS (SELECT o_custkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS e FROM orders)
SELECT o_custkey, count(*) AS n, round(sum(e) / (count(*) + 5), 3) AS effect FROM m GROUP BY 1""")
def fixed_effect(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    mean = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return o.join(mean, "o_orderpriority").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice") - F.col("m")) / (F.count(F.lit(1)) + 5), 3).alias("effect"))


@query("""
WITH s AS (SELECT l_linestatus, l_shipmonth, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY GROUPING SETS ((l_linestatus, l_shipmonth), (l_linestatus), ()))
SELECT l_linestatus, CAST(l_shipmonth AS INTEGER) AS l_shipmonth, n, hits, round(((hits / n) + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS low,
 round(((hits / n) + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS high FROM s""")
def segment_summary(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", F.month("l_shipdate").alias("l_shipmonth"), "l_returnflag")
    agg = li.rollup("l_linestatus", "l_shipmonth").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("hits"))
    low, high = A.wilson(F.col("hits"), F.col("n"))
    return agg.select("l_linestatus", "l_shipmonth", "n", "hits", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -0.8 END AS profit FROM orders),
 b AS (SELECT *, sum(profit) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS bal FROM p),
 k AS (SELECT *, greatest(max(bal) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 0.0) AS peak FROM b)
SELECT o_custkey, round(CAST(sum(profit) AS DOUBLE), 4) AS total, round(CAST(max(peak) AS DOUBLE), 4) AS peak, round(CAST(min(bal - peak) AS DOUBLE), 4) AS max_drawdown FROM k GROUP BY 1""")
def drawdown(spark, d):
    p = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-0.8).alias("profit"))
    out = V.drawdown(p, ["o_custkey"], ["o_orderdate", "o_orderkey"], "profit")
    return out.select("o_custkey", r4("total"), r4("peak"), r4("max_drawdown"))


_PROBS = "SELECT (l_orderkey * 37 + l_linenumber * 11) % 750 / 1000.0::DOUBLE AS prob, l_returnflag = 'R' AS hit FROM lineitem"


def _probs(spark, d):
    return table(spark, d, "lineitem").select(
        (((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 750) / 1000.0).alias("prob"), (F.col("l_returnflag") == "R").alias("hit"))  # none in the last bins


_BINS = f"""SELECT b AS bin, b / 10 AS low, (b + 1) / 10 AS high, count(prob) AS n, avg(prob) AS conf, avg(hit::INT) AS acc, abs(avg(prob) - avg(hit::INT)) AS gap
 FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS b) LEFT JOIN ({_PROBS}) ON CAST(least(floor(prob * 10), 9) AS INTEGER) = b GROUP BY b"""


@query(f"SELECT bin, low, high, n, round(conf, 6) AS conf, round(acc, 6) AS acc, round(gap, 6) AS gap FROM ({_BINS})")
def calibration_bins(spark, d):
    out = A.calibration_bins(_probs(spark, d), "prob", "hit")
    return out.select("bin", "low", "high", "n", *[F.round(c, 6).alias(c) for c in ("conf", "acc", "gap")])


@query(f"SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS largest, CAST(sum(n) AS BIGINT) AS n FROM ({_BINS})")
def calibration_error(spark, d):
    out = A.calibration_error(A.calibration_bins(_probs(spark, d), "prob", "hit"))
    return out.select(F.round("ece", 6).alias("ece"), F.round("largest", 6).alias("largest"), "n")


@query(f"""
WITH p AS (SELECT prob, hit::INT AS y, least(greatest(prob, 1e-15), 1 - 1e-15) AS q FROM ({_PROBS})), e AS (SELECT prob, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1),
 c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM e)
SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg((prob - y) ** 2), 6) FROM p) AS brier, (SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) FROM p) AS log_loss,
 (SELECT round(avg(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) FROM p) AS accuracy, (SELECT round(2.0 * count(*) FILTER (prob >= 0.5 AND y = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (prob >= 0.5)), 6) FROM p) AS f1, (SELECT round(CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) FROM c) AS auc""")
def metrics_binary(spark, d):
    out = A.binary_metrics(_probs(spark, d), "prob", "hit")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("brier", "log_loss", "accuracy", "f1", "auc")])


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.1), 4) AS p10, round(quantile_cont(c_acctbal, 0.5), 4) AS p50, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY 1")
def percentile_anchor(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(*[F.round(F.expr(f"percentile(c_acctbal, {p})"), 4).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


@query("""
WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#11') AS brand, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price FROM part), m AS (SELECT brand, median(price) AS m FROM p GROUP BY 1)
SELECT p_partkey, round(coalesce(price, m), 4) AS price_filled FROM p JOIN m ON p.brand IS NOT DISTINCT FROM m.brand""")
def impute_median(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"))
    return A.impute_median(p, ["brand"], "price", "price_filled").select("p_partkey", r4("price_filled"))


@query("""
SELECT s_suppkey, round(CASE WHEN max(s_acctbal) OVER w > min(s_acctbal) OVER w THEN (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) ELSE 0.5 END, 4) AS scaled FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def minmax(spark, d):
    return A.min_max(table(spark, d, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", r4("scaled"))


@query("""
WITH c AS (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey AS nation, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer)
SELECT 'segment' AS name, count(*) FILTER (segment IS NULL) AS nulls, round(100.0 * count(*) FILTER (segment IS NULL) / count(*), 2) AS null_pct, count(DISTINCT segment) AS distinct_values FROM c UNION ALL
SELECT 'nation', count(*) FILTER (nation IS NULL), round(100.0 * count(*) FILTER (nation IS NULL) / count(*), 2), count(DISTINCT nation) FROM c UNION ALL SELECT 'balance', count(*) FILTER (balance IS NULL), round(100.0 * count(*) FILTER (balance IS NULL) / count(*), 2), count(DISTINCT balance) FROM c""")
def null_profile(spark, d):
    c = table(spark, d, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return A.null_profile(c, ["segment", "nation", "balance"])


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS corr FROM lineitem GROUP BY 1")
def regr_line(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("corr"))


@query("""
SELECT o_orderkey, CAST(date_diff('day', CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), CAST(o_orderdate AS DATE)) AS INTEGER) AS rest_days FROM orders""")
def rest_days(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return V.days_since_last(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "rest_days")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders),
 p AS (SELECT a.o_orderkey, b.o_totalprice AS v, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.day DESC, b.o_orderkey DESC) AS r FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.day < a.day)
SELECT o.o_orderkey, count(v) AS form_n, round(avg(v) + 0.000013, 3) AS form_mean FROM o LEFT JOIN p ON p.o_orderkey = o.o_orderkey AND r <= 10 GROUP BY 1""")
def form_last10(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return V.last_n_before(o, ["o_custkey"], "day", "o_orderkey", "o_totalprice").select("o_orderkey", "form_n", F.round(F.col("form_mean") + OFF_TIES, 3).alias("form_mean"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus = 'F' AS won, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY o_custkey, won ORDER BY i) AS grp FROM o)
SELECT o_orderkey, CAST(CASE WHEN won THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY o_custkey, won, grp ORDER BY i) AS INTEGER) AS streak FROM g""")
def streak(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return V.streak(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F").select("o_orderkey", "streak")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders)
SELECT a.o_orderkey, round(coalesce(avg(b.o_totalprice), 1000.0) + 0.000013, 3) AS past_mean FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day < a.day GROUP BY 1""")
def prefix_mean_strict(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return V.prefix_mean_before(o, ["o_custkey"], "day", "o_totalprice", 1000.0).select("o_orderkey", F.round(F.col("past_mean") + OFF_TIES, 3).alias("past_mean"))


@query("""
SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS INTEGER) AS rank_min, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank_first FROM part""")
def ranks(spark, d):
    w = W.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc())
    return table(spark, d, "part").select("p_partkey", F.rank().over(w).alias("rank_min"), F.row_number().over(W.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")).alias("rank_first"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(l_quantity * 990 / sum(l_quantity) OVER (PARTITION BY l_orderkey), 400.0), 3) AS rescaled FROM lineitem")
def rescale_total(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return V.rescale_to(li, ["l_orderkey"], "l_quantity", 990.0, 400.0).select("l_orderkey", "l_linenumber", "l_partkey", F.round("rescaled", 3).alias("rescaled"))


@query("""
SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || ' (' || r || ')' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)""")
def dedupe_suffix(spark, d):
    return V.number_repeats(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL BY NAME SELECT r_regionkey AS key, r_name AS name FROM region")
def union_by_name(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT 2 * c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_keys(spark, d):
    return table(spark, d, "customer").select((2 * F.col("c_nationkey")).alias("key")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT 2 * l_partkey FROM lineitem")
def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key")).exceptAll(table(spark, d, "lineitem").select(2 * F.col("l_partkey")).distinct()).distinct()


@query("""
SELECT o_custkey, o_orderkey, src FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY src, o_orderkey) AS r FROM
 (SELECT o_custkey, o_orderkey, 2 AS src FROM orders UNION ALL SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 3 END FROM customer)) WHERE r = 1""")
def union_distinct_on(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(2).alias("src"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long"), F.when(F.col("c_acctbal") > 0, 1).otherwise(3))
    return V.best_per_key(o.union(c), ["o_custkey"], [F.col("src"), F.col("o_orderkey")])


@query("""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS normal, replace(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS slug,
 substr(sha1(p_name || '|' || coalesce(nullif(p_brand, 'Brand#11'), '')), 1, 16) AS short_id FROM part""")
def text_keys(spark, d):
    both = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, d, "part").select("p_partkey", S.normalise_name(both).alias("normal"), S.slug(both).alias("slug"), S.short_id(F.col("p_name"), F.nullif("p_brand", F.lit("Brand#11"))).alias("short_id"))


_RAW = "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' || format('{:,}', CAST(s_suppkey * 1234 AS BIGINT)) || ' %' WHEN 2 THEN '-' || s_suppkey || '.25' WHEN 3 THEN '' ELSE s_suppkey || 'e2' END AS raw FROM supplier"


@query(f"SELECT s_suppkey, TRY_CAST(replace(regexp_replace(raw, '[\\s%]', '', 'g'), ',', '') AS DOUBLE) AS number FROM ({_RAW})")
def lenient_cast(spark, d):
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, F.concat(F.lit(" "), F.format_number(k * 1234, 0), F.lit(" %"))).when(
        k % 5 == 2, F.concat(F.lit("-"), k.cast("string"), F.lit(".25"))).when(k % 5 == 3, "").otherwise(F.concat(k.cast("string"), F.lit("e2")))
    return table(spark, d, "supplier").select("s_suppkey", S.lenient_double(raw).alias("number"))


@query("""
WITH n AS (SELECT n_nationkey AS k, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation)
SELECT a.k AS one, b.k AS two, round(2 * 6371 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)), 3) AS km FROM n a JOIN n b ON a.k < b.k""")
def haversine(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_nationkey") * 7.0 - 80).alias("lon"))
    a, b = n.alias("a"), n.alias("b")
    km = S.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("a.n_nationkey") < F.col("b.n_nationkey")).select(F.col("a.n_nationkey").alias("one"), F.col("b.n_nationkey").alias("two"), F.round(km, 3).alias("km"))


_RATES = "SELECT n_nationkey, 0.6 + n_nationkey / 20.0::DOUBLE AS h, 1.9 - n_nationkey / 25.0::DOUBLE AS a FROM nation"


def _rates(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", (0.6 + k / 20.0).alias("h"), (1.9 - k / 25.0).alias("a"))


@query(f"SELECT n_nationkey, round(1 - exp(-(h + a)) * (1 + (h + a) + (h + a) ** 2 / 2), 6) AS over25 FROM ({_RATES})")
def poisson_tail(spark, d):
    return _rates(spark, d).select("n_nationkey", F.round(S.poisson_over(F.col("h") + F.col("a"), 2.5), 6).alias("over25"))


_CELLS = f"""SELECT n_nationkey, h AS lh, a AS la, x.i AS gh, y.i AS ga, exp(-h) * h ** x.i / factorial(x.i::INT) * exp(-a) * a ** y.i / factorial(y.i::INT) AS p FROM ({_RATES}), range(9) x(i), range(9) y(i)"""
MARKETS = ("p_home", "p_draw", "p_away", "p_over25", "p_both", "goals_home", "goals_away")
_MARKETS = "round(sum(p) FILTER (gh > ga), 6) AS p_home, round(sum(p) FILTER (gh = ga), 6) AS p_draw, round(sum(p) FILTER (gh < ga), 6) AS p_away, round(sum(p) FILTER (gh + ga > 2), 6) AS p_over25, round(sum(p) FILTER (gh > 0 AND ga > 0), 6) AS p_both, round(sum(p * gh), 6) AS goals_home, round(sum(p * ga), 6) AS goals_away"


@query(f"SELECT n_nationkey, {_MARKETS} FROM ({_CELLS}) GROUP BY 1")
def score_matrix(spark, d):
    df = _rates(spark, d).withColumn("m", S.score_matrix(F.col("h"), F.col("a")))
    return df.select("n_nationkey", S.markets(F.col("m")).alias("x")).select("n_nationkey", *[F.round(f"x.{c}", 6).alias(c) for c in MARKETS])


@query(f"""
WITH c AS (SELECT *, p * CASE WHEN gh = 0 AND ga = 0 THEN 1 + lh * la * 0.08 WHEN gh = 0 AND ga = 1 THEN 1 - lh * 0.08 WHEN gh = 1 AND ga = 0 THEN 1 - la * 0.08 WHEN gh = 1 AND ga = 1 THEN 1.08 ELSE 1 END AS q FROM ({_CELLS})),
 s AS (SELECT n_nationkey, gh, ga, q / sum(q) OVER (PARTITION BY n_nationkey) AS p FROM c) SELECT n_nationkey, {_MARKETS} FROM s GROUP BY 1""")
def dixon_coles(spark, d):
    df = _rates(spark, d).withColumn("m", S.dixon_coles(S.score_matrix(F.col("h"), F.col("a")), F.col("h"), F.col("a"), -0.08))
    return df.select("n_nationkey", S.markets(F.col("m")).alias("x")).select("n_nationkey", *[F.round(f"x.{c}", 6).alias(c) for c in MARKETS])


@query("""
SELECT s_suppkey, market, round(prob, 6) AS prob FROM (SELECT s_suppkey, unnest([{'market': 'low', 'prob': s_acctbal / 20000}, {'market': 'mid', 'prob': s_acctbal / 15000}, {'market': 'high', 'prob': s_acctbal / 10000}], recursive := true) FROM supplier)
WHERE prob >= CASE market WHEN 'low' THEN 0.2 WHEN 'mid' THEN 0.3 ELSE 0.5 END""")
def radar_unpivot(spark, d):
    s = table(spark, d, "supplier")
    rows = F.array(*[F.struct(F.lit(m).alias("market"), (F.col("s_acctbal") / k).alias("prob"), F.lit(t).alias("least")) for m, k, t in (("low", 20000, 0.2), ("mid", 15000, 0.3), ("high", 10000, 0.5))])
    return s.select("s_suppkey", F.inline(rows)).where("prob >= least").select("s_suppkey", "market", F.round("prob", 6).alias("prob"))


@query("""
WITH p AS (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS a, (o_custkey % 97) / 96.0::DOUBLE AS b FROM orders), m AS (SELECT *, CASE WHEN abs(a - b) > 0.5 THEN 0.7 * a + 0.3 * b ELSE 0.4 * a + 0.6 * b END AS blend FROM p)
SELECT o_orderkey, round(blend + 0.000013, 4) AS blend, round(0.000013 + CASE WHEN blend <= 0.1 THEN 0.05 WHEN blend <= 0.5 THEN 0.05 + (blend - 0.1) * ((0.4 - 0.05) / (0.5 - 0.1)) WHEN blend <= 0.9 THEN 0.4 + (blend - 0.5) * ((0.95 - 0.4) / (0.9 - 0.5)) ELSE 0.95 END, 4) AS calibrated FROM m""")
def piecewise_blend(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 101) / 100.0).alias("a"), ((F.col("o_custkey") % 97) / 96.0).alias("b"))
    blend = F.when(F.abs(F.col("a") - F.col("b")) > 0.5, 0.7 * F.col("a") + 0.3 * F.col("b")).otherwise(0.4 * F.col("a") + 0.6 * F.col("b"))
    m = p.withColumn("blend", blend)
    return m.select("o_orderkey", F.round(F.col("blend") + OFF_TIES, 4).alias("blend"), F.round(OFF_TIES + S.interpolate(F.col("blend"), [0.1, 0.5, 0.9], [0.05, 0.4, 0.95]), 4).alias("calibrated"))


@query("""
SELECT *, reasons = '' AS kept FROM (SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('|', CASE WHEN l_discount < 0.02 THEN 'small discount' END, CASE WHEN l_quantity > 45 THEN 'bulk' END, CASE WHEN l_tax > 0.06 THEN 'high tax' END) AS reasons FROM lineitem)""")
def tag_filter(spark, d):
    why = S.reasons((F.col("l_discount") < 0.02, "small discount"), (F.col("l_quantity") > 45, "bulk"), (F.col("l_tax") > 0.06, "high tax"))
    tagged = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", why.alias("reasons"))
    return tagged.withColumn("kept", F.col("reasons") == "")


@query("""
WITH p AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS prob, 1 + (o_custkey % 40) / 10.0::DOUBLE AS odds FROM orders)
SELECT o_orderkey, round(prob * odds - 1, 6) AS ev, round(CASE WHEN odds > 1 THEN least(greatest((prob * odds - 1) / (odds - 1) * 0.25, 0.0), 0.05) ELSE 0.0 END, 6) AS stake FROM p""")
def kelly_stake(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100) / 100.0).alias("prob"), (1 + (F.col("o_custkey") % 40) / 10.0).alias("odds"))
    return p.select("o_orderkey", F.round(S.expected_value(F.col("prob"), F.col("odds")), 6).alias("ev"), F.round(S.kelly(F.col("prob"), F.col("odds")), 6).alias("stake"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, d):
    return table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT user_id, event_type, max(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2), n AS (SELECT user_id, event_type, max(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'error' GROUP BY 1, 2)
SELECT user_id, event_type, coalesce(n.value, o.value) AS value, CASE WHEN o.user_id IS NULL OR o.value IS NULL THEN 'insert' WHEN n.value IS NULL THEN 'keep' WHEN o.value = n.value THEN 'same' ELSE 'update' END AS change FROM o FULL JOIN n USING (user_id, event_type)""")
def upsert_tracker(spark, d):
    e = table(spark, d, "events")
    old = e.where("ts < timestamp_ntz '2024-01-20'").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    new = e.where("ts >= timestamp_ntz '2024-01-10' AND event_type <> 'error'").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return J.upsert(old, new, ["user_id", "event_type"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_window(spark, d):
    """The batch form of ``fathomline.streaming.hourly``; tests/test_streams.py runs it as a stream."""
    from fathomline.streaming import hourly

    return hourly(table(spark, d, "events"))
