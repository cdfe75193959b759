"""Names, keys, matching, validation and small scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import names as M
from fathomline.functions import scalars as S
from fathomline.operators import entities as E
from fathomline.operators import matching as K
from fathomline.operators import reports as P
from fathomline.operators import rules as R
from fathomline.operators import windows as V
from fathomline.plans.registry import OFF_TIES, query
from fathomline.sources import table

_LOW = "lower(strip_accents(coalesce(text, '')))"
_SPACED = "trim(regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _sp(x):
    return _SPACED.format(x=x)


@query(f"""
WITH t AS (SELECT doc_id, {_LOW} AS low, lower(coalesce(text, '')) AS plain FROM documents), k AS (SELECT doc_id, {_sp("regexp_replace(replace(low, '&', ' and '), '[^a-z0-9 \\t\\n\\x0B\\f\\r''-]', ' ', 'g')")} AS team_key,
 {_sp("regexp_replace(replace(low, 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')")} AS identity_key, {_sp("regexp_replace(low, '[^a-z \\t\\n\\x0B\\f\\r]', '', 'g')")} AS letters_key, {_sp("regexp_replace(plain, '[^a-z0-9]+', ' ', 'g')")} AS text_key FROM t)
SELECT doc_id, md5(team_key) AS team_key, md5(identity_key) AS identity_key, md5(letters_key) AS letters_key, md5(text_key) AS text_key, length(identity_key) AS n FROM k""")
def name_keys(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    keys = {"team_key": M.team_key(F.col("text")), "identity_key": M.identity_key(F.col("text")), "letters_key": M.letters_key(F.col("text")), "text_key": M.text_key(F.col("text"))}
    k = t.select("doc_id", *[c.alias(n) for n, c in keys.items()])
    return k.select("doc_id", *[F.md5(n).alias(n) for n in keys], F.length("identity_key").cast("long").alias("n"))


@query("""
WITH a AS (SELECT 'brand ' || (10 + k) AS key, 'House ' || k AS canonical FROM (SELECT unnest(range(15)) AS k)), p AS (SELECT p_partkey, ' ' || replace(p_brand, '#', ' ') || '. ' AS raw FROM part)
SELECT p_partkey, coalesce(canonical, trim(raw)) AS name, canonical AS strict FROM p LEFT JOIN a ON a.key = trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))""")
def canonical_names(spark, d):
    k = F.col("id").cast("string")
    aliases = spark.range(15).select(F.concat(F.lit("brand "), (F.col("id") + 10).cast("string")).alias("key"), F.concat(F.lit("House "), k).alias("canonical"))
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(". ")).alias("raw"))
    out = M.canonical(M.canonical(p, "raw", aliases, "name"), "raw", aliases, "strict", strict=True)
    return out.select("p_partkey", "name", "strict")


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || upper(p_name) WHEN 2 THEN p_name || ' ' || p_name ELSE p_type || ' and ' || p_name || ' of ' || p_brand END AS name FROM part)
SELECT p_partkey, concat_ws('|', CASE WHEN regexp_matches(name, '[a-z][A-Z]') THEN 'run_together' END, CASE WHEN len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0 THEN 'repeated' END, CASE WHEN length(name) > 28 THEN 'long' END) AS faults
FROM (SELECT *, string_split(replace(name, '#', ' # '), ' ') AS w FROM p)""")
def name_faults(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.upper("p_name"))).when(k == 2, F.concat_ws(" ", "p_name", "p_name")).otherwise(F.concat("p_type", F.lit(" and "), "p_name", F.lit(" of "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", R.name_faults(name).alias("faults"))


@query("""
WITH p AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w, p_retailprice AS v FROM part), n AS (SELECT k, v, array_to_string(w, ' ') AS name, CASE WHEN len(w) > 1 THEN array_to_string(list_append(w[2:], w[1]), ' ') ELSE array_to_string(w, ' ') END AS turned FROM p),
 r AS (SELECT k, v, name FROM n WHERE k % 2 = 1 UNION SELECT k, v, turned FROM n WHERE k % 2 = 1), b AS (SELECT name, arg_max(v, (v, -k)) AS best FROM r GROUP BY 1)
SELECT n.k, best FROM n LEFT JOIN b ON b.name = n.turned WHERE n.k % 2 = 0""")
def match_inverted(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("key"), F.col("p_retailprice").alias("v"))
    left = p.where("k % 2 = 0").select("k", M.inverted(F.col("key")).alias("key"))
    return E.match_either_way(left, p.where("k % 2 = 1"), "key", "v", "k", "best").select("k", "best")


def _openings(spark, d):
    """Every document as a person: its opening three words as the name, its source as the club, its language as the country."""
    words = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+", 5), lambda w: w != ""), 1, 3)  # the first part may be empty, the fifth is the rest
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), words.alias("words"), F.coalesce("source", F.lit("")).alias("club"), F.coalesce("lang", F.lit("")).alias("country"), F.when(F.col("n_chars") > 900, "long").otherwise("short").alias("position"))


def two_lists(spark, d):
    """The openings, and the same as another list writes them: the second word first, the last two letters gone, a third of the clubs renamed."""
    o = _openings(spark, d)
    turned = F.concat_ws(" ", F.get("words", F.lit(1)), F.get("words", F.lit(0)), F.get("words", F.lit(2)))
    left = o.select(F.col("id").alias("left_id"), M.identity_key(F.concat_ws(" ", "words")).alias("key"), "club", "country", "position")
    club = F.when(F.col("id") % 3 == 0, F.concat("club", F.lit(" fc"))).otherwise(F.col("club"))
    key = M.identity_key(turned)
    return left, o.select(
        F.col("id").alias("right_id"), F.trim(F.substring(key, F.lit(1), F.greatest(F.length(key) - 2, F.lit(0)))).alias("key"), club.alias("club"), "country", "position")


@query(None)
def fuzzy_match(spark, d):
    """Each opening's best match in the other list by name, club, country and position; tested against brute force."""
    left, right = two_lists(spark, d)
    return K.best_match(left, right, "left_id", "right_id")


def two_rosters(spark, d):
    """The openings by club and country as two rosters that spell names in seven ways, each row in both."""
    o = _openings(spark, d).withColumn("k", F.col("id") % 7)
    w = lambda i: F.coalesce(F.get("words", F.lit(i)), F.lit(""))
    name = F.concat_ws(" ", "words")
    left = o.select(F.col("id").alias("left_id"), F.concat_ws("/", "club", "country").alias("team"), F.when(F.col("k") == 5, F.concat(w(0), F.lit(' "'), w(1), w(2), F.lit('"'))).otherwise(name).alias("name"), "club", "position")
    other = F.when(F.col("k") == 0, name).when(F.col("k") == 1, F.upper(name)).when(F.col("k") == 2, F.concat_ws(" ", w(2), w(0), w(1))).when(F.col("k") == 3, F.concat_ws(" ", w(0), w(2))).when(
        F.col("k") == 4, F.concat_ws(" ", w(0), F.concat(F.reverse(F.substring(w(1), 1, 4)), w(2)))).when(F.col("k") == 5, F.concat(w(1), F.lit(" "), w(2))).otherwise(F.concat(w(0), w(1), w(2)))
    return left, o.select(
        F.col("id").alias("right_id"), F.concat_ws("/", "club", "country").alias("team"), other.alias("name"), F.when(F.col("id") % 5 == 0, F.concat("club", F.lit(" FC (ENG)"))).otherwise(F.col("club")).alias("club"), "position")


@query(None)
def staged_match(spark, d):
    """The rosters matched one to one in all stages; tested against brute force."""
    left, right = two_rosters(spark, d)
    return K.roster_match(left, right, ["team"], "left_id", "right_id")


def misspelled(spark, d):
    """Part names that each lack a letter, and the names themselves as the known ones."""
    p = table(spark, d, "part")
    at = (F.col("p_partkey") % F.length("p_name")).cast("int")
    names = p.select(F.concat(F.substring("p_name", F.lit(1), at), F.substring(F.col("p_name"), at + 2, F.length("p_name"))).alias("name"))
    return names, p.select(F.col("p_name").alias("canonical"), M.team_key(F.col("p_name")).alias("key")).distinct()


@query(None)
def name_suggestions(spark, d):
    """Names without a canonical one, how often they come up and the nearest; tested against brute force."""
    names, known = misspelled(spark, d)
    return K.name_coverage(names, known, M.team_key(F.col("name")))[1]


@query("""
SELECT 'orders' AS "table", '' AS missing, 'o_orderstatus' AS extra, CAST(sum(n) AS BIGINT) AS "rows", CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS empty_keys, coalesce(sum(n) FILTER (n > 1), 0) = 0 AND coalesce(sum(n) FILTER (k IS NULL), 0) = 0 AS ok
 FROM (SELECT o_custkey AS k, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey FROM orders) GROUP BY 1)
UNION ALL SELECT 'parts', 'p_weight', '', count(*), 0, 0, false FROM part""")
def validation_report(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus")
    p = table(spark, d, "part").select("p_partkey")
    return P.validate(o, "orders", ["o_custkey"], ["o_custkey"]).union(P.validate(p, "parts", ["p_partkey"], ["p_partkey", "p_weight"]))


@query("""
WITH a AS (SELECT DISTINCT CASE WHEN c_nationkey <> 3 THEN 2 * c_nationkey END AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT k, 'left_only' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'right_only' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_difference(spark, d):
    a = table(spark, d, "customer").select(F.when(F.col("c_nationkey") != 3, 2 * F.col("c_nationkey")).alias("k"))
    return P.set_difference(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) NOT BETWEEN 1 AND 2")
def odd_group_sizes(spark, d):
    return P.group_sizes(table(spark, d, "part"), ["p_brand"], "p_size", 1, 2)


@query("""
SELECT count(*) AS "rows", count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type = 'error') AS errors FROM events UNION ALL SELECT 0, 0, 0""")
def flag_counts(spark, d):
    e = table(spark, d, "events")
    flags = {"high": F.col("value") > 50, "errors": F.col("event_type") == "error"}
    return P.flag_counts(e, flags).union(P.flag_counts(e.where("false"), flags))


@query("SELECT event_type, count(*) AS n, count(DISTINCT (user_id, CAST(ts AS DATE))) AS pairs FROM events GROUP BY 1")
def frequency_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct("user_id", F.to_date("ts"))).alias("pairs"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_seen(spark, d):
    return V.best_per_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_size) > 1 AS is_repeated FROM part")
def repeated_keys(spark, d):
    from pyspark.sql import Window as W

    return table(spark, d, "part").select("p_partkey", (F.count(F.lit(1)).over(W.partitionBy("p_name", "p_size")) > 1).alias("is_repeated"))


@query("""
WITH s AS (SELECT n_nationkey AS k, 0.4 + n_nationkey / 20 AS h, 1.9 - n_nationkey / 25 AS a FROM nation), c AS (SELECT k, x.i AS gh, y.i AS ga, exp(-h) * h ** x.i / factorial(x.i::INT) * exp(-a) * a ** y.i / factorial(y.i::INT) AS p FROM s, range(9) x(i), range(9) y(i)), t AS (SELECT k, sum(p) AS t FROM c GROUP BY 1)
SELECT k, CAST(r AS INTEGER) AS place, gh || '-' || ga AS score, round(p / t, 6) AS p FROM (SELECT c.*, t, row_number() OVER (PARTITION BY c.k ORDER BY p DESC, gh DESC, ga DESC) AS r FROM c JOIN t USING (k)) WHERE r <= 5""")
def top_scores(spark, d):
    k = F.col("n_nationkey")
    r = table(spark, d, "nation").select(k.alias("k"), (0.4 + k / 20.0).alias("h"), (1.9 - k / 25.0).alias("a"))
    m = r.select("k", S.dixon_coles(S.score_matrix(F.col("h"), F.col("a")), F.col("h"), F.col("a"), 0.0).alias("m"))
    return m.select("k", F.posexplode(S.top_scores(F.col("m"))).alias("at", "s")).select(
        "k", (F.col("at") + 1).alias("place"), F.concat_ws("-", F.col("s.h").cast("string"), F.col("s.a").cast("string")).alias("score"), F.round("s.p", 6).alias("p"))


@query("""
SELECT p_partkey, (p_partkey % 3 = 0) AS flag, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2020-01-01' + CAST(p_partkey % 900 AS INTEGER) END AS day, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS INTEGER) END AS years, CAST(floor(date_diff('day', DATE '1980-05-05' + CAST(p_partkey AS INTEGER), DATE '2024-06-01') / 365.2425) AS INTEGER) AS age,
 CASE WHEN p_partkey % 6 = 0 THEN 7.5 WHEN p_size % 7 = 0 THEN NULL ELSE round(p_retailprice / (p_size % 7), 4) END AS rate, round(ln(1 + p_size * 1000) / ln(1 + 40000), 6) AS score_raw, (p_partkey % 11) || ' Over' AS selection, CAST(p_size % 4 + 0.5 AS DOUBLE) AS line FROM part""")
def lenient_values(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, d, "part").select(
        k, F.when(k % 3 == 0, " YES").when(k % 3 == 1, "no").alias("b"), F.when(k % 5 != 0, F.concat(F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")).cast("string"), F.lit("T10:00:00Z"))).otherwise("someday").alias("t"),
        F.when(k % 4 == 0, "n/a").otherwise(F.concat(s.cast("string"), F.lit("-114"))).alias("y"), F.date_add(F.lit("1980-05-05").cast("date"), k.cast("int")).alias("born"), F.when(k % 6 == 0, 7.5).alias("given"), "p_retailprice", s,
        F.concat((k % 11).cast("string"), F.lit(" (Over "), (s % 4 + F.lit(0.5)).cast("double").cast("string"), F.lit(")")).alias("said"))
    selection, line = S.selection_and_line(F.col("said"), F.lit(None).cast("double"))
    return p.select(
        "p_partkey", S.lenient_bool(F.col("b")).alias("flag"), S.lenient_date(F.col("t")).alias("day"), S.leading_int(F.col("y")).alias("years"), S.age(F.col("born"), F.lit("2024-06-01").cast("date")).alias("age"),
        F.round(S.rate_or_value(F.col("given"), F.col("p_retailprice"), F.col("p_size") % 7), 4).alias("rate"), F.round(F.log1p(F.col("p_size") * 1000) / F.log1p(F.lit(40000)), 6).alias("score_raw"), selection.alias("selection"), line.alias("line"))


@query("""
SELECT o_orderkey, (epoch(timezone('Europe/Madrid', timezone('UTC', o_orderdate))) - epoch(o_orderdate)) / 3600 AS madrid, round(CASE WHEN o_totalprice > 100000 THEN least(greatest(o_totalprice / 400000, 0.3), 0.9) END + 0.000013, 4) AS cut FROM orders""")
def zone_offsets(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.utc_offset_hours(F.col("o_orderdate").cast("timestamp"), "Europe/Madrid").alias("madrid"), F.round(S.clip(F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") / 400000), 0.3, 0.9) + OFF_TIES, 4).alias("cut"))


@query("""
WITH h AS (SELECT team, count(*) AS games FROM (SELECT c_mktsegment AS team FROM customer UNION ALL SELECT p_type FROM part) GROUP BY 1), c AS (SELECT unnest(['BUILDING', 'AUTOMOBILE', 'LARGE', 'GARDEN']) AS team)
SELECT team, coalesce(games, 0) AS games, games IS NOT NULL AS in_history FROM c LEFT JOIN h USING (team)""")
def name_coverage(spark, d):
    both = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).unionAll(table(spark, d, "part").select("p_type"))
    known = spark.createDataFrame([(t, t.lower()) for t in ("BUILDING", "AUTOMOBILE", "LARGE", "GARDEN")], "canonical string, key string")
    per, _ = K.name_coverage(both, known, M.team_key(F.col("name")))
    return per.select(F.col("canonical").alias("team"), F.col("uses").alias("games"), F.col("covered").alias("in_history"))


@query("""
WITH b AS (SELECT 'M' || (n_nationkey % 6) AS market, n_nationkey AS k FROM nation), r AS (SELECT * FROM (VALUES ('M0', 'live', true), ('M1', 'paper', false), ('M3', 'radar', false)) t(market, status, stake)) SELECT k, market, coalesce(status, 'unknown') AS status, coalesce(stake, false) AS stake FROM b LEFT JOIN r USING (market)""")
def registry_lookup(spark, d):
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("M"), (F.col("n_nationkey") % 6).cast("string")).alias("market"))
    r = spark.createDataFrame([("M0", "live", True), ("M1", "paper", False), ("M3", "radar", False)], "market string, status string, stake boolean")
    return b.join(F.broadcast(r), "market", "left").select("k", "market", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("stake", F.lit(False)).alias("stake"))


@query("SELECT l_returnflag, sum(v) AS total, coalesce(sum(v), 0) AS filled FROM (SELECT l_returnflag, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS v FROM lineitem) GROUP BY 1")
def null_sums(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("v"))
    return li.groupBy("l_returnflag").agg(F.sum("v").alias("total"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("filled"))


@query("""
WITH q AS (SELECT l_orderkey AS k, l_returnflag AS side, l_quantity AS v, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT k, arg_min(v, (n, p, s, v)) FILTER (side = 'A') AS "A", arg_min(v, (n, p, s, v)) FILTER (side = 'N') AS "N", arg_min(v, (n, p, s, v)) FILTER (side = 'R') AS "R" FROM q WHERE k IS NOT NULL GROUP BY 1""")
def pivot_first(spark, d):
    from fathomline.operators import aggregates as A

    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("side"), F.col("l_quantity").alias("v"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return A.pivot_first(q, ["k"], "side", ["A", "N", "R"], "v", ["n", "p", "s", "v"])


@query("""
WITH e AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, s.n""")
def event_sessions(spark, d):
    from fathomline.streaming import sessions

    return sessions(table(spark, d, "events"), "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")


@query(f"SELECT n_nationkey AS k, round(1 / (n_nationkey / 30 + 0.01) + {OFF_TIES}, 3) AS fair, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 0.5 ELSE -1 END AS DOUBLE) AS profit, CASE WHEN n_nationkey > 15 THEN 'HIGH' WHEN n_nationkey > 7 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM nation")
def small_prices(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("k"), F.round(1 / (k / 30 + 0.01) + OFF_TIES, 3).alias("fair"), S.settled_profit(k % 2 == 0, 1 + k * 0.5).alias("profit"), S.ladder(k.cast("double"), [(15.5, "HIGH"), (7.5, "MEDIUM")], "LOW").alias("band"))
