"""Joins: strictly-past as-of, tolerance, unordered pairs, null-safe keys, unique names, upserts."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys come back once, before the other columns."""
    r = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    hit = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    if how in ("left_semi", "left_anti"):
        return left.join(r, hit, how)
    found = left.join(r, hit, how)
    keys = [F.coalesce(c, f"_right_{c}").alias(c) if how in ("full", "right") else F.col(c) for c in on]
    return found.select(*keys, *[F.col(c) for c in found.columns if c not in on and c not in [f"_right_{k}" for k in on]])


def asof_before(left: DataFrame, right: DataFrame, by: list[str], time: str, tie: str, value: str, out: str = "value_before") -> DataFrame:
    """For each left row the right value latest strictly before its time, else the key's first; null for unknown keys.

    One union sorted by key and time and a running last value: no range join, and linear
    in the rows of a key. Rows of equal time come after the left ones, so they aren't seen.
    """
    own = [c for c in left.columns]
    a = left.withColumn("_side", F.lit(0)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, time, F.col(tie).alias("_tie"), F.lit(1).alias("_side"), F.col(value).alias("_v"), F.lit(True).alias("_seen"))
    both = a.withColumn("_tie", F.col(tie)).unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(time, "_side", "_tie")
    past = F.last(F.when(F.col("_seen"), F.struct("_v")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    first = right.groupBy(*by).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(time, tie)).alias("_first"))
    found = both.withColumn("_past", past).where(F.col("_side") == 0)
    return found.join(first, by, "left").select(*own, F.when(F.col("_past").isNotNull(), F.col("_past._v")).otherwise(F.col("_first.v")).alias(out))


def tolerance_join(left: DataFrame, right: DataFrame, by: list[str], left_day: str, right_day: str, steps: tuple[int, ...] = (0, -1, 1)) -> DataFrame:
    """Equal keys and a day within ``steps``, which are tried in order; each left row comes with the right rows of every step.

    The left rows, which a game has one of, are repeated for each step and not the many
    right ones, whose day is theirs alone.
    """
    tried = left.withColumn("_turn", F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(s).alias("step")) for i, s in enumerate(steps)])))
    tried = tried.withColumn("turn", F.col("_turn.turn")).withColumn("day_step", F.col("_turn.step")).withColumn("_day", F.date_add(F.to_date(left_day), F.col("day_step"))).drop("_turn")
    return tried.join(right.withColumn("_day", F.to_date(right_day)), [*by, "_day"]).drop("_day")


def oriented(df: DataFrame, home: str, away: str, swap: dict[str, str]) -> DataFrame:
    """Every row as it is and with the two names changed over, its values under each other's names (``swap``: a column and its mirror); ``flipped`` tells which."""
    mirror = swap | {b: a for a, b in swap.items()}
    turned = df.select(*[F.col(away if c == home else home if c == away else mirror.get(c, c)).alias(c) for c in df.columns], F.lit(True).alias("flipped"))
    return df.withColumn("flipped", F.lit(False)).unionByName(turned)


def pair_key(a: str, b: str) -> tuple[Column, Column]:
    """The two names in one order, so that either orientation meets."""
    return F.least(a, b), F.greatest(a, b)


def unique_name_match(left: DataFrame, right: DataFrame, exact: list[str], name: str, key: str) -> DataFrame:
    """Right's key by all of ``exact``; else by ``name`` where only one right row bears it."""
    by_all = right.groupBy(*exact).agg(F.min(key).alias("_exact"))
    by_name = right.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_only")).where(F.col("_n") == 1).drop("_n")
    found = left.join(by_all, exact, "left").join(by_name, name, "left")
    return found.withColumn("matched", F.coalesce("_exact", "_only")).withColumn(
        "method", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_only").isNotNull(), "name").otherwise("none")).drop("_exact", "_only")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys; ``change`` says insert, update, same or keep."""
    rest = [c for c in old.columns if c not in on]
    o = old.select(*on, F.struct(*rest).alias("_o"))
    n = new.select(*on, F.struct(*rest).alias("_n"))
    both = o.join(n, on, "full")
    change = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "keep").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("update")
    return both.select(*on, *[F.coalesce(F.col("_n"), F.col("_o"))[c].alias(c) for c in rest], change.alias("change"))


def upsert_kept(old: DataFrame, new: DataFrame, on: list[str], preserved: list[str], inserted: dict[str, Column], computed: dict[str, Column]) -> DataFrame:
    """Upsert of signals into a tracker with the columns of ``old``.

    Known keys take all columns of ``new`` but the ``preserved`` ones; unknown keys
    start with ``inserted`` and nulls for columns that ``new`` lacks. ``computed`` are
    Columns over ``_o`` and ``_n`` (the old and new rows, null where there is none) and
    take precedence. Each key occurs once on either side.
    """
    rest = [c for c in old.columns if c not in on]
    o = old.select(*on, F.struct(*rest).alias("_o"))
    n = new.select(*on, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in rest]).alias("_n"))
    both = o.join(n, on, "full")

    def value(c: str) -> Column:
        known, first = F.col("_o")[c], inserted.get(c, F.col("_n")[c])
        if c in computed:
            return computed[c]
        updated = known if c in preserved or c not in new.columns else F.col("_n")[c]
        return F.when(F.col("_o").isNull(), first).when(F.col("_n").isNull(), known).otherwise(updated)

    return both.select(*on, *[value(c).cast(old.schema[c].dataType).alias(c) for c in rest])


def strategy_grid(bets: DataFrame, bands: list[tuple], names: list[str], limits: dict[str, list[tuple[float, float]]], sums: dict[str, Column], upper_open: bool = False) -> DataFrame:
    """Sums over the bets inside every band; bands without any are kept, with nulls.

    ``bands`` are the names' values, ``limits`` a (low, high) for each band and column,
    both ends inside unless ``upper_open``. The limits cut each axis into points and the
    intervals between them; bets are summed by cell first, so what meets the bands is one
    row for each cell and no bet is compared with a band.
    """
    spark = bets.sparkSession
    edges = {c: sorted({e for pair in pairs for e in pair}) for c, pairs in limits.items()}

    def place(c: str) -> Column:
        """Twice the edges below, and one more on an edge."""
        below = sum((F.when(F.col(c) > e, 2).otherwise(0) for e in edges[c]), F.lit(0))
        return below + F.when(F.col(c).isin(edges[c]), 1).otherwise(0)

    cells = bets.where(" AND ".join(f"`{c}` IS NOT NULL" for c in limits)).groupBy(*[place(c).alias(f"at_{c}") for c in limits]).agg(
        *[F.sum(v).alias(n) for n, v in sums.items()])
    at = lambda c, e: 2 * bisect_left(edges[c], e) + 1
    rows = [(*b, *[x for c, pairs in limits.items() for x in (at(c, pairs[i][0]), at(c, pairs[i][1]) - upper_open)]) for i, b in enumerate(bands)]
    grid = spark.createDataFrame(rows, [*names, *[x for c in limits for x in (f"lo_{c}", f"hi_{c}")]])
    inside = reduce(lambda a, b: a & b, [F.col(f"at_{c}").between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in limits])
    kept = cells.join(F.broadcast(grid), inside).groupBy(*names).agg(*[F.sum(n).alias(n) for n in sums])
    return grid.select(*names).join(kept, names, "left")
