"""Ordered analytics: history before a row, streaks, running figures, ranks, rating folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the order must be total."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def latest_per_key(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    return best_per_key(df, by, [F.col(time).desc(), F.col(tie).desc()])


def open_close(df: DataFrame, by: list[str], time: str, tie: str, value: str) -> DataFrame:
    """First and last value of each key, by aggregates (no sort); a single row is both."""
    order = F.struct(time, tie)
    return df.groupBy(*by).agg(F.min_by(value, order).alias("opening"), F.max_by(value, order).alias("closing"), F.count(F.lit(1)).alias("quotes"))


def days_since_last(df: DataFrame, by: list[str], day: str, tie: str, out: str = "rest_days") -> DataFrame:
    return df.withColumn(out, F.datediff(day, F.lag(day).over(W.partitionBy(*by).orderBy(day, tie))))


def last_n_before(df: DataFrame, by: list[str], day: str, tie: str, value: str, n: int = 10) -> DataFrame:
    """Mean and number of the key's last ``n`` rows' values of strictly earlier days; null keys are a key too.

    Rows of one day must not see each other: all of them take the frame of the day's first row.
    """
    before = W.partitionBy(*by).orderBy(day, tie).rowsBetween(-n, -1)
    first = W.partitionBy(*by, day).orderBy(tie).rowsBetween(W.unboundedPreceding, 0)
    sums = df.withColumn("_s", F.sum(value).over(before)).withColumn("_c", F.count(value).over(before))
    return (
        sums.withColumn("_s", F.first("_s").over(first)).withColumn("form_n", F.first("_c").over(first))
        .withColumn("form_mean", F.when(F.col("form_n") > 0, F.col("_s") / F.col("form_n"))).drop("_s", "_c")
    )


def prefix_mean_before(df: DataFrame, by: list[str], day: str, value: str, fallback: float | Column) -> DataFrame:
    """Mean of all values of strictly earlier days, else ``fallback`` (a number, or a Column such as a cascade of coalesce); null keys are a key too."""
    w = W.partitionBy(*by).orderBy(F.datediff(day, F.lit("1970-01-01").cast("date"))).rangeBetween(W.unboundedPreceding, -1)
    past = F.try_divide(F.sum(value).over(w), F.count(value).over(w))
    return df.withColumn("past_mean", F.coalesce(past, fallback if isinstance(fallback, Column) else F.lit(fallback)))


def streak(df: DataFrame, by: list[str], order: list[str], won: Column) -> DataFrame:
    """Signed length of the run that ends in each row: positive for wins, negative for others."""
    w = W.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_won", won).withColumn("_new", F.coalesce((F.lag("_won").over(w) != F.col("_won")).cast("int"), F.lit(1)))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.row_number().over(W.partitionBy(*by, "_run").orderBy(*order))
    return runs.withColumn("streak", F.when(F.col("_won"), n).otherwise(-n)).drop("_won", "_new", "_run")


def drawdown(df: DataFrame, by: list[str], order: list[str], profit: str) -> DataFrame:
    """Total, peak (0 at least) and largest fall from the peak of a running balance."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = df.withColumn("_b", F.sum(profit).over(w)).withColumn("_p", F.greatest(F.max("_b").over(w), F.lit(0.0)))
    return run.groupBy(*by).agg(F.sum(profit).alias("total"), F.max("_p").alias("peak"), F.min(F.col("_b") - F.col("_p")).alias("max_drawdown"))


def rescale_to(df: DataFrame, by: list[str], value: str, total: float, most: float, least: float = 0.0, passes: int = 1) -> DataFrame:
    """Values scaled so that each group sums to ``total`` and cut to ``least`` and ``most``; what cutting took is scaled in again with every further pass."""
    w = W.partitionBy(*by)
    out = df.withColumn("rescaled", F.col(value))
    for _ in range(passes):
        s = F.sum("rescaled").over(w)
        out = out.withColumn("rescaled", F.when(s > 0, F.least(F.greatest(F.col("rescaled") * total / s, F.lit(least)), F.lit(most))))
    return out


def fill_to(df: DataFrame, by: list[str], value: str, fixed: Column, total: float) -> DataFrame:
    """``filled``: rows that aren't ``fixed`` scaled so that each group sums to ``total``; where the fixed ones alone reach it, all rows are."""
    w = W.partitionBy(*by)
    v, is_fixed = F.col(value), F.coalesce(fixed, F.lit(False))
    held, free, both = (F.coalesce(F.sum(x).over(w), F.lit(0.0)) for x in (F.when(is_fixed, v), F.when(~is_fixed, v), v))
    return df.withColumn("filled", F.when(held >= total, F.when(both > 0, v * total / both).otherwise(v)).when(~is_fixed & (free > 0), v * (total - held) / free).otherwise(v))


def number_repeats(df: DataFrame, name: str, tie: str, out: str = "unique_name") -> DataFrame:
    """Colliding names get " (2)", " (3)", ... in the order of ``tie``."""
    n = F.row_number().over(W.partitionBy(name).orderBy(tie))
    return df.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))).drop("_n")


def quote_flags(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """``is_opening`` and ``is_closing``: each key's first and last quote by time, of equal times the first by ``tie`` in both; quotes without a time are neither."""
    has = F.col(time).isNotNull()
    w = W.partitionBy(*by, has)
    first = F.row_number().over(w.orderBy(F.col(time).asc(), tie)) == 1
    last = F.row_number().over(w.orderBy(F.col(time).desc(), tie)) == 1
    return df.withColumn("is_opening", has & first).withColumn("is_closing", has & last)


def rating_fold(games: DataFrame, pool: str, start: float = 1500.0, advantage: float = 100.0, width: float = 400.0) -> DataFrame:
    """Both sides' ratings before and after each game: a fold over time in every pool of players who meet only each other.

    ``games``: the pool, seq (the order), home, away, score (the home side's result: 1,
    0.5, 0), weight (K times the margin's factor), neutral (null counts as neutral) and
    home_start, away_start (null: ``start``), of which a player's first one counts. A
    pool is sorted by Spark and folded as its rows stream by; only its players' ratings
    are held, so pools may be long, but each is one task's work.
    """
    kind = games.schema[pool].dataType.simpleString()
    columns = [pool, "seq", "home", "away", "score", "weight", "neutral", "home_start", "away_start"]
    out = [pool, "seq", "home", "away", "home_before", "away_before", "home_after", "away_after"]

    def run(batches):
        now, rating = object(), {}
        for batch in batches:
            found = []
            for p, _, home, away, score, weight, neutral, home_start, away_start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != now:
                    now, rating = p, {}
                h = rating.setdefault(home, start if home_start is None else home_start)
                a = rating.setdefault(away, start if away_start is None else away_start)
                edge = 0.0 if neutral is None or neutral else advantage
                change = weight * (score - 1 / (1 + 10 ** ((a - h - edge) / width)))
                rating[home], rating[away] = h + change, a - change
                found.append((h, a, h + change, a - change))
            ratings = np.array(found).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(ratings[:, k]) for k in range(4)]], out)

    named = games.select(F.col(pool), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast(t).alias(c) for c, t in (
        ("home", "string"), ("away", "string"), ("score", "double"), ("weight", "double"), ("neutral", "boolean"), ("home_start", "double"), ("away_start", "double"))])
    return named.select(*columns).repartition(pool).sortWithinPartitions(pool, "seq").mapInArrow(
        run, f"`{pool}` {kind}, seq long, home string, away string, home_before double, away_before double, home_after double, away_after double")


def snapshots(folded: DataFrame, pool: str) -> DataFrame:
    """(pool, seq, team, rating): both sides' ratings after each game."""
    return folded.select(pool, "seq", F.inline(F.array(
        F.struct(F.col("home").alias("team"), F.col("home_after").alias("rating")), F.struct(F.col("away").alias("team"), F.col("away_after").alias("rating")))))
