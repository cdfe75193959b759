"""Grouped aggregates: shares, pivots, ratios, shrinkage, calibration, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.operators.joins import join_null_safe


def share(df: DataFrame, by: list[str], value: str, out: str = "share") -> DataFrame:
    """Each row's part of its group's total (1 over the group); null where the total is 0."""
    total = F.sum(value).over(W.partitionBy(*by))
    return df.withColumn(out, F.when(total != 0, F.col(value) / total))


def pivot_sum(df: DataFrame, by: list[str], on: str, values: list[str], value: str) -> DataFrame:
    """One column for each of ``values`` (given, so no pass to find them), zero-filled."""
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(on) == v, F.col(value))), F.lit(0.0)).alias(v) for v in values])


def pivot_count(df: DataFrame, by: list[str], on: str, values: list[str], distinct: str | None = None) -> DataFrame:
    """Rows of each of ``values``, zero-filled, with their total and, of ``distinct``, the different values."""
    extra = [F.countDistinct(distinct).alias(f"distinct_{distinct}")] if distinct else []
    return df.groupBy(*by).agg(*[F.count(F.when(F.col(on) == v, 1)).alias(v) for v in values], F.count(F.lit(1)).alias("total"), *extra)


def pivot_first(df: DataFrame, by: list[str], on: str, values: list[str], value: str, order: list[str]) -> DataFrame:
    """One column for each of ``values`` with the group's first value in ``order``; rows with a null key are left out."""
    kept = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, on]))
    return kept.groupBy(*by).agg(*[F.min_by(value, F.when((F.col(on) == v) & F.col(value).isNotNull(), F.struct(*order))).alias(v) for v in values])


def no_vig(df: DataFrame, by: list[str], odds: str) -> DataFrame:
    """``implied`` (1 / odds), ``no_vig`` (its share of the group) and ``overround`` (the group's sum less 1); odds of 1 or less imply nothing."""
    implied = F.when(F.col(odds) > 1, 1 / F.col(odds))
    total = F.sum("implied").over(W.partitionBy(*by))
    return df.withColumn("implied", implied).withColumn("no_vig", F.col("implied") / total).withColumn("overround", total - 1)


def distinct_list(df: DataFrame, by: list[str], value: str, n: int, out: str = "listed") -> DataFrame:
    """The first ``n`` distinct values in order, joined by commas: duplicates go before values are gathered."""
    ranked = df.select(*by, value).where(F.col(value).isNotNull()).distinct().withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(value)))
    return ranked.where(F.col("_r") <= n).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(out))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, out: str = "mean") -> DataFrame:
    """Mean of ``value`` weighted by ``weight``, over rows that have a value and a weight above 0; the plain mean of the values where there is no such row."""
    both = F.col(value).isNotNull() & (F.col(weight) > 0)
    w = F.sum(F.when(both, F.col(weight)))
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.when(both, F.col(value) * F.col(weight))) / w, F.avg(value)).alias(out), F.coalesce(w, F.lit(0.0)).alias("weight"))


def shrink(df: DataFrame, by: list[str], parent: list[str], value: str, k: float) -> DataFrame:
    """Group means drawn to their parent's mean: (n * mean + k * prior) / (n + k); the prior alone where nothing was measured.

    ``by`` holds the columns of ``parent``; null keys are groups of their own. The
    parent's mean comes from the groups' sums, so the rows are read once.
    """
    one = df.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"))
    w = W.partitionBy(*parent)
    prior = F.try_divide(F.sum("_s").over(w), F.sum("n").over(w))
    return one.withColumn("prior", prior).select(
        *by, "n", "prior", ((F.col("_s") + k * F.col("prior")) / (F.col("n") + k)).alias("shrunk"), (F.col("n") > 0).alias("is_measured"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a hit rate."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def normal_interval(mean: Column, std: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a mean by its sample deviation; (0, 0) for one value or none."""
    half = z * std / F.sqrt(n)
    return F.when(n > 1, mean - half).otherwise(0.0), F.when(n > 1, mean + half).otherwise(0.0)


def calibration_bins(df: DataFrame, prob: str, hit: str, bins: int = 10) -> DataFrame:
    """Rows, mean probability, hit rate and gap of each equal-width bin; the last one is closed, empty ones are kept."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    found = df.where(F.col(prob).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("conf"), F.avg(F.col(hit).cast("double")).alias("acc"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select(  # one row a bin
        "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "conf", "acc",
        F.abs(F.col("conf") - F.col("acc")).alias("gap"))


def calibration_error(binned: DataFrame) -> DataFrame:
    """One row: the gaps' mean weighted by rows, the largest gap, and all rows; 0 where there are none."""
    n = F.sum("n")
    return binned.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("gap")), n), F.lit(0.0)).alias("ece"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("largest"), n.alias("n"))


def binary_metrics(df: DataFrame, prob: str, hit: str, eps: float = 1e-15) -> DataFrame:
    """Brier score, log-loss, accuracy and F1 at 0.5 and the area under the ROC curve.

    The area comes from counts of each distinct probability. Their running sums are
    taken inside ranges of probabilities, after those of whole ranges, so no task orders
    all of them.
    """
    y, p = F.col(hit).cast("double"), F.col(prob)
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    main = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg((p - y) ** 2).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
        F.avg(F.when((p >= 0.5) == (y == 1), 1.0).otherwise(0.0)).alias("accuracy"),
        F.try_divide(2 * F.sum(F.when(p >= 0.5, y).otherwise(0.0)), F.sum(y) + F.sum(F.when(p >= 0.5, 1.0).otherwise(0.0))).alias("f1"))
    each = df.groupBy(p.alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")).withColumn("range", F.floor(F.col("p") * 1024).cast("int"))
    ranges = each.groupBy("range").agg(F.sum("neg").alias("n"))
    under = ranges.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("under"))  # at most 1,025 rows
    within = F.sum("neg").over(W.partitionBy("range").orderBy("p").rowsBetween(W.unboundedPreceding, -1))
    auc = each.withColumn("below", F.coalesce(within, F.lit(0.0))).join(F.broadcast(under), "range").agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    return main.crossJoin(auc)  # one row each


def class_metrics(df: DataFrame, probs: list[str], label: Column, eps: float = 1e-15) -> DataFrame:
    """Rows, accuracy, log-loss and Brier score of several classes; ``label`` is the index of the right one, the first of equal ones is guessed."""
    p = [F.col(c) for c in probs]
    best = F.greatest(*p)
    guess = F.coalesce(*[F.when(c == best, i) for i, c in enumerate(p)])
    right = F.coalesce(*[F.when(label == i, c) for i, c in enumerate(p)])
    brier = sum(((c - F.when(label == i, 1.0).otherwise(0.0)) ** 2 for i, c in enumerate(p)), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(guess == label, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(-F.log(F.least(F.greatest(right, F.lit(eps)), F.lit(1 - eps)))).alias("log_loss"), F.avg(brier).alias("brier"))


def regression_metrics(df: DataFrame, guess: str, value: str) -> DataFrame:
    d = F.col(guess) - F.col(value)
    return df.agg(F.count(d).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))


def min_max(df: DataFrame, by: list[str], value: str, out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) in each group; 0.5 where the group is constant."""
    w = W.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.when(F.col(value).isNotNull(), 0.5)))


def impute_median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Nulls take their group's exact median (the mean of the middle two); null keys are a group too.

    A group's distinct values are held in memory: groups are meant to be small or of few values.
    """
    mid = df.groupBy(*by).agg(F.expr(f"percentile({value}, 0.5)").alias("_m"))
    return join_null_safe(df, mid, by, "left").withColumn(out, F.coalesce(value, "_m")).drop("_m")


def covered_columns(df: DataFrame, columns: list[str], least: float = 0.1) -> list[str]:
    """The columns of which more than ``least`` of the rows hold a value: one pass, one row to the driver."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if (shares[c] or 0.0) > least]


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, nulls, null_pct, distinct values) of each of ``columns``, in one pass over the rows."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}") for c in columns], *[F.countDistinct(c).alias(f"d_{c}") for c in columns])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("name"), F.col(f"n_{c}").alias("nulls"), F.round(100 * F.try_divide(F.col(f"n_{c}"), F.col("rows")), 2).alias("null_pct"),
        F.col(f"d_{c}").alias("distinct_values")) for c in columns])))


def outer_fold(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of all frames on the same keys; null keys meet."""
    return reduce(lambda a, b: join_null_safe(a, b, on, "full"), frames)
