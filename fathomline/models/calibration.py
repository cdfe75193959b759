"""Curves that set probabilities right, each fitted on the other folds' rows, for many markets in one pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probabilities are rounded to so many digits before they are counted, which bounds what a curve is fitted on.
DIGITS = 4


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest values that never fall: neighbours that do are pooled to their weighted mean."""
    means, sizes, counts = [], [], []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        means.append(v)
        sizes.append(w)
        counts.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            v, w, n = means.pop(), sizes.pop(), counts.pop()
            whole = sizes[-1] + w
            means[-1] = (means[-1] * sizes[-1] + v * w) / whole
            sizes[-1] = whole
            counts[-1] += n
    return np.repeat(means, counts)


def fold_of(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).cast("int")


def long_form(df: DataFrame, curves: dict[str, tuple[str, Column]], key: str, folds: int) -> DataFrame:
    """(key, fold, curve, p, y): a row for each probability whose outcome is known; the fold comes from the key alone."""
    rows = df.select(key, fold_of(key, folds).alias("fold"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("curve"), F.col(p).cast("double").alias("p"), hit.cast("double").alias("y")) for n, (p, hit) in curves.items()])))
    return rows.where(F.col("p").isNotNull() & F.col("y").isNotNull())


def fold_curves(rows: DataFrame, folds: int) -> DataFrame:
    """(curve, fold, at, fitted): for each curve and fold the rising curve over all other folds, at every probability that is there.

    ``rows`` is in long form. They are counted by curve, fold and rounded probability
    once, so a curve is fitted on as many points as probabilities have values. Between
    points that the other folds know it is linear, outside it is flat.
    """
    counts = rows.groupBy("curve", "fold", F.round("p", DIGITS).alias("at")).agg(F.sum("y").alias("hits"), F.count(F.lit(1)).cast("double").alias("n"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        name, out = part["curve"].iloc[0], []
        every = part.groupby("at")[["hits", "n"]].sum()
        for k in range(folds):
            own = part[part["fold"] == k].groupby("at")[["hits", "n"]].sum().reindex(every.index, fill_value=0.0)
            rest = every - own
            rest = rest[rest["n"] > 0]
            at = every.index.to_numpy()
            fitted = np.interp(at, rest.index.to_numpy(), rising((rest["hits"] / rest["n"]).to_numpy(), rest["n"].to_numpy())) if len(rest) else at
            out.append(pd.DataFrame({"curve": name, "fold": k, "at": at, "fitted": fitted}))
        return pd.concat(out)

    return counts.groupBy("curve").applyInPandas(fit, "curve string, fold int, at double, fitted double")


def out_of_fold(df: DataFrame, curves: dict[str, tuple[str, Column]], key: str, folds: int = 5) -> DataFrame:
    """The long form of ``df`` with ``fitted``, each probability through a curve that its own fold had no part in.

    ``curves`` are names with a probability column and an outcome (a Column of 0 and 1).
    Null probabilities and outcomes take no part. A row is in one fold for all curves.
    """
    rows = long_form(df, curves, key, folds)
    found = fold_curves(rows, folds)  # a curve's folds times the values that a rounded probability has
    return rows.withColumn("at", F.round("p", DIGITS)).join(found, ["curve", "fold", "at"]).drop("at")


def with_fitted(df: DataFrame, p: str, key: str, found: DataFrame, out: str, folds: int = 5) -> DataFrame:
    """``df`` with ``out``: ``p`` through the curve that ``found`` (one curve of ``fold_curves``) has for the row's fold; rows whose ``p`` it doesn't hold go."""
    curve = F.broadcast(found.select(F.col("fold").alias("_fold"), F.col("at").alias("_at"), F.col("fitted").alias(out)))  # folds times the values of a rounded probability
    return df.withColumns({"_fold": fold_of(key, folds), "_at": F.round(F.col(p).cast("double"), DIGITS)}).join(curve, ["_fold", "_at"]).drop("_fold", "_at")


def calibration_report(scored: DataFrame, bins: int = 10, least: float = 1e-6) -> DataFrame:
    """A row for each curve of ``scored`` (curve, p, fitted, y): rows, calibration error, largest gap and log-loss, before and after."""
    both = scored.select("curve", "y", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("q")) for k, c in (("raw", "p"), ("fitted", "fitted"))])))
    q, y = F.least(F.greatest("q", F.lit(least)), F.lit(1 - least)), F.col("y")
    binned = both.groupBy("curve", "kind", F.least(F.floor(F.col("q") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("q").alias("conf"), F.avg("y").alias("acc"), F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("s"))
    gap = F.abs(F.col("conf") - F.col("acc"))
    each = binned.groupBy("curve", "kind").agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("largest"), (F.sum("s") / F.sum("n")).alias("log_loss"), F.sum("n").alias("n"))
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}")
    return each.groupBy("curve").agg(F.max("n").alias("n"), *[pick(c, k) for c in ("ece", "largest", "log_loss") for k in ("raw", "fitted")])
