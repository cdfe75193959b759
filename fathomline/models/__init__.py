"""Fitted models: goal rates, boosted trees, dependence of low scores, blends, calibration. Spark ML does the fitting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.scalars import blend_weight, clip
from fathomline.operators.aggregates import covered_columns
from fathomline.operators.entities import shared_checkpoints


@dataclass
class Features:
    """The features with values in more than a tenth of the rows, and the medians that stand in for nulls."""

    names: list[str]
    medians: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], least: float = 0.1) -> Features:
        names = covered_columns(df, columns, least)
        row = df.agg(*[F.expr(f"approx_percentile(`{c}`, 0.5, 100000)").alias(c) for c in names]).first() if names else {}
        return cls(names, {c: float(row[c] or 0.0) for c in names})

    def __call__(self, df: DataFrame, out: str = "features") -> DataFrame:
        whole = df.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items()})
        made = VectorAssembler(inputCols=[f"_x_{c}" for c in self.names], outputCol=out).transform(whole)
        return made.drop(*[f"_x_{c}" for c in self.names])


def counted(df: DataFrame, columns: list[str], out: str = "n") -> DataFrame:
    """Equal rows once, with their number as a weight: models fitted on them are those of all rows, but for rounding."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias(out))


def enough(rows: DataFrame, least: int, target: str, weight: str | None = None) -> None:
    if (rows.limit(least).count() if weight is None else rows.agg(F.sum(weight)).first()[0] or 0) < least:
        raise ValueError(f"fewer than {least} rows have {target}")


@dataclass
class RateModel:
    """A Poisson regression with a log link; rates are cut to 0.01 and 15."""

    features: Features
    model: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], target: str, least_rows: int = 100, features: Features | None = None, weight: str | None = None) -> RateModel:
        """``df`` may be ``counted``; then ``weight`` is the number of rows, and ``features`` those of the rows."""
        rows = df.where(F.col(target).isNotNull())
        enough(rows, least_rows, target, weight)
        features = features or Features.fit(rows, columns)
        glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=target, featuresCol="features", predictionCol="_rate", regParam=1e-3, maxIter=50)
        if weight is not None:
            glm.setWeightCol("_weight")
        return cls(features, glm.fit(features(rows).select("features", F.col(target).cast("double").alias(target), *([F.col(weight).alias("_weight")] if weight else []))))

    def __call__(self, df: DataFrame, out: str) -> DataFrame:
        return self.model.transform(self.features(df)).withColumn(out, clip(F.col("_rate"), 0.01, 15.0)).drop("features", "_rate")

    def weights(self, df: DataFrame, n: int = 20) -> DataFrame:
        """(feature, weight): the features of the largest coefficients, in the order of their size."""
        rows = sorted(zip(self.features.names, self.model.coefficients.toArray().tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))[:n]
        return df.sparkSession.createDataFrame(rows, "feature string, weight double")


@dataclass
class TreeModel:
    """Boosted trees for two classes, multinomial regression for more; ``prob`` holds a probability for each class."""

    features: Features
    model: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], target: str, classes: int = 2, rounds: int = 20, depth: int = 4, least_rows: int = 100, seed: int = 42) -> TreeModel:
        rows = df.where(F.col(target).isNotNull())
        if rows.limit(least_rows).count() < least_rows:
            raise ValueError(f"fewer than {least_rows} rows have {target}")
        features = Features.fit(rows, columns)
        settings = {"labelCol": target, "featuresCol": "features"}
        learner = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, **settings) if classes == 2 else LogisticRegression(family="multinomial", regParam=1e-3, **settings)
        return cls(features, learner.fit(features(rows).select("features", F.col(target).cast("double").alias(target))))

    def __call__(self, df: DataFrame, out: str = "prob") -> DataFrame:
        return self.model.transform(self.features(df)).withColumn(out, vector_to_array("probability")).drop("features", "probability", "rawPrediction", "prediction")

    def importances(self, df: DataFrame, n: int = 20) -> DataFrame:
        rows = sorted(zip(self.features.names, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]
        return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def fit_rho(df: DataFrame, home: str, away: str, home_score: str, away_score: str, low: float = -0.30, high: float = 0.30, rounds: int = 4, points: int = 25, weight: str | None = None) -> float:
    """The dependence of low scores that makes the scores likeliest, by a grid that is made finer around its best point.

    Only the four low scores depend on it: each round is one aggregate of as many sums as the grid has points.
    ``weight`` is the number of rows where ``df`` is ``counted``.
    """
    times = F.col(weight) if weight else F.lit(1.0)
    rows = df.where(F.col(home_score).isNotNull() & F.col(away_score).isNotNull()).select(
        F.col(home).alias("h"), F.col(away).alias("a"), F.col(home_score).alias("x"), F.col(away_score).alias("y"), times.alias("w")).where("x <= 1 AND y <= 1")

    def factor(rho: float) -> Column:
        return F.when((F.col("x") == 0) & (F.col("y") == 0), 1 - F.col("h") * F.col("a") * rho).when((F.col("x") == 0) & (F.col("y") == 1), 1 + F.col("h") * rho).when(
            (F.col("x") == 1) & (F.col("y") == 0), 1 + F.col("a") * rho).otherwise(1 - rho)

    best = 0.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        row = rows.agg(*[F.sum(F.col("w") * F.log(F.greatest(factor(r), F.lit(1e-10)))).alias(f"r{i}") for i, r in enumerate(grid)]).first()
        if row.r0 is None:
            return 0.0
        k = max(range(points), key=lambda i: row[f"r{i}"])
        best, low, high = grid[k], grid[max(k - 1, 0)], grid[min(k + 1, points - 1)]
    return best


def fit_blend(df: DataFrame, first: list[str], second: list[str], label: str, rating_gap: str, elo_gap: str, rounds: int = 3, points: int = 3) -> dict[str, float]:
    """The blend's four parameters of least log-loss, by a grid that is made finer around its best point; ``label`` is the index of the right class.

    All points of a round are sums of one aggregate. Points need strong > close + 0.02 and high >= low.
    """
    bounds = {"close": (0.0, 0.35), "strong": (0.2, 0.9), "low": (0.0, 0.6), "high": (0.2, 1.0)}

    def loss(p: dict[str, float]) -> Column:
        w, _, _ = blend_weight(F.col(rating_gap), F.col(elo_gap), **p)
        probs = [F.greatest((1 - w) * F.col(a) + w * F.col(b), F.lit(1e-6)) for a, b in zip(first, second, strict=True)]
        right = F.coalesce(*[F.when(F.col(label) == i, q) for i, q in enumerate(probs)])
        return F.avg(-F.log(right / sum(probs[1:], probs[0])))

    best = {n: (a + b) / 2 for n, (a, b) in bounds.items()}
    for _ in range(rounds):
        grid = [{}]
        for n, (a, b) in bounds.items():
            grid = [g | {n: a + (b - a) * i / (points - 1)} for g in grid for i in range(points)]
        grid = [g for g in grid if g["strong"] > g["close"] + 0.02 and g["high"] >= g["low"]]
        row = df.agg(*[loss(g).alias(f"g{i}") for i, g in enumerate(grid)]).first()
        if row.g0 is None:
            return best
        best = grid[min(range(len(grid)), key=lambda i: row[f"g{i}"])]
        bounds = {n: (max(lo, best[n] - (hi - lo) / (points - 1)), min(hi, best[n] + (hi - lo) / (points - 1))) for n, (lo, hi) in bounds.items()}
    return best


def evolve_blend(df: DataFrame, first: list[str], second: list[str], label: str, rating_gap: str, elo_gap: str, generations: int = 80, size: int = 48, tolerance: float = 1e-5, seed: int = 42) -> tuple[dict[str, float], float]:
    """The blend's four parameters of least log-loss, and that loss, by differential evolution with a fixed seed.

    A generation is one aggregate: every row meets the whole population, an array of
    ``size`` points of constant size, and is summed up by point before anything moves.
    Points off strong > close + 0.02 or high >= low lose to any other. It ends when the
    population's losses differ by no more than ``tolerance`` of their mean.
    """
    names, bounds = ("close", "strong", "low", "high"), np.array([(0.02, 0.35), (0.20, 1.00), (0.00, 0.80), (0.05, 1.00)])
    w, _, _ = blend_weight(F.col("_g"), F.col("_e"), *[F.get("_p", F.lit(i)) for i in range(4)])
    rows = df.where(F.col(label).isNotNull()).select(F.col(rating_gap).alias("_g"), F.col(elo_gap).alias("_e"), F.col(label).alias("_y"), *[F.col(c).alias(f"_{s}{i}") for s, cs in (("a", first), ("b", second)) for i, c in enumerate(cs)])
    probs = [F.greatest((1 - w) * F.col(f"_a{i}") + w * F.col(f"_b{i}"), F.lit(1e-6)) for i in range(len(first))]
    right = F.coalesce(*[F.when(F.col("_y") == i, q) for i, q in enumerate(probs)])
    shared_checkpoints(df.sparkSession)
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).checkpoint()  # equal rows count once

    def losses(points: np.ndarray) -> np.ndarray:
        fit = (points[:, 1] > points[:, 0] + 0.02) & (points[:, 3] >= points[:, 2])
        out = np.where(fit, np.inf, 10 + np.abs(points[:, 1] - points[:, 0]) + np.abs(points[:, 3] - points[:, 2]))
        if fit.any():
            met = rows.select("*", F.posexplode(F.lit(points[fit].tolist())).alias("_k", "_p"))
            sums = met.groupBy("_k").agg(F.sum(-F.log(right / sum(probs[1:], probs[0])) * F.col("_n")).alias("s"), F.sum("_n").alias("n")).collect()
            out[np.flatnonzero(fit)[[r._k for r in sums]]] = [np.inf if r.s is None else r.s / r.n for r in sums]
        return out

    rng = np.random.default_rng(seed)
    spread = bounds[:, 1] - bounds[:, 0]
    strata = (np.argsort(rng.random((4, size)), axis=1).T + rng.random((size, 4))) / size
    points = bounds[:, 0] + strata * spread
    points[0] = [0.15, 0.45, 0.25, 0.80]
    found = losses(points)
    for _ in range(generations):
        if not np.isfinite(found).any():
            break
        best = points[np.argmin(found)]
        factor = rng.uniform(0.5, 1.0)
        a, b = (points[rng.permuted(np.arange(size))] for _ in range(2))
        mutant = best + factor * (a - b)
        off = (mutant < bounds[:, 0]) | (mutant > bounds[:, 1])
        mutant = np.where(off, bounds[:, 0] + rng.random((size, 4)) * spread, mutant)
        cross = rng.random((size, 4)) < 0.7
        cross[np.arange(size), rng.integers(0, 4, size)] = True
        trial = np.where(cross, mutant, points)
        got = losses(trial)
        better = got <= found
        points[better], found[better] = trial[better], got[better]
        usable = found[found < 10]
        if len(usable) and np.std(found) <= tolerance * abs(np.mean(found)):
            break
    k = int(np.argmin(found))
    return {n: round(float(v), 6) for n, v in zip(names, points[k], strict=True)}, float(found[k])


def blend_loss(df: DataFrame, first: list[str], second: list[str], label: str, rating_gap: str, elo_gap: str, params: dict[str, float]) -> float:
    """The log-loss of one point of the blend's parameters."""
    w, _, _ = blend_weight(F.col(rating_gap), F.col(elo_gap), **params)
    probs = [F.greatest((1 - w) * F.col(a) + w * F.col(b), F.lit(1e-6)) for a, b in zip(first, second, strict=True)]
    right = F.coalesce(*[F.when(F.col(label) == i, q) for i, q in enumerate(probs)])
    return df.agg(F.avg(-F.log(right / sum(probs[1:], probs[0])))).first()[0]


def fit_isotonic(df: DataFrame, probs: list[str], label: str) -> list[tuple[list[float], list[float]]]:
    """For each class the knots (thresholds, values) of a rising curve of its share over its probability, one against the rest. Probabilities are rounded to four digits first, which bounds the knots."""
    out = []
    for i, c in enumerate(probs):
        rows = df.where(F.col(c).isNotNull() & F.col(label).isNotNull()).groupBy(F.round(c, 4).alias("p")).agg(
            F.avg((F.col(label) == i).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
        fitted = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="n").fit(rows)
        out.append((fitted.boundaries.toArray().tolist(), fitted.predictions.toArray().tolist()))
    return out
