"""Classes in an order by cumulative fits, and weights that match one table's means to another's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.models import Features
from fathomline.operators.entities import shared_checkpoints


def logistic() -> Estimator:
    return LogisticRegression(regParam=1e-3)


@dataclass
class OrdinalModel:
    """Frank and Hall's method: a fit of "above class k" for all but the last of the classes 0, 1, ...

    ``learner`` makes any Spark ML classifier of two classes with a probability. A class
    has the difference of two neighbouring cumulative probabilities, negative ones are
    cut to 0, and the rest is scaled to a sum of 1.
    """

    features: Features
    models: list[Model]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], target: str, classes: int = 3, learner: Callable[[], Estimator] = logistic, weight: str | None = None, least_rows: int = 100) -> OrdinalModel:
        rows = df.where(F.col(target).isNotNull())
        if rows.limit(least_rows).count() < least_rows:
            raise ValueError(f"fewer than {least_rows} rows have {target}")
        features = Features.fit(rows, columns)
        table = features(rows)
        models = []
        for k in range(classes - 1):
            one = learner()
            one = one.copy({one.getParam("featuresCol"): "features", one.getParam("labelCol"): "_above"} | ({one.getParam("weightCol"): weight} if weight else {}))
            models.append(one.fit(table.select("features", (F.col(target) > k).cast("double").alias("_above"), *([weight] if weight else []))))
        return cls(features, models)

    def __call__(self, df: DataFrame, out: str = "prob", above: str | None = None) -> DataFrame:
        """``df`` with ``out``, a probability for each class, and if named ``above``, the cumulative ones, made to fall."""
        scored = self.features(df, "_features")
        up = []
        for k, model in enumerate(self.models):
            names = {"featuresCol": "_features", "probabilityCol": f"_p{k}", "rawPredictionCol": f"_r{k}", "predictionCol": f"_c{k}"}
            scored = model.copy({model.getParam(p): v for p, v in names.items()}).transform(scored)
            up.append(vector_to_array(F.col(f"_p{k}"))[1])
        parts = [F.greatest(a - b, F.lit(0.0)) for a, b in zip([F.lit(1.0), *up], [*up, F.lit(0.0)], strict=True)]
        scored = scored.withColumn("_parts", F.array(*parts)).withColumn("_sum", F.aggregate("_parts", F.lit(0.0), lambda s, x: s + x))
        scored = scored.withColumn(out, F.transform("_parts", lambda p: p / F.col("_sum")))
        if above:
            n = len(self.models)
            scored = scored.withColumn(above, F.transform(F.sequence(F.lit(2), F.lit(n + 1)), lambda k: F.aggregate(F.slice(out, k, F.lit(n + 1)), F.lit(0.0), lambda s, x: s + x)))
        return scored.select(*df.columns, out, *([above] if above else []))


def mean_products(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The means of all products of two entries of an array column of ``n`` numbers: tasks sum their own batches, one row a task moves."""
    def run(batches):
        total, count = np.zeros((n, n)), 0
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            total, count = total + z.T @ z, count + len(z)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([count])], ["s", "n"])

    parts = rows.select(column).mapInArrow(run, "s array<double>, n long")
    row = parts.agg(Summarizer.sum(array_to_vector("s")).alias("s"), F.sum("n").alias("n")).first()
    return np.array(row.s.toArray()).reshape(n, n) / max(row.n, 1)


@dataclass
class MeanMatching:
    """Weights of source rows under which their means of random features meet the target rows' means.

    The features are cosines of random projections, whose inner products stand for a
    Gaussian kernel, so the work is linear in the rows where a kernel matrix is
    quadratic. A row's weight is 1 less the product of its features and ``theta``, kept
    between 0 and ``most``; ``theta`` has one number a feature and moves by what the
    means still miss, scaled by the features' mean products (Newton's step where no
    weight is cut), so nothing is held for a row between steps.
    """

    columns: list[str]
    center: np.ndarray
    spread: np.ndarray
    angles: np.ndarray
    shift: np.ndarray
    theta: np.ndarray
    most: float
    misses: list[float]

    @classmethod
    def fit(cls, source: DataFrame, target: DataFrame, columns: list[str], features: int = 32, width: float = 1.0, most: float = 10.0, steps: int = 40, within: float = 0.005, seed: int = 42) -> MeanMatching:
        """Steps until the means differ by at most ``within`` in every feature, or for ``steps`` steps; ``misses`` has the largest difference before each.

        Columns are standardised by the target's means and deviations; a null counts as the mean.
        """
        shared_checkpoints(source.sparkSession)
        row = target.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev))]).first()
        center = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
        spread = np.array([row[f"s{i}"] or 1.0 for i in range(len(columns))])
        rng = np.random.default_rng(seed)
        model = cls(columns, center, spread, rng.normal(0, 1 / width, (features, len(columns))), rng.uniform(0, 2 * np.pi, features), np.zeros(features), most, [])
        mean = lambda df, w: np.array(df.agg(Summarizer.mean(array_to_vector("_z"), w).alias("m") if w is not None else Summarizer.mean(array_to_vector("_z")).alias("m")).first().m.toArray())
        goal = mean(target.select(model.cosines().alias("_z")), None)
        rows = source.select(model.cosines().alias("_z")).checkpoint()
        products = mean_products(rows, "_z", features)
        for _ in range(steps):
            weighted = rows.withColumn("_w", model.of(F.col("_z")))
            miss = mean(weighted, F.col("_w")) - goal
            model.misses.append(float(np.abs(miss).max()))
            if model.misses[-1] <= within:
                break
            model.theta = model.theta + np.linalg.solve(products + 1e-4 * np.eye(features), miss)
        return model

    def cosines(self) -> Column:
        scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(m)) / float(s) for c, m, s in zip(self.columns, self.center, self.spread, strict=True)]
        return F.array(*[F.cos(sum((float(a) * x for a, x in zip(row, scaled, strict=True)), F.lit(float(b)))) for row, b in zip(self.angles, self.shift, strict=True)])

    def of(self, z: Column) -> Column:
        """The weight of a row by its features; theta is one literal, so a step's plan compiles as the one before."""
        product = F.aggregate(F.zip_with(z, F.lit(self.theta.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.least(F.greatest(1 - product, F.lit(0.0)), F.lit(self.most))

    def __call__(self, df: DataFrame, out: str = "weight") -> DataFrame:
        return df.withColumn(out, self.of(self.cosines()))
