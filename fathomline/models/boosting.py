"""Boosted regression trees for classes and counts: Newton steps on columns of gradients that stay in the table."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.models import Features, enough
from fathomline.operators.entities import shared_checkpoints

#: Probabilities and rates are kept this far from 0 in gradients.
LEAST = 1e-6


@dataclass
class BoostedModel:
    """Trees for each class and round; ``prob`` holds a probability for each class, or the rate of a count.

    A round fits one tree a class to the ratio of gradient and curvature, weighted by
    the curvature: a leaf's weighted mean is the Newton step there, so Spark's own
    regression tree finds both the splits and the steps. Objectives: ``softmax`` (labels 0
    to classes - 1) and ``poisson`` (a log link).
    """

    features: Features
    objective: str
    start: list[float]
    rate: float
    rounds: list[list[DecisionTreeRegressionModel]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], target: str, objective: str = "softmax", classes: int = 3, rounds: int = 40, depth: int = 3, rate: float = 0.3,
            held: Column | None = None, patience: int = 3, refit: bool = True, least_rows: int = 100, least_leaf: int = 20, seed: int = 42, known: Features | None = None, weight: str | None = None) -> BoostedModel:
        """Fits up to ``rounds`` rounds.

        ``held`` marks rows (a Column over ``df``) that trees aren't fitted on: rounds end
        when their loss hasn't fallen for ``patience`` of them, and the best number of
        rounds is then fitted anew on all rows (``refit``). Rows without a target take no
        part. What a round leaves is written to the checkpoint folder, so neither plans
        nor lost executors bring earlier rounds back.

        ``df`` may be ``counted``: ``weight`` is the number of rows, ``known`` the rows'
        features. A count of n then stands as up to ``least_leaf`` rows of equal weight,
        so a leaf has enough of these exactly if it has enough of the rows.
        """
        if objective not in ("softmax", "poisson"):
            raise ValueError(f"no objective is called {objective}")
        rows = df.where(F.col(target).isNotNull())
        enough(rows, least_rows, target, weight)
        shared_checkpoints(df.sparkSession)
        part = F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)
        rows = rows.withColumn("_w", F.lit(1.0))
        if weight is not None:
            stands = F.least(F.col(weight), F.lit(float(least_leaf)))
            rows = rows.withColumn("_w", F.explode(F.array_repeat(F.col(weight) / stands, stands.cast("int"))))
        features = known or Features.fit(rows.where(~part), columns)
        table = features(rows.withColumn("_held", part)).select("features", "_held", F.col(target).cast("double").alias("_y"), "_w").checkpoint()
        model = cls._boost(features, table, objective, classes, rounds, depth, rate, patience, least_leaf, seed)
        if held is not None and refit:
            losses, best = model.losses, len(model.rounds)
            features = known or Features.fit(rows, columns)
            table = features(rows).select("features", F.lit(False).alias("_held"), F.col(target).cast("double").alias("_y"), "_w").checkpoint()
            model = cls._boost(features, table, objective, classes, best, depth, rate, None, least_leaf, seed)
            model.losses = losses
        return model

    @classmethod
    def _boost(cls, features: Features, table: DataFrame, objective: str, classes: int, rounds: int, depth: int, rate: float, patience: int | None, least_leaf: int, seed: int) -> BoostedModel:
        k = classes if objective == "softmax" else 1
        train = F.when(~F.col("_held"), F.col("_w"))
        if objective == "softmax":
            row = table.agg(F.sum(train).alias("n"), *[F.sum(train * (F.col("_y") == i).cast("double")).alias(f"c{i}") for i in range(k)]).first()
            start = [float(log(max(row[f"c{i}"] or 0.0, 0.5) / row.n)) for i in range(k)]
        else:
            start = [float(log(max(table.agg(F.try_divide(F.sum(train * F.col("_y")), F.sum(train))).first()[0] or 0.0, LEAST)))]
        model = cls(features, objective, start, rate * ((k - 1) / k if k > 1 else 1.0))
        now = table.withColumns({f"_f{i}": F.lit(s) for i, s in enumerate(start)})
        watched = patience is not None and table.where("_held").limit(1).count() > 0
        best, best_at = float("inf"), 0
        for n in range(rounds):
            values = model.values([F.col(f"_f{i}") for i in range(k)])
            trees = []
            step = now
            for i, v in enumerate(values):
                hit = (F.col("_y") == i).cast("double") if objective == "softmax" else F.col("_y")
                bend = F.greatest(v * (1 - v) if objective == "softmax" else v, F.lit(LEAST))
                target = now.where(~F.col("_held")).select("features", ((hit - v) / bend).alias("z"), (bend * F.col("_w")).alias("w"))
                tree = DecisionTreeRegressor(featuresCol="features", labelCol="z", weightCol="w", predictionCol=f"_t{i}", maxDepth=depth, minInstancesPerNode=least_leaf, seed=seed + n).fit(target)
                trees.append(tree)
                step = tree.transform(step)
            now = step.withColumns({f"_f{i}": F.col(f"_f{i}") + model.rate * F.col(f"_t{i}") for i in range(k)}).drop(*[f"_t{i}" for i in range(k)]).checkpoint()
            model.rounds.append(trees)
            if watched:
                loss = now.where("_held").agg(F.sum(F.col("_w") * model.loss([F.col(f"_f{i}") for i in range(k)], F.col("_y"))) / F.sum("_w")).first()[0]
                model.losses.append(loss)
                if loss < best - 1e-9:
                    best, best_at = loss, n + 1
                elif n + 1 - best_at >= patience:
                    break
        if watched:
            model.rounds = model.rounds[:max(best_at, 1)]
        return model

    def values(self, raw: list[Column]) -> list[Column]:
        """Probabilities of raw scores, or the rate."""
        if self.objective == "poisson":
            return [F.exp(F.least(F.greatest(raw[0], F.lit(-15.0)), F.lit(15.0)))]
        most = F.greatest(*raw) if len(raw) > 1 else raw[0]
        parts = [F.exp(r - most) for r in raw]
        return [p / sum(parts[1:], parts[0]) for p in parts]

    def loss(self, raw: list[Column], y: Column) -> Column:
        """Log-loss, or half the Poisson deviance less what doesn't depend on the model."""
        values = self.values(raw)
        if self.objective == "poisson":
            return values[0] - y * F.log(values[0])
        return -F.log(F.greatest(F.coalesce(*[F.when(y == i, v) for i, v in enumerate(values)]), F.lit(LEAST)))

    def __call__(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """``df`` with ``out``: an array of probabilities, or a rate between 0.01 and 15."""
        scored = self.features(df, "_features")
        raw = [F.lit(s) for s in self.start]
        for n, trees in enumerate(self.rounds):
            for i, tree in enumerate(trees):
                name = f"_t{n}_{i}"
                scored = tree.copy().setFeaturesCol("_features").setPredictionCol(name).transform(scored)
                raw[i] = raw[i] + self.rate * F.col(name)
        values = self.values(raw)
        result = F.array(*values) if self.objective == "softmax" else F.least(F.greatest(values[0], F.lit(0.01)), F.lit(15.0))
        return scored.withColumn(out, result).select(*df.columns, out)

    def importances(self, df: DataFrame, n: int = 20) -> DataFrame:
        """(feature, importance): the first ``n`` by their mean share over all trees."""
        total = [0.0] * len(self.features.names)
        for trees in self.rounds:
            for tree in trees:
                total = [a + b for a, b in zip(total, tree.featureImportances.toArray().tolist(), strict=True)]
        whole = sum(total) or 1.0
        rows = sorted(zip(self.features.names, (t / whole for t in total), strict=True), key=lambda x: (-x[1], x[0]))[:n]
        return df.sparkSession.createDataFrame(rows, "feature string, importance double")
