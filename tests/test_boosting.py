"""Boosted, ordinal and matched fits, and the blend's evolution, by what they must beat or keep."""

import numpy as np
import pytest
from fathomline import models as M
from fathomline.models import boosting as B
from fathomline.models import ordinal as O
from fathomline.operators import aggregates as A
from fathomline.plans.models import blend_parameters, classes_boosted, classes_ordinal, goal_counts_boosted, two_models
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bent(spark):
    """A class and a count that depend on two features together, as no line can say; a third is half empty."""
    rng = np.random.default_rng(4)
    x, y = rng.uniform(-1, 1, 4000), rng.uniform(-1, 1, 4000)
    side = np.where(x * y > 0.1, 0, np.where(x * y < -0.1, 2, 1))
    side = np.where(rng.random(4000) < 0.15, rng.integers(0, 3, 4000), side)
    goals = rng.poisson(np.where(x * y > 0, 3.0, 0.6))
    rows = [(int(i), float(a), float(b), None if i % 2 else float(a), int(c), int(g)) for i, (a, b, c, g) in enumerate(zip(x, y, side, goals, strict=True))]
    return spark.createDataFrame(rows, "k long, x double, y double, z double, side int, goals int").repartition(4).cache()


NAMES = ["p0", "p1", "p2"]
HELD, LEARNT = "k % 4 = 0", "k % 4 <> 0"


def log_loss(scored):
    return A.class_metrics(scored.select("side", *[F.col("prob")[i].alias(n) for i, n in enumerate(NAMES)]), NAMES, F.col("side")).first().log_loss


def test_boosted_classes_beat_the_line(bent):
    model = B.BoostedModel.fit(bent, ["x", "y", "z"], "side", rounds=8, depth=4, held=F.expr(HELD), patience=2, refit=False)
    line = M.TreeModel.fit(bent.where(LEARNT), ["x", "y", "z"], "side", classes=3)
    held = bent.where(HELD)
    scored = model(held)
    assert log_loss(scored) < log_loss(line(held)) - 0.15
    assert model.losses[0] > min(model.losses) and len(model.rounds) == model.losses.index(min(model.losses)) + 1
    row = scored.agg(F.max(F.abs(F.aggregate("prob", F.lit(0.0), lambda s, p: s + p) - 1)).alias("off"), F.min(F.array_min("prob")).alias("least")).first()
    assert row.off < 1e-9 and row.least > 0 and scored.columns == [*held.columns, "prob"]
    shares = {r.feature: r.importance for r in model.importances(bent).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["x"] > 0.1 and shares["y"] > 0.3


def test_the_best_rounds_are_fitted_anew_on_everything(bent):
    some = bent.where("k < 1200")
    model = B.BoostedModel.fit(some, ["x", "y"], "side", rounds=3, held=F.expr(HELD), patience=1)
    again = B.BoostedModel.fit(some, ["x", "y"], "side", rounds=len(model.rounds))
    a, b = (m(some.orderBy("k").limit(50)).select("k", "prob").orderBy("k").collect() for m in (model, again))
    assert a == b  # as if there had been no held rows
    assert len(model.losses) >= len(model.rounds)


def test_boosted_counts_beat_the_line(bent):
    trees = B.BoostedModel.fit(bent, ["x", "y"], "goals", objective="poisson", rounds=8, held=F.expr(HELD), patience=2, refit=False)
    held = trees(M.RateModel.fit(bent.where(LEARNT), ["x", "y"], "goals")(bent.where(HELD), "line"), "trees")
    y = F.col("goals")
    deviance = lambda r: F.avg(2 * (F.when(y > 0, y * F.log(y / F.col(r))).otherwise(0.0) - (y - F.col(r))))
    row = held.agg(deviance("line").alias("line"), deviance("trees").alias("trees"), F.avg(F.abs(y - F.col("line"))).alias("line_mae"), F.avg(F.abs(y - F.col("trees"))).alias("trees_mae"), F.min("trees").alias("low")).first()
    assert row.trees < 0.75 * row.line and row.trees_mae < row.line_mae - 0.2 and row.low >= 0.01


def test_faulty_fits(bent):
    with pytest.raises(ValueError, match="fewer than"):
        B.BoostedModel.fit(bent.where("k < 50"), ["x"], "side")
    with pytest.raises(ValueError, match="objective"):
        B.BoostedModel.fit(bent, ["x"], "side", objective="other")


@pytest.mark.parametrize("learner", [O.logistic, lambda: GBTClassifier(maxIter=3, maxDepth=3, seed=1)], ids=["logistic", "trees"])
def test_ordinal_classes(bent, learner):
    model = O.OrdinalModel.fit(bent.where(LEARNT), ["x", "y"], "side", learner=learner)
    rows = model(bent.where(HELD), above="above").select("prob", "above").collect()
    assert all(sum(r.prob) == pytest.approx(1) and min(r.prob) >= 0 for r in rows)
    assert all(len(r.above) == 2 and 1 + 1e-9 >= r.above[0] >= r.above[1] - 1e-9 >= -1e-9 for r in rows)


def test_ordinal_of_a_monotone_class(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, 3000)
    side = np.digitize(x + rng.logistic(0, 0.5, 3000), [-0.7, 0.7])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, side, strict=True)], "x double, side int")
    rows = O.OrdinalModel.fit(df, ["x"], "side")(df).select("x", "prob").orderBy("x").collect()
    assert rows[0].prob[0] > 0.9 and rows[-1].prob[2] > 0.9 and rows[1500].prob[1] > 0.4


def test_weights_match_the_means(spark):
    rng = np.random.default_rng(3)
    make = lambda m, n: spark.createDataFrame([(float(a), float(b) if b > -2 else None) for a, b in rng.normal(m, 1, (n, 2))], "x double, y double").repartition(3)
    source, target = make(0.6, 4000), make(0.0, 3000)
    model = O.MeanMatching.fit(source, target, ["x", "y"], within=0.01, steps=60)
    assert model.misses[-1] <= 0.01 < model.misses[0] / 5
    w = model(source)
    row = w.agg(F.sum(F.col("weight") * F.col("x")).alias("s"), F.sum("weight").alias("w"), F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    assert abs(row.s / row.w) < 0.1 and row.lo >= 0 and row.hi <= 10
    assert model.theta.tolist() == O.MeanMatching.fit(source, target, ["x", "y"], within=0.01, steps=60).theta.tolist()


def test_evolution_is_no_worse_than_the_grid(spark):
    t = two_models(spark, SMALL)
    names = (["a0", "a1"], ["b0", "b1"], "y", "gap", "elo")
    best, loss = M.evolve_blend(t, *names, generations=20)
    assert M.blend_loss(t, *names, best) == pytest.approx(loss, abs=1e-5)
    assert loss <= M.blend_loss(t, *names, M.fit_blend(t, *names, rounds=2)) + 5e-5
    assert (best, loss) == M.evolve_blend(t, *names, generations=20)
    assert best["strong"] > best["close"] + 0.02 and best["high"] >= best["low"]


def test_queries(spark):
    r = classes_boosted(spark, MIDDLE).first()
    assert r.n > 1000 and r.log_loss < 1.09 and r.rounds >= 1 and "x1" in r.features
    assert {r.kind: r.log_loss < 1.09 for r in classes_ordinal(spark, MIDDLE).collect()} == {"plain": True, "weighted": True}
    rows = {r.model: r for r in goal_counts_boosted(spark, MIDDLE).collect()}
    assert rows["trees"].deviance < rows["line"].deviance + 0.02
    p = {r.name: r.value for r in blend_parameters(spark, SMALL).collect()}
    assert p["high"] > 0.7 and p["low"] < 0.35 and p["log_loss"] < 0.7


def test_counts_of_equal_rows_give_the_models_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), None if a == 3 else float(b), float(y)) for a, b, y in zip(rng.integers(0, 6, 900), rng.poisson(2, 900), rng.integers(0, 3, 900), strict=True)]
    t = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    columns = ["a", "b"]
    known, few = M.Features.fit(t, columns), M.counted(t, [*columns, "y"])
    assert few.agg(F.sum("n")).first()[0] == 900 and few.count() < 200 and few.where("n < 20").count() > 20
    score = lambda model: {tuple(r[:2]): r[2] for r in model(t.select(*columns).distinct()).collect()}
    each, whole = (score(B.BoostedModel.fit(df, columns, "y", rounds=2, depth=5, **more)) for df, more in ((t, {}), (few, {"known": known, "weight": "n"})))
    assert each.keys() == whole.keys() and all(each[k] == pytest.approx(whole[k], abs=1e-9) for k in each)
    rate = lambda df, **more: {tuple(r[:2]): r[2] for r in M.RateModel.fit(df, columns, "y", **more)(t.select(*columns).distinct(), "rate").collect()}
    assert rate(few, features=known, weight="n") == pytest.approx(rate(t), abs=1e-6)
    scores = lambda df, **more: M.fit_rho(df.withColumn("h", F.lit(1.2)), "h", "h", "y", "a", **more)
    assert scores(few, weight="n") == pytest.approx(scores(t), abs=1e-9)
    with pytest.raises(ValueError, match="fewer"):
        M.RateModel.fit(few.limit(2), columns, "y", features=known, weight="n", least_rows=1000)
