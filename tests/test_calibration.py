"""Out-of-fold curves against a slow version, their report, and the backtest at closing odds."""

import math

import numpy as np
import pytest
from fathomline import models as M
from fathomline.models import calibration as C
from fathomline.plans.models import FEATURES, calibration_report, closing_quotes, markets, training, variant_backtest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def slow_rising(y, w):
    """The weighted means whose minimum over ends and maximum over starts is the isotonic fit."""
    n = len(y)
    mean = lambda a, b: np.average(y[a:b + 1], weights=w[a:b + 1])
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_rising_is_the_isotonic_fit():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        y, w = rng.integers(0, 4, n) / 3.0, rng.integers(1, 5, n).astype(float)
        assert C.rising(y, w) == pytest.approx(slow_rising(y, w))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(1500), 2)
    a, b = rng.random(1500) < p ** 2, rng.random(1500) < 0.3 + 0.4 * p
    rows = [(i, float(x) if i % 50 else None, float(1 - x), int(u), int(v) if i % 70 else None) for i, (x, u, v) in enumerate(zip(p, a, b, strict=True))]
    return spark.createDataFrame(rows, "k long, p double, q double, u int, v int").repartition(3)


def test_folds_never_see_themselves(scored):
    curves = {"square": ("p", F.col("u") == 1), "flat": ("p", F.col("v") == 1), "falling": ("q", F.col("u") == 1)}
    got = C.out_of_fold(scored, curves, "k", 4).toPandas()
    assert sorted(got["curve"].unique()) == ["falling", "flat", "square"]
    for name, part in got.groupby("curve"):
        for k in range(4):
            rest = part[part["fold"] != k].groupby("p")["y"].agg(["mean", "count"])
            fit = slow_rising(rest["mean"].to_numpy(), rest["count"].to_numpy())
            own = part[part["fold"] == k]
            assert own["fitted"].to_numpy() == pytest.approx(np.interp(own["p"], rest.index, fit)), name


def test_report_by_curve(scored):
    out = C.out_of_fold(scored, {"square": ("p", F.col("u") == 1), "flat": ("p", F.col("v") == 1)}, "k")
    rows = {r.curve: r for r in C.calibration_report(out).collect()}
    assert rows["square"].n == 1470 and rows["flat"].n < 1470
    for r in rows.values():
        assert r.ece_fitted < 0.05 < r.ece_raw and r.log_loss_fitted < r.log_loss_raw and r.largest_fitted >= r.ece_fitted
    part = out.where("curve = 'square'").toPandas()
    bins = np.minimum((part["p"] * 10).astype(int), 9)
    want = sum(abs(g["p"].mean() - g["y"].mean()) * len(g) for _, g in part.groupby(bins)) / len(part)
    assert rows["square"].ece_raw == pytest.approx(want, abs=1e-6)


def test_calibration_query(spark):
    rows = calibration_report(spark, SMALL).collect()
    assert sorted(r.curve for r in rows) == ["away", "both", "draw", "home", "over"] and len({r.n for r in rows}) == 1


def test_backtest_of_variants_at_closing_odds(spark):
    quotes = {r.k: r for r in closing_quotes(spark, SMALL).collect()}
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").join(spark.read.parquet(f"{SMALL}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).collect()
    for k in list(quotes)[:50]:
        own = sorted((r.l_shipdate, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_discount) for r in lines if r.l_orderkey == k and (r.l_shipdate.date() - r.o_orderdate.date()).days <= 60)
        assert (quotes[k].opening, quotes[k].closing) == (pytest.approx(1.5 + 10 * own[0][4]), pytest.approx(1.5 + 10 * own[-1][4]))
    rows = {r.variant: r for r in variant_backtest(spark, SMALL).collect()}
    assert set(rows) == {"trees", "rates", "blend", "calibrated"} and len({r.candidates for r in rows.values()}) == 1
    assert all(r.roi_low_pct <= r.roi_pct <= r.roi_high_pct or r.bets < 2 for r in rows.values()) and sum(r.bets for r in rows.values()) > 0


def test_markets_correct_low_scores_by_the_fitted_dependence(spark):
    train = training(spark, SMALL).where("year < 1999")
    home, away = (M.RateModel.fit(train, FEATURES, f"{side}_goals") for side in ("home", "away"))
    rho = M.fit_rho(away(home(train, "h"), "a"), "h", "a", "home_goals", "away_goals")
    assert abs(rho) > 1e-3
    chance = lambda rate, n: math.exp(-rate) * rate ** n / math.factorial(n)
    for r in markets(spark, SMALL, 1).limit(50).collect():
        h, a = r.home_rate, r.away_rate
        factor = {(0, 0): 1 - h * a * rho, (0, 1): 1 + h * rho, (1, 0): 1 + a * rho, (1, 1): 1 - rho}
        p = {(x, y): chance(h, x) * chance(a, y) * factor.get((x, y), 1.0) for x in range(9) for y in range(9)}
        want = [sum(v for (x, y), v in p.items() if holds(x, y)) / sum(p.values()) for holds in (lambda x, y: x > y, lambda x, y: x == y, lambda x, y: x + y > 2)]
        assert [r.rates_home, r.rates_draw, r.rates_over] == pytest.approx(want, abs=1e-9)


def test_curves_beside_the_rows_are_those_out_of_fold(scored):
    curves = {"square": ("p", F.col("u") == 1)}
    want = {r.k: r.fitted for r in C.out_of_fold(scored, curves, "k", 4).collect()}
    found = C.fold_curves(C.long_form(scored, curves, "k", 4), 4)
    assert {r.k: r.fitted for r in C.with_fitted(scored, "p", "k", found, "fitted", 4).collect()} == want
