"""Fitted models by bounds, and single values of the scalar functions."""

import pytest
from fathomline.functions import names as M
from fathomline.functions import scalars as S
from fathomline.plans.models import blend_parameters, goal_rates, result_classes, tree_market
from pyspark.sql import functions as F

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_goal_rates(spark):
    r = goal_rates(spark, MIDDLE).first()
    assert r.n > 1000 and r.mae < 0.95 and r.rmse < 1.25 and abs(r.bias) < 0.1 and abs(r.rho) <= 0.30


def test_trees_beat_the_base_rate(spark):
    r = tree_market(spark, MIDDLE).first()
    assert r.auc > 0.55 and r.brier < 0.25 and r.feature == "x1"


def test_classes_and_calibration(spark):
    rows = {r.kind: r for r in result_classes(spark, MIDDLE).collect()}
    assert rows["raw"].log_loss < 1.09 and rows["calibrated"].log_loss < 1.09 and rows["raw"].accuracy > 0.37


def test_blend_finds_the_better_model(spark):
    p = {r.name: r.value for r in blend_parameters(spark, SMALL).collect()}
    assert p["high"] > 0.7 and p["low"] < 0.35 and p["strong"] > p["close"] + 0.02


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_published_values(spark):
    h, a = F.lit(1.4), F.lit(1.1)
    assert one(spark, S.expected_value(F.lit(0.55), F.lit(2.0))) == pytest.approx(0.10) and one(spark, S.expected_value(F.lit(0.40), F.lit(2.0))) == pytest.approx(-0.20)
    m = S.score_matrix(h, a)
    cells = one(spark, m)
    assert len(cells) == 81 and all(c.p >= 0 for c in cells) and 0.99 < sum(c.p for c in cells) <= 1
    d = one(spark, S.dixon_coles(m, h, a, -0.08))
    assert sum(c.p for c in d) == pytest.approx(1, abs=1e-8)
    at = lambda rows, x, y: next(c.p for c in rows if (c.h, c.a) == (x, y))
    assert at(d, 0, 0) > at(cells, 0, 0) and at(d, 1, 1) > at(cells, 1, 1)
    with pytest.raises(Exception, match="negative"):
        one(spark, S.dixon_coles(m, h, a, 0.9))
    got = one(spark, S.markets(S.dixon_coles(m, h, a, -0.08)))
    assert got.p_home + got.p_draw + got.p_away == pytest.approx(1, abs=1e-3) and 0 <= got.p_over25 <= 1 and 0 <= got.p_both <= 1
    for probs in ([0.50, 0.25, 0.25], [0.20, 0.30, 0.50]):
        curves = [([0.0, 1.0], [0.05, 0.90]), ([0.0, 1.0], [0.10, 0.40]), ([0.0, 1.0], [0.05, 0.90])]
        row = [one(spark, c) for c in S.calibrated([F.lit(p) for p in probs], curves)]
        assert sum(row) == pytest.approx(1) and all(0 <= p <= 1 for p in row)


def test_names_and_numbers(spark):
    assert one(spark, M.team_key(F.lit("  Côte d'Ivoire & Bosnia-Herzegovina, FC. "))) == "cote d'ivoire and bosnia-herzegovina fc"
    assert one(spark, M.identity_key(F.lit("Straße O’Neil ﬁ ½"))) == "strasse o neil fi 1 2" and one(spark, M.letters_key(F.lit("Ñandú 9-x"))) == "nandu x"
    assert one(spark, M.text_key(F.lit("Café!"))) == "caf" and one(spark, M.inverted(F.lit("Son Heung Min"))) == "Heung Min Son" and one(spark, M.club_key(F.lit("FC Köln"))) == "koln"
    assert one(spark, M.underscored(F.lit("a b  c"))) == "a_b_c" and one(spark, M.ratio(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)
    assert one(spark, S.lenient_double(F.lit(" 1,234.5 %"))) == 1234.5 and one(spark, S.lenient_double(F.lit("1,5"), "decimal")) == 1.5 and one(spark, S.lenient_double(F.lit("x"))) is None
    assert one(spark, S.short_id(F.lit("a"), F.lit(None).cast("string"), F.lit(2.5))) == __import__("hashlib").sha1(b"a||2.5").hexdigest()[:16]
    assert one(spark, S.fair_odds(F.lit(0.001))) == 100.0 and one(spark, S.fair_odds(F.lit(0.0))) is None
