"""Steps that no key makes one task's work, and joins that repeat the smaller side."""

import random
from datetime import date, timedelta

import pytest
from fathomline.operators import joins as J
from fathomline.operators import reports as P


@pytest.mark.parametrize("parts", ["1", "7"])
def test_deepest_falls_match_a_loop(spark, parts):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), i, rng.choice([-1.0, -0.5, 0.4, 1.5])) for i in range(500)] + [("up", "x", i, 1.0) for i in range(5)] + [("down", "x", i, -1.0) for i in range(5)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.overall, r.v, r.m): r.fall for r in P.deepest_falls(spark.createDataFrame(shuffled, "v string, m string, i long, p double"), "v", "m", "p", ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for key in {(True, v, None) for v, *_ in rows} | {(False, v, m) for v, m, *_ in rows}:
        total, high, fall = 0.0, 0.0, float("inf")
        for v, m, _, p in rows:
            if v == key[1] and key[2] in (None, m):
                total += p
                high = max(high, total)
                fall = min(fall, total - high)
        want[key] = fall
    assert got == pytest.approx(want) and got[True, "up", None] == 0 and got[True, "down", None] == -5


def test_tolerance_join_repeats_the_left_rows(spark):
    start = date(2024, 1, 1)
    left = spark.createDataFrame([(k, start + timedelta(days=k)) for k in range(20)], "k long, day date")
    right = spark.createDataFrame([(k, n, start + timedelta(days=k + n - 3)) for k in range(20) for n in range(7)], "k long, n long, at date")
    found = J.tolerance_join(left, right, ["k"], "day", "at")
    assert sorted((r.k, r.n, r.day_step, r.turn) for r in found.collect()) == [(k, n, n - 3, {3: 0, 2: 1, 4: 2}[n]) for k in range(20) for n in (2, 3, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("LogicalRDD")  # above the left rows, which are printed first
