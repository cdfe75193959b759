"""Intervals of odds, made at once and brought up to date, against a loop over the quotes."""

import random
from datetime import datetime, timedelta

import pytest
from fathomline.operators import lifecycle as L

START = datetime(2024, 1, 1)
KEY = ["match", "book"]
SCHEMA = "match long, book string, at timestamp, tie long, odds double"


def quotes(n=400):
    rng = random.Random(9)
    return [(rng.randrange(6), rng.choice(["x", "y", None]), START + timedelta(hours=rng.randrange(60)) if rng.random() > 0.03 else None, i, rng.choice([1.5, 2.0, 2.5]) if rng.random() > 0.03 else None) for i in range(n)]


def slow(rows):
    kept = {}
    for m, b, at, tie, odds in sorted(rows, key=lambda r: r[3]):
        if at is not None and odds is not None:
            kept.setdefault((m, b), {})[at] = odds
    out = []
    for key, times in kept.items():
        runs = []
        for at, odds in sorted(times.items()):
            if runs and runs[-1][0] == odds:
                runs[-1][2:] = [at, runs[-1][3] + 1]
            else:
                runs.append([odds, at, at, 1])
        for k, (odds, since, seen, n) in enumerate(runs):
            upto = runs[k + 1][1] if k + 1 < len(runs) else None
            out.append((*key, odds, since, upto, seen, n, upto is None))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("match", "book", "odds", "valid_from", "valid_to", "last_seen", "quotes", "is_current").collect()), key=str)


def test_intervals(spark):
    rows = quotes()
    assert told(L.intervals(spark.createDataFrame(rows, SCHEMA), KEY, "at", "tie", "odds")) == slow(rows)
    assert L.intervals(spark.createDataFrame([], SCHEMA), KEY, "at", "tie", "odds").count() == 0


@pytest.mark.parametrize("split", ["later", "mixed", "none", "first"])
def test_merges_equal_a_fresh_start(spark, split):
    rows = quotes()
    if split == "later":  # some keys only get later quotes, others none
        cut = START + timedelta(hours=30)
        old, new = [r for r in rows if r[2] is None or r[2] < cut], [r for r in rows if r[2] and r[2] >= cut and r[0] < 4]
    else:
        old, new = {"mixed": (rows[:250], rows[250:]), "none": (rows, []), "first": ([], rows)}[split]
    history, fresh = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    found = L.merged(L.intervals(history, KEY, "at", "tie", "odds"), history, fresh, KEY, "at", "tie", "odds")
    assert told(found) == slow(old + new)


def test_intervals_deal_and_sort_quotes_once(spark):
    found = L.intervals(spark.createDataFrame(quotes(), SCHEMA), KEY, "at", "tie", "odds")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan
