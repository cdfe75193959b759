"""Readers, writers and feeds over files made here."""

import json

import pytest
from fathomline import sources
from fathomline.functions import minutes as M
from fathomline.operators import joins as J
from fathomline.operators import rules as R
from fathomline.sources import feeds, schemas
from pyspark.sql import functions as F


def test_csv_types_missing_files_and_columns(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("date,team,goals,rate\n2024-01-02,Aa,3,NaN\n,Bb,x,1.5\n")
    schema = "date date, team string, goals int, rate double"
    rows = sources.read_csv(spark, str(path), schema).orderBy("team").collect()
    assert [tuple(r) for r in rows] == [(rows[0].date, "Aa", 3, None), (None, "Bb", None, 1.5)] and str(rows[0].date) == "2024-01-02"
    two = sources.read_csv(spark, str(path), schema, columns=["team", "rate"])
    assert two.columns == ["team", "rate"] and "goals" not in two._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    none = sources.read_csv(spark, str(tmp_path / "no.csv"), schema)
    assert none.count() == 0 and none.columns == ["date", "team", "goals", "rate"]
    assert [tuple(r) for r in sources.read_strings(spark, str(path), ["date", "team", "goals", "rate"]).orderBy("team").collect()] == [("2024-01-02", "Aa", "3", "NaN"), ("", "Bb", "x", "1.5")]


def test_parquet_trees(spark, tmp_path):
    df = spark.createDataFrame([("x", 2023, "Ab", 1.0), ("x", 2024, "Cd", 2.0), ("y", 2024, "Ef", 3.0), ("y", 2024, "Ef", 3.0)], "league string, season int, `Player Name` string, xG double")
    path = str(tmp_path / "tree")
    sources.write_parquet(df.withColumnRenamed("Player Name", "PlayerName"), path, ["league", "season"])
    back = sources.read_parquet_tree(spark, f"{path}/*/*")
    assert set(back.columns) == {"player_name", "x_g", "league", "season", "raw_file"}
    assert back.where("league = 'y'").select("player_name", "season").distinct().count() == 1
    assert "PartitionFilters: [isnotnull" in back.where("league = 'y'")._jdf.queryExecution().toString()
    assert sources.read_parquet_tree(spark, str(tmp_path / "none")).count() == 0
    sources.write_csv(df, str(tmp_path / "out"), one_file=True)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1 and spark.read.csv(str(tmp_path / "out"), header=True).count() == 4


def test_parameters_and_json(spark, tmp_path):
    path = str(tmp_path / "p")
    assert sources.read_params(spark, path, {"a": 1}) == {"a": 1}
    sources.write_params(spark, {"close": 0.15, "names": ["a"]}, path)
    assert sources.read_params(spark, path) == {"close": 0.15, "names": ["a"]}
    (tmp_path / "m.json").write_text(json.dumps([{"k": 1, "v": [1.5]}, {"k": 2}], indent=1))
    assert [tuple(r) for r in sources.read_json(spark, str(tmp_path / "m.json"), "k int, v array<double>").orderBy("k").collect()] == [(1, [1.5]), (2, None)]
    assert sources.read_json(spark, str(tmp_path / "n.json"), "k int").count() == 0


def test_small_steps(spark):
    df = spark.createDataFrame([(1, None, "c")], "a int, b double, c string")
    assert sources.known_first(df, ["c", "zz", "a"]).columns == ["c", "a", "b"]
    assert tuple(sources.filled(df, {"b": F.lit(2.0), "d": F.lit("x")}).first()) == (1, 2.0, "c", "x")
    assert sources.chain(df, lambda d: d.drop("b"), lambda d: d.withColumn("e", F.lit(1))).columns == ["a", "c", "e"]
    assert schemas.empty(spark, "odds").columns[0] == "odds_id" and schemas.checked(df.withColumnRenamed("a", "match_id"), "lineups")[:2] == ["team_id", "player_id"]
    assert schemas.catalogue(spark).where("is_key").count() == sum(map(len, schemas.KEYS.values()))
    assert R.wanted_markets("all", ["a", "b"]) == ["a", "b"] and R.wanted_markets(" b , a", ["a", "b"]) == ["b", "a"]
    with pytest.raises(ValueError, match="unknown"):
        R.wanted_markets("c", ["a"])


def test_nested_quotes_with_gaps(spark):
    payload = {"id": "m1", "commence_time": "2024-06-01T12:00:00Z", "bookmakers": [
        {"key": "Pinnacle", "markets": [{"key": "totals", "last_update": "2024-05-30T00:00:00Z", "outcomes": [{"name": "Over", "price": 2.0, "point": 2.5}, {"name": "Under", "price": None}]},
                                        {"key": "totals", "outcomes": [{"name": "Over", "price": 1.8, "point": 2.5}]}]}, {"title": "Shop", "last_update": "2024-05-31T00:00:00Z", "markets": [{"key": "h2h", "outcomes": [{"description": "Ana (Under 1.5)", "name": "x", "price": 3.0}]}]}]}
    df = feeds.flatten_quotes(spark.createDataFrame([(json.dumps(payload),), ("{}",), ("not json",)], "p string"), "p").orderBy("odds")
    rows = df.collect()
    assert [(r.bookmaker, r.is_sharp, r.selection, r.line, r.is_opening, r.is_closing) for r in rows] == [
        ("Pinnacle", True, "Over", 2.5, False, True), ("Pinnacle", True, "Over", 2.5, True, False), ("Shop", False, "Ana Under", 1.5, True, True)]
    assert all(r.match_id == "feed:match:m1" and r.odds_id.startswith("feed:odds:") and len(r.odds_id) == 26 for r in rows)
    assert {(r.opening, r.closing) for r in feeds.open_close_table(df).collect()} == {(2.0, 1.8), (None, 3.0)}


def test_substitutes_and_referees(spark):
    e = [{"type": {"name": "Starting XI"}, "team": {"id": "1"}, "tactics": {"lineup": [{"player": {"id": "a", "name": "A"}, "position": {"name": "Back"}, "jersey_number": 4}]}},
         {"type": {"name": "Substitution"}, "team": {"id": "1"}, "player": {"id": "a", "name": "A"}, "minute": 60, "second": 30, "substitution": {"replacement": {"id": "b", "name": "B"}}},
         {"type": {"name": "Substitution"}, "team": {"id": "1"}, "player": {"id": "c"}, "minute": 70, "substitution": {}}, {"type": {"name": "Shot"}, "minute": 1}]
    events = feeds.events_of(spark.createDataFrame([("m", json.dumps(e))], "m string, p string"), "m", "p")
    got = {r.player: (r.is_starter, r.minute_on, r.minute_off) for r in feeds.lineups(events).collect()}
    assert got == {"a": (True, 0.0, 60.5), "b": (False, 60.5, None), "c": (True, 0.0, 70.0)}
    assert {r.player: r.position for r in feeds.players_of(events).collect()} == {"a": "Back", "b": None, "c": None}
    rates = feeds.card_rates(spark.createDataFrame([("R", "t", 4.0, None, 0.5, 8.0, 1.0), (" ", "t", 1.0, 1.0, 1.0, 1.0, 1.0)], "referee string, tournament string, matches double, yellow_per_match double, red_per_match double, yellows double, reds double"))
    assert [(r.yellow_per_match, r.red_per_match) for r in rates.collect()] == [(2.0, 0.5)]
    players, shown = feeds.lineup_rows(spark.createDataFrame([("m", "t", "p", "Old", "x", "yes", None, 1), ("n", "u", "p", "New", "y", "0", "55", 2)], "match_id string, team string, player string, name string, position string, starter string, minute_on string, seq int"))
    assert tuple(players.first()) == ("p", "New", "u", "y") and sorted(r.minute_on for r in shown.collect()) == [0.0, 55.0]


def test_manual_minutes_and_upserts(spark):
    auto = spark.createDataFrame([("a", 0.3, 40.0), ("b", 0.6, 60.0)], "player string, start_probability double, minutes double")
    manual = spark.createDataFrame([("a", "out", None, None, 1), ("a", "confirmed_starter", None, 88.0, 2)], "player string, lineup_status string, start_probability double, minutes double, seq int")
    got = {r.player: (r.start_probability, r.minutes, r.is_manual) for r in M.overlaid(auto, manual, ["player"], "seq", ["start_probability", "minutes"]).collect()}
    assert got == {"a": (1.0, 88.0, True), "b": (0.6, 60.0, False)}
    left, right = spark.createDataFrame([(1, None), (2, "x")], "v int, k string"), spark.createDataFrame([(None, 5), ("y", 6)], "k string, w int")
    assert {tuple(r) for r in J.join_null_safe(left, right, ["k"], "full").collect()} == {(None, 1, 5), ("x", 2, None), ("y", None, 6)}
