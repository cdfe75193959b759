"""Nested provider feeds, flattened: quotes, events, line-ups, weather hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.names import identity_key
from fathomline.functions.scalars import lenient_bool, rate_or_value, selection_and_line, short_id
from fathomline.operators.windows import quote_flags

# Books whose prices lead the others', and outcomes of a shot on target.
SHARP_BOOKS = ("pinnacle", "betfair_ex_uk", "betfair_ex_eu", "matchbook")
ON_TARGET = ("Goal", "Saved", "Saved to Post")

OUTCOME = "struct<name:string,description:string,price:double,point:double>"
MARKET = f"struct<key:string,last_update:string,outcomes:array<{OUTCOME}>>"
QUOTES = f"struct<id:string,match_id:string,timestamp:string,commence_time:string,bookmakers:array<struct<key:string,title:string,last_update:string,markets:array<{MARKET}>>>>"
_NAMED = "struct<id:string,name:string>"
EVENT = (
    f"struct<type:struct<name:string>,team:{_NAMED},player:{_NAMED},minute:int,second:int,shot:struct<outcome:struct<name:string>,statsbomb_xg:double>,"
    "pass:struct<type:struct<name:string>,shot_assist:boolean,goal_assist:boolean>,foul_committed:struct<card:struct<name:string>>,"
    f"bad_behaviour:struct<card:struct<name:string>>,substitution:struct<replacement:{_NAMED}>,"
    f"tactics:struct<lineup:array<struct<player:{_NAMED},position:struct<name:string>,jersey_number:int>>>>")


def source_id(source: str, kind: str, raw: Column, fallback: Column | None = None) -> Column:
    """"source:kind:id", from the raw id or else a slug of the fallback."""
    slug = F.replace(identity_key(fallback), F.lit(" "), F.lit("-")) if fallback is not None else F.lit("")
    return F.concat(F.lit(f"{source}:{kind}:"), F.coalesce(F.when(raw != "", raw), slug))


def flatten_quotes(feed: DataFrame, payload: str, source: str = "feed") -> DataFrame:
    """One row for each quoted outcome of a JSON payload (event > bookmakers > markets > outcomes).

    Quotes without a price are left out. The time is the market's, else the book's, else
    the event's; a line may stand in the selection. Ids are digests of match, book,
    market, selection, line and time. ``is_opening`` and ``is_closing`` mark each
    selection's first and last quote.
    """
    event = feed.select(F.from_json(payload, QUOTES).alias("e"))
    match = source_id(source, "match", F.coalesce("e.id", "e.match_id", F.lit("unknown")))
    books = event.select(match.alias("match_id"), F.coalesce("e.timestamp", "e.commence_time").alias("t0"), F.explode("e.bookmakers").alias("b"))
    book = F.coalesce("b.key", "b.title")
    quoted = books.select("match_id", book.alias("bookmaker"), F.coalesce("b.last_update", "t0").alias("t1"), F.explode("b.markets").alias("m"))
    rows = quoted.select("match_id", "bookmaker", F.col("m.key").alias("market"), F.coalesce("m.last_update", "t1").alias("quote_time"), F.inline("m.outcomes"))
    selection, line = selection_and_line(F.coalesce("description", "name"), F.col("point"))
    return quote_rows(rows.where("price IS NOT NULL").select("match_id", "bookmaker", "market", selection.alias("selection"), line.alias("line"), F.col("price").alias("odds"), "quote_time"), source)


def flat_quotes(df: DataFrame, source: str = "feed") -> DataFrame:
    """The same rows from a flat table: match_id, bookmaker, market, selection, line, odds, quote_time."""
    selection, line = selection_and_line(F.col("selection"), F.col("line"))
    named = df.where("odds IS NOT NULL").select(
        source_id(source, "match", F.col("match_id").cast("string")).alias("match_id"), "bookmaker", "market", selection.alias("selection"), line.alias("line"), "odds", F.col("quote_time").cast("string").alias("quote_time"))
    return quote_rows(named, source)


def quote_rows(df: DataFrame, source: str) -> DataFrame:
    key = ["match_id", "bookmaker", "market", "selection", "line"]
    rows = df.select(
        F.concat(F.lit(f"{source}:odds:"), short_id(*[F.col(c) for c in key], F.col("quote_time"))).alias("odds_id"), "match_id", "bookmaker",
        F.coalesce(F.lower("bookmaker").isin(*SHARP_BOOKS), F.lit(False)).alias("is_sharp"), "market", "selection", "line", "odds",
        F.when(F.col("odds") > 0, 1 / F.col("odds")).alias("implied"), F.try_to_timestamp("quote_time").alias("quote_time"))
    return quote_flags(rows, key, "quote_time", "odds_id")


def open_close_table(quotes: DataFrame) -> DataFrame:
    """One row for each selection with its opening and closing odds side by side; a quote that is both counts as closing only. Null lines are a line of their own."""
    return quotes.groupBy("match_id", "bookmaker", "market", "selection", "line").agg(
        F.max(F.when(F.col("is_opening") & ~F.col("is_closing"), F.col("odds"))).alias("opening"), F.max(F.when(F.col("is_closing"), F.col("odds"))).alias("closing"))


def events_of(feed: DataFrame, match: str, payload: str) -> DataFrame:
    """(match_id, seq, e): the events of a JSON array, in order."""
    return feed.select(F.col(match).cast("string").alias("match_id"), F.posexplode(F.from_json(payload, f"array<{EVENT}>")).alias("seq", "e"))


def _minute(e: str = "e") -> Column:
    return F.col(f"{e}.minute") + F.coalesce(f"{e}.second", F.lit(0)) / 60.0


def lineups(events: DataFrame) -> DataFrame:
    """(match_id, team, player, is_starter, position, shirt, minute_on, minute_off, minutes_played) from starting elevens and substitutions.

    A player who comes off without having been listed counts as a starter. A later entry
    replaces an earlier one, so a player who comes on is no starter.
    """
    kind = F.col("e.type.name")
    eleven = events.where(kind == "Starting XI").select("match_id", "seq", F.col("e.team.id").alias("team"), F.explode("e.tactics.lineup").alias("p")).select(
        "match_id", "team", F.col("p.player.id").alias("player"), "seq", F.lit(True).alias("is_starter"), F.col("p.position.name").alias("position"), F.col("p.jersey_number").alias("shirt"), F.lit(0.0).alias("minute_on"))
    subs = events.where((kind == "Substitution") & F.col("e.player.id").isNotNull() & F.col("e.team.id").isNotNull())
    on = subs.where(F.col("e.substitution.replacement.id").isNotNull()).select(
        "match_id", F.col("e.team.id").alias("team"), F.col("e.substitution.replacement.id").alias("player"), "seq", F.lit(False).alias("is_starter"),
        F.lit(None).cast("string").alias("position"), F.lit(None).cast("int").alias("shirt"), _minute().alias("minute_on"))
    off = subs.select("match_id", F.col("e.team.id").alias("team"), F.col("e.player.id").alias("player"), "seq", _minute().alias("minute_off"))
    key = ["match_id", "team", "player"]
    listed = eleven.union(on).groupBy(*key).agg(F.max_by(F.struct("is_starter", "position", "shirt", "minute_on", "seq"), "seq").alias("l"))
    gone = off.groupBy(*key).agg(F.max_by(F.struct("minute_off", "seq"), "seq").alias("o"))
    both = listed.join(gone, key, "full")
    left = F.when(F.col("l").isNull() | (F.col("o.seq") > F.col("l.seq")), F.col("o.minute_off"))
    return both.select(
        *key, F.coalesce("l.is_starter", F.lit(True)).alias("is_starter"), F.col("l.position").alias("position"), F.col("l.shirt").alias("shirt"),
        F.coalesce("l.minute_on", F.lit(0.0)).alias("minute_on"), left.alias("minute_off"), left.alias("minutes_played"))


def _card(*names: str) -> Column:
    return F.coalesce(F.coalesce("e.foul_committed.card.name", "e.bad_behaviour.card.name").isin(*names), F.lit(False))


def _is(kind: str, *more: Column) -> Column:
    out = F.col("e.type.name") == kind
    for c in more:
        out = out & F.coalesce(c, F.lit(False))
    return out


def player_stats(events: DataFrame) -> DataFrame:
    """One row for each match, team and player with an event: counts by kind of event, and expected goals."""
    n = lambda c: F.count(F.when(c, 1))
    card = F.col("e.type.name").isin("Foul Committed", "Bad Behaviour")
    rows = events.where(F.col("e.player.id").isNotNull() & F.col("e.team.id").isNotNull())
    return rows.groupBy("match_id", F.col("e.team.id").alias("team"), F.col("e.player.id").alias("player")).agg(
        n(_is("Shot")).alias("shots"), n(_is("Shot", F.col("e.shot.outcome.name").isin(*ON_TARGET))).alias("shots_on_target"),
        n(_is("Shot", F.col("e.shot.outcome.name") == "Goal")).alias("goals"), F.coalesce(F.sum(F.when(_is("Shot"), F.col("e.shot.statsbomb_xg"))), F.lit(0.0)).alias("xg"),
        n(_is("Pass", F.col("e.pass.type.name") == "Corner")).alias("corners_taken"), n(_is("Pass", F.col("e.pass.shot_assist"))).alias("key_passes"),
        n(_is("Pass", F.col("e.pass.goal_assist"))).alias("assists"), n(_is("Foul Committed")).alias("fouls_committed"), n(_is("Foul Won")).alias("fouls_won"),
        n(card & _card("Yellow Card")).alias("yellow_cards"), n(card & _card("Red Card", "Second Yellow")).alias("red_cards"))


def match_stats(events: DataFrame, home: DataFrame) -> DataFrame:
    """One row a match: corners, yellow and red cards, shots, shots on target and expected goals of both sides. ``home`` (match_id, home_team) says which is which."""
    n = lambda c: F.count(F.when(c, 1))
    sided = events.join(home, "match_id").withColumn("side", F.when(F.col("e.team.id") == F.col("home_team"), "home").when(F.col("e.team.id").isNotNull(), "away"))
    kinds = {
        "corners": lambda s: n(s & _is("Pass", F.col("e.pass.type.name") == "Corner")), "yellow": lambda s: n(s & _card("Yellow Card")), "red": lambda s: n(s & _card("Red Card", "Second Yellow")),
        "shots": lambda s: n(s & _is("Shot")), "on_target": lambda s: n(s & _is("Shot", F.col("e.shot.outcome.name").isin(*ON_TARGET))),
        "xg": lambda s: F.coalesce(F.sum(F.when(s & _is("Shot"), F.col("e.shot.statsbomb_xg"))), F.lit(0.0))}
    return sided.groupBy("match_id").agg(*[f(F.col("side") == side).alias(f"{k}_{side}") for k, f in kinds.items() for side in ("home", "away")])


def players_of(events: DataFrame) -> DataFrame:
    """(player, name, team, position): every player that an event names, as the last one names them; a position once known stays."""
    parts = [
        events.where(F.col("e.type.name") == "Starting XI").select("match_id", "seq", F.col("e.team.id").alias("team"), F.explode("e.tactics.lineup").alias("p")).select(
            F.col("p.player.id").alias("player"), F.col("p.player.name").alias("name"), "team", F.col("p.position.name").alias("position"), "match_id", "seq"),
        events.where("e.player.id IS NOT NULL AND e.team.id IS NOT NULL").select(F.col("e.player.id").alias("player"), F.col("e.player.name").alias("name"), F.col("e.team.id").alias("team"), F.lit(None).cast("string").alias("position"), "match_id", "seq"),
        events.where("e.substitution.replacement.id IS NOT NULL").select(F.col("e.substitution.replacement.id").alias("player"), F.col("e.substitution.replacement.name").alias("name"), F.col("e.team.id").alias("team"), F.lit(None).cast("string").alias("position"), "match_id", "seq")]
    every = parts[0].union(parts[1]).union(parts[2])
    order = F.struct("match_id", "seq")
    return every.groupBy("player").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), order)).alias("name"), F.max_by("team", order).alias("team"), F.max_by("position", F.when(F.col("position").isNotNull(), order)).alias("position"))


def weather_hours(feed: DataFrame, place: str, payload: str) -> DataFrame:
    """One row an hour from parallel arrays; where one is shorter, its values are null. Hours without a time are left out."""
    names = ("time", "temperature_2m", "relative_humidity_2m", "apparent_temperature", "precipitation", "wind_speed_10m")
    kind = f"struct<hourly:struct<{','.join(f'{n}:array<{"string" if n == "time" else "double"}>' for n in names)}>>"
    hours = feed.select(F.col(place).alias("place"), F.from_json(payload, kind)["hourly"].alias("h")).select("place", F.inline(F.arrays_zip(*[F.coalesce(F.col(f"h.{n}"), F.array().cast(f"array<{'string' if n == 'time' else 'double'}>")).alias(n) for n in names])))
    return hours.where("time IS NOT NULL").withColumn("time", F.try_to_timestamp("time"))


def weather_at(games: DataFrame, hours: DataFrame, place: str, at: str) -> DataFrame:
    """The weather of the hour each game starts in, at its place; both times are UTC. Null where there is none."""
    keyed = hours.withColumn("_hour", F.date_trunc("hour", "time")).withColumnRenamed("place", "_place").drop("time")
    probe = games.withColumn("_at", F.date_trunc("hour", F.col(at).cast("timestamp")))
    return probe.join(keyed, (F.col("_at") == F.col("_hour")) & (F.col(place) == F.col("_place")), "left").drop("_at", "_hour", "_place")


def lineup_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(players, line-ups) of flat rows (match_id, team, player, name, position, starter, minute_on, seq): of repeated players the last row counts, starters come on at 0."""
    starter = lenient_bool(F.col("starter"))
    players = df.groupBy("player").agg(F.max_by(F.struct("name", "team", "position"), "seq").alias("p")).select("player", "p.*")
    shown = df.select("match_id", "team", "player", starter.alias("is_starter"), "position", F.coalesce(F.when(starter, 0.0), F.col("minute_on").cast("double")).alias("minute_on"))
    return players, shown


def card_rates(df: DataFrame) -> DataFrame:
    """(referee, tournament, matches, yellow_per_match, red_per_match): the given rates, else counts by matches; rows without a name are left out."""
    return df.where("referee IS NOT NULL AND trim(referee) <> ''").select(
        F.trim("referee").alias("referee"), "tournament", "matches", rate_or_value(F.col("yellow_per_match"), F.col("yellows"), F.col("matches")).alias("yellow_per_match"),
        rate_or_value(F.col("red_per_match"), F.col("reds"), F.col("matches")).alias("red_per_match"))


_COUNT = "struct<total:int,on:int,assists:int>"
SHEET = (
    f"array<struct<team:{_NAMED},players:array<struct<player:{_NAMED},statistics:array<struct<games:struct<minutes:int>,shots:{_COUNT},goals:{_COUNT},"
    "passes:struct<key:int>,fouls:struct<committed:int,drawn:int>,cards:struct<yellow:int,red:int>>>>>>>")


def player_sheets(feed: DataFrame, match: str, payload: str, source: str = "feed") -> DataFrame:
    """One row for each team, player and statistics block of a match's sheet (teams > players > statistics)."""
    teams = feed.select(F.col(match).cast("string").alias("m"), F.explode(F.from_json(payload, SHEET)).alias("t"))
    players = teams.select("m", F.col("t.team").alias("team"), F.explode("t.players").alias("p"))
    rows = players.select("m", "team", F.col("p.player").alias("player"), F.explode("p.statistics").alias("s"))
    return rows.select(
        source_id(source, "match", F.col("m")).alias("match_id"), source_id(source, "team", F.col("team.id"), F.col("team.name")).alias("team_id"),
        source_id(source, "player", F.col("player.id"), F.col("player.name")).alias("player_id"), F.col("s.games.minutes").alias("minutes_played"), F.col("s.goals.total").alias("goals"),
        F.col("s.goals.assists").alias("assists"), F.col("s.shots.total").alias("shots"), F.col("s.shots.on").alias("shots_on_target"), F.col("s.passes.key").alias("key_passes"),
        F.col("s.fouls.committed").alias("fouls_committed"), F.col("s.fouls.drawn").alias("fouls_won"), F.col("s.cards.yellow").alias("yellow_cards"), F.col("s.cards.red").alias("red_cards"))
