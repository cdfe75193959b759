"""Row-wise functions: names, ids, lenient numbers, distance, odds, score distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_name(name: Column) -> Column:
    """Lower case, accents of Western Europe gone, other marks turned to single spaces."""
    plain = F.translate(F.lower(name), "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    return F.replace(normalise_name(name), F.lit(" "), F.lit("-"))


def short_id(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of SHA-1 over the parts, joined by bars; a null part is empty but keeps its bar."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, length)


def lenient_double(text: Column, comma: str = "thousands") -> Column:
    """A number from text with blanks or a percent sign; null where there is none.

    Commas part thousands and go, or stand for the decimal point (``comma="decimal"``).
    """
    cleaned = F.replace(F.regexp_replace(text, r"[\s%]", ""), F.lit(","), F.lit("." if comma == "decimal" else ""))
    return F.when(cleaned.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), cleaned.cast("double"))


def lenient_bool(text: Column, true: tuple[str, ...] = ("1", "true", "yes", "y", "starter", "starting")) -> Column:
    """Whether the text is one of ``true``, letter case and blanks apart; false for null."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*true), F.lit(False))


def lenient_date(text: Column) -> Column:
    """The day of a text that begins with an ISO date, with or without a time; null where it doesn't."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")))


def leading_int(text: Column) -> Column:
    """The digits a text begins with, such as the years of an age given as "27-114"."""
    return F.when(text.rlike(r"^\s*[0-9]"), F.regexp_extract(text, r"^\s*([0-9]{1,9})", 1)).cast("int")


def age(born: Column, on: Column) -> Column:
    return F.floor(F.datediff(on, born) / 365.2425).cast("int")


def utc_offset_hours(at: Column, zone: str) -> Column:
    """How far local time in ``zone`` is ahead of UTC at that time, summer time included."""
    return (F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 3600.0


def clip(x: Column, low: float, high: float) -> Column:
    """Within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def log_score(x: Column, cap: float) -> Column:
    """log(1 + x) as a share of log(1 + cap), within 0 and 1; 0 for null and for 0 or less."""
    return F.when(x > 0, F.least(F.log1p(x) / math.log1p(cap), F.lit(1.0))).otherwise(0.0)


def rate_or_value(value: Column, numerator: Column, denominator: Column) -> Column:
    return F.coalesce(value, F.try_divide(numerator, denominator))


def ordinal(label: Column, order: list[str]) -> Column:
    """A label's place in ``order``, letter case and blanks apart; -1 for any other and for null."""
    at = F.array_position(F.array(*[F.lit(x.upper()) for x in order]), F.upper(F.trim(label)))
    return F.coalesce(at, F.lit(0)).cast("int") - 1


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str, missing: str | None = None) -> Column:
    """The label of the first step (falling bounds) that ``x`` reaches; ``missing`` for null."""
    out = F.when(x.isNull(), F.lit(missing))
    for bound, label in steps:
        out = out.when(x >= bound, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def worst_label(labels: list[Column], order: list[str]) -> Column:
    """The label that comes first in ``order`` (worst first); unknown and null labels count as the worst."""
    at = F.least(*[F.greatest(ordinal(c, order), F.lit(0)) for c in labels])
    return F.element_at(F.array(*[F.lit(x) for x in order]), at + 1)


def arg_max(columns: dict[str, Column]) -> Column:
    """The name of the largest value, of equal ones the first; null where all are null."""
    best = F.greatest(*columns.values())
    return F.coalesce(*[F.when(c == best, F.lit(n)) for n, c in columns.items()])


def selection_and_line(selection: Column, line: Column) -> tuple[Column, Column]:
    """A bet's selection and line: the line as given, else taken from a selection such as "name (Over 1.5)", which becomes "name Over"."""
    pattern = r"^\s*(.+?)\s*\((Over|Under)\s+([0-9]+(?:\.[0-9]+)?)\)\s*$"
    has = line.isNull() & F.coalesce(selection.rlike(pattern), F.lit(False))
    name = F.concat_ws(" ", F.regexp_extract(selection, pattern, 1), F.regexp_extract(selection, pattern, 2))
    return F.when(has, name).otherwise(selection), F.when(has, F.regexp_extract(selection, pattern, 3).cast("double")).otherwise(line)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def expected_value(prob: Column, odds: Column) -> Column:
    return prob * odds - 1


def fair_odds(prob: Column, floor: float = 0.01, digits: int = 2) -> Column:
    """1 / p rounded, p no less than ``floor``; null where there is no chance."""
    return F.when(prob > 0, F.bround(1 / F.greatest(prob, F.lit(floor)), digits))


def settled_profit(won: Column, odds: Column, stake: Column | float = 1.0) -> Column:
    stake = stake if isinstance(stake, Column) else F.lit(stake)
    return F.when(won, stake * (odds - 1)).otherwise(-stake)


def paper_profit(result: Column, stake: Column, odds: Column) -> Column:
    """Profit by the result's word; 0 for a void bet, null for unknown words and for stakes or odds that mean nothing."""
    word = F.lower(F.trim(result))
    valid = (stake > 0) & (odds > 1)
    return F.when(valid & word.isin("win", "won", "true", "1"), F.bround((odds - 1) * stake, 3)).when(
        valid & word.isin("loss", "lost", "false", "0"), F.bround(-stake, 3)).when(valid & word.isin("void", "push", "cancelled"), 0.0)


def closing_value_pct(first: Column, closing: Column) -> Column:
    """How far the first odds lie above the closing ones, in percent; null where either means nothing."""
    return F.when((first > 1) & (closing > 1), F.bround((first / closing - 1) * 100, 2))


def stake_units(action: Column, prob: Column, odds: Column, bank: float = 100.0, core: float = 0.5, fraction: float = 0.25, cap: float = 1.0, method: str = "fixed", digits: int = 3) -> Column:
    """A fixed stake or a capped fraction of Kelly's for core candidates; 0 for any other action."""
    own = F.lit(core)
    if method == "kelly":
        full = F.greatest(F.lit(0.0), (prob * odds - 1) / (odds - 1))
        own = F.when(odds > 1, F.bround(F.least(F.lit(cap), bank * fraction * full), digits)).otherwise(core)
    return F.when(action == "core_candidate", own).otherwise(0.0)


def kelly(prob: Column, odds: Column, part: float = 0.25, most: float = 0.05) -> Column:
    """A part of the Kelly stake, within 0 and ``most`` of the bankroll."""
    return F.when(odds > 1, F.least(F.greatest((prob * odds - 1) / (odds - 1) * part, F.lit(0.0)), F.lit(most))).otherwise(0.0)


def poisson(rate: Column, n: int) -> Column:
    return F.exp(-rate) * F.pow(rate, F.lit(float(n))) / math.factorial(n)


def poisson_over(rate: Column, line: float) -> Column:
    """The chance of more than ``line``."""
    return 1 - sum((poisson(rate, n) for n in range(int(line) + 1)), F.lit(0.0))


def pmf(rate: Column, most: int) -> Column:
    """array<double>: the chances of 0 to ``most``."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda n: F.exp(-rate) * F.pow(rate, n) / F.factorial(n))


def score_matrix(home: Column, away: Column, most: int = 8) -> Column:
    """array<struct<h, a, p>> of all scores up to ``most`` each."""
    return F.flatten(F.transform(pmf(home, most), lambda p, h: F.transform(
        pmf(away, most), lambda q, a: F.struct(h.alias("h"), a.alias("a"), (p * q).alias("p")))))


def dixon_coles(matrix: Column, home: Column, away: Column, rho: float) -> Column:
    """The four low scores corrected for their dependence, then all scaled to sum to 1; raises an error where a correction makes a score negative."""
    factor = lambda s: (
        F.when((s["h"] == 0) & (s["a"] == 0), 1 - home * away * rho).when((s["h"] == 0) & (s["a"] == 1), 1 + home * rho)
        .when((s["h"] == 1) & (s["a"] == 0), 1 + away * rho).when((s["h"] == 1) & (s["a"] == 1), F.lit(1 - rho)).otherwise(1.0))
    raw = F.transform(matrix, lambda s: F.struct(s["h"].alias("h"), s["a"].alias("a"), (s["p"] * factor(s)).alias("p")))
    with_sum = F.transform(F.array(raw), lambda m: F.struct(m.alias("m"), total(m, lambda _: F.lit(True)).alias("t"), F.array_min(F.transform(m, lambda s: s["p"])).alias("least")))
    return F.transform(with_sum, lambda x: F.when(x["least"] < 0, F.raise_error(F.lit("rho makes a score's probability negative"))).otherwise(
        F.transform(x["m"], lambda s: F.struct(s["h"].alias("h"), s["a"].alias("a"), (s["p"] / x["t"]).alias("p")))))[0]


def total(matrix: Column, where) -> Column:
    """The probability of the scores for which ``where`` holds."""
    return F.aggregate(matrix, F.lit(0.0), lambda acc, s: acc + F.when(where(s), s["p"]).otherwise(0.0))


def markets(matrix: Column) -> Column:
    """struct<p_home, p_draw, p_away, p_over25, p_both, goals_home, goals_away>: chances and expected goals, in one fold over the scores."""
    parts = {
        "p_home": lambda s: F.when(s["h"] > s["a"], s["p"]), "p_draw": lambda s: F.when(s["h"] == s["a"], s["p"]), "p_away": lambda s: F.when(s["h"] < s["a"], s["p"]),
        "p_over25": lambda s: F.when(s["h"] + s["a"] > 2, s["p"]), "p_both": lambda s: F.when((s["h"] > 0) & (s["a"] > 0), s["p"]),
        "goals_home": lambda s: s["p"] * s["h"], "goals_away": lambda s: s["p"] * s["a"]}
    zero = F.struct(*[F.lit(0.0).alias(n) for n in parts])
    return F.aggregate(matrix, zero, lambda acc, s: F.struct(*[(acc[n] + F.coalesce(f(s), F.lit(0.0))).alias(n) for n, f in parts.items()]))


def top_scores(matrix: Column, n: int = 5) -> Column:
    """The ``n`` likeliest scores as array<struct<p, h, a>>, of equal ones the higher score first."""
    ordered = F.reverse(F.array_sort(F.transform(matrix, lambda s: F.struct(s["p"].alias("p"), s["h"].alias("h"), s["a"].alias("a")))))
    return F.slice(ordered, 1, n)


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the knots, flat outside: applies a fitted isotonic curve."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(ys[-1]))


def calibrated(probs: list[Column], curves: list[tuple[list[float], list[float]] | None], least: float = 1e-6) -> list[Column]:
    """Each class's probability through its own curve (or as it is), cut to ``least`` and 1, all scaled to sum to 1."""
    cut = [clip(p if c is None else interpolate(p, *c), least, 1.0) for p, c in zip(probs, curves, strict=True)]
    whole = sum(cut[1:], cut[0])
    return [c / whole for c in cut]


def blend_weight(rating_gap: Column, elo_gap: Column, close: float | Column = 0.15, strong: float | Column = 0.45, low: float | Column = 0.25, high: float | Column = 0.80) -> tuple[Column, Column, Column]:
    """(weight, strength, regime) of the second model: rises from ``low`` to ``high`` while the gap rises from ``close`` to ``strong``.

    The strength is the rating gap's size, else the Elo gap's over 600 (1 at most), else ``close``.
    """
    strength = F.coalesce(F.abs(rating_gap), F.least(F.abs(elo_gap) / 600.0, F.lit(1.0)), F.lit(close))
    weight = F.lit(low) + clip((strength - close) / (strong - close), 0.0, 1.0) * (high - low)
    return F.bround(weight, 4), F.bround(strength, 4), F.when(weight <= 0.35, "first_lean").when(weight >= 0.70, "second_lean").otherwise("blend")


def blended(first: Column, second: Column, weight: Column) -> Column:
    """(1 - weight) of the first and weight of the second; the other one alone where one is null."""
    return F.coalesce((1 - weight) * first + weight * second, first, second)


def signal_score(signals: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the signals that are there, in percent; null where none is."""
    value = sum((w * F.coalesce(c, F.lit(0.0)) for c, w in signals.values()), F.lit(0.0))
    return 100 * F.try_divide(value, sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in signals.values()), F.lit(0.0)))


def agreement(first: Column, second: Column, high: float = 0.05, medium: float = 0.10) -> tuple[Column, Column]:
    """How far two probabilities are apart, and what that is called."""
    d = F.abs(first - second)
    return F.bround(d, 4), F.when(d.isNull(), "N/A").when(d < high, "high").when(d < medium, "medium").otherwise("low")


def odds_agreement(first: Column, second: Column, high: float = 0.10, medium: float = 0.25) -> tuple[Column, Column]:
    """Two odds' difference as a share of their mean, and what that is called; null and N/A where either means nothing."""
    d = F.when((first > 0) & (second > 0), F.abs(first - second) / ((first + second) / 2))
    return d, F.when(d.isNull(), "N/A").when(d < high, "HIGH").when(d < medium, "MEDIUM").otherwise("LOW")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, joined by bars; empty where none does."""
    return F.concat_ws("|", *[F.when(c, F.lit(n)) for c, n in pairs])
