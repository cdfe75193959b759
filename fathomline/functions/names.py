"""Names: accents, keys for comparing, canonical forms, similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks. Spark has no such function, so texts go through Arrow batches, plain ASCII ones untouched."""
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def team_key(name: Column) -> Column:
    """Accents gone, lower case, "&" read as "and", full stops and commas as spaces; apostrophes and hyphens stay. Empty for null."""
    low = F.replace(F.lower(strip_accents(F.trim(F.coalesce(name, F.lit(""))))), F.lit("&"), F.lit(" and "))
    return _spaced(F.regexp_replace(low, r"[^a-z0-9\s'-]", " "))


def identity_key(name: Column) -> Column:
    """Accents gone, case folded, all but letters and digits of ASCII read as spaces. Empty for null."""
    low = F.replace(F.lower(strip_accents(F.coalesce(name, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return _spaced(F.regexp_replace(low, "[^a-z0-9]+", " "))


def letters_key(name: Column) -> Column:
    """Accents gone, lower case, all but letters of ASCII and white space dropped. Empty for null."""
    return _spaced(F.regexp_replace(F.lower(strip_accents(F.trim(F.coalesce(name, F.lit(""))))), r"[^a-z\s]", ""))


def text_key(text: Column) -> Column:
    """Case folded, accents kept apart: all but letters and digits of ASCII read as spaces. Empty for null."""
    return _spaced(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def underscored(key: Column) -> Column:
    return F.trim(F.regexp_replace(key, "[^a-z0-9]+", "_"), F.lit("_"))


def inverted(name: Column) -> Column:
    """The first word put last; names of one word as they are."""
    words = F.split(name, " ")
    return F.when(F.size(words) > 1, F.concat_ws(" ", F.slice(words, 2, F.size(words)), F.get(words, F.lit(0)))).otherwise(name)


def sorted_words(key: Column) -> Column:
    """The key's distinct words in order."""
    return F.concat_ws(" ", F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))))


#: Organisational words that clubs add to their names; fixed values.
CLUB_WORDS = "fc cf sc afc ac cd ca club se ss ssc ogc osc bsc hsc fk sk sl sv vfb tsg rc cr us ks hnk if jk futbol football soccer deportivo united".split()


def club_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """An identity key without country tags, ordinals and the words that clubs add to their names.

    ``aliases``: phrases of whole words, in identity-key form, and what they are read as,
    applied in their order. Names made of nothing but such words keep their key.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\s*\([A-Za-z]{3}\)\s*$", ""), r"\s*-[A-Z]{3}\s*$", ""), r"\s*\([^)]+\)\s*$", ""), r"^\s*[0-9]+\.\s*", "")
    key = identity_key(bare)
    for phrase, short in (aliases or {}).items():
        key = F.trim(F.replace(F.concat(F.lit(" "), key, F.lit(" ")), F.lit(f" {phrase} "), F.lit(f" {short} ")))
    kept = F.regexp_replace(F.array_join(F.filter(F.split(key, " "), lambda w: ~w.isin(CLUB_WORDS)), " "), r"\s+c f$", "")
    return F.when(kept != "", kept).otherwise(key)


#: Straight and curly double quotes, and the apostrophe.
_QUOTES = "[\"\u201c\u201d']+"
_UNQUOTED = "[^\"\u201c\u201d']+"


def nickname(name: Column) -> Column:
    """What stands between quotes first, trimmed; empty without."""
    return F.trim(F.regexp_extract(name, f"{_QUOTES}({_UNQUOTED}){_QUOTES}", 1))


def without_nickname(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, rf"\s*{_QUOTES}{_UNQUOTED}{_QUOTES}\s*", " "))


def compact_key(key: Column) -> Column:
    """A key without its spaces."""
    return F.regexp_replace(key, "[^a-z0-9]+", "")


def canonical(df: DataFrame, name: str, aliases: DataFrame, out: str, strict: bool = False) -> DataFrame:
    """The canonical form of ``name`` by its team key; others pass through trimmed, or are null (``strict``).

    ``aliases`` (key, canonical): a small table of distinct team keys, bounded by its maker.
    """
    known = aliases.select(F.col("key").alias("_key"), F.col("canonical").alias("_canonical"))
    found = df.withColumn("_key", team_key(F.col(name))).join(F.broadcast(known), "_key", "left")
    return found.withColumn(out, F.col("_canonical") if strict else F.coalesce("_canonical", F.trim(name))).drop("_key", "_canonical")


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's similarity: twice the characters of matching blocks by those of both; 1 for equal, 0 where one is empty."""
    return pd.Series([1.0 if x == y and x else SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def first_of(df: DataFrame, names: list[str]) -> str | None:
    """The first of several names that the table has, letter case apart; decided while the plan is built."""
    own = {c.lower(): c for c in df.columns}
    return next((own[n.lower()] for n in names if n.lower() in own), None)


def aliased(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns by the names their aliases stand for; null strings where the table has none of them."""
    return df.select(*[(F.col(f"`{c}`") if (c := first_of(df, [n, *others])) else F.lit(None).cast("string")).alias(n) for n, others in wanted.items()])
