"""Odds over time as intervals of one price, and their merge with quotes that come later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.operators.joins import join_null_safe


def _quoted(quotes: DataFrame, key: list[str], time: str, tie: str, value: str) -> DataFrame:
    """One row a key and time: of several quotes of one time the one with the largest ``tie`` holds.

    Rows are dealt by key and sorted once, by time and tie, which serves all windows that
    follow; a maximum of structs would sort the whole input before that.
    """
    known = quotes.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    last = F.row_number().over(W.partitionBy(*key, time).orderBy(F.desc(tie)))
    rows = known.select(*key, time, value, tie).repartition(*key).withColumn("_last", last).where("_last = 1")
    return rows.select(*key, F.col(time).alias("_from"), F.col(time).alias("_seen"), F.col(value).alias("_v"), F.lit(1).cast("long").alias("_n"))


def _islands(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows where a new value begins, with what the next one's beginning tells of their end: one sort, no aggregate."""
    along = W.partitionBy(*key).orderBy("_from")
    before, whole = along.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*key)
    marked = rows.withColumns({
        "_same": F.lag("_v").over(along).eqNullSafe(F.col("_v")), "_seen_before": F.max("_seen").over(before), "_n_before": F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")),
        "_seen_last": F.max("_seen").over(whole), "_n_all": F.sum("_n").over(whole)})
    first = F.row_number().over(along) == 1
    begun = marked.withColumn("_first", first).where("_first OR NOT _same")
    upto = F.lead("_from").over(along)
    found = begun.withColumns({"valid_to": upto, "last_seen": F.coalesce(F.lead("_seen_before").over(along), "_seen_last"), "quotes": F.coalesce(F.lead("_n_before").over(along), "_n_all") - F.col("_n_before")})
    return found.withColumn("is_current", F.col("valid_to").isNull()).select(*key, F.col("_v").alias(value), F.col("_from").alias("valid_from"), "valid_to", "last_seen", "quotes", "is_current")


def intervals(quotes: DataFrame, key: list[str], time: str, tie: str, value: str) -> DataFrame:
    """key, value, valid_from, valid_to, last_seen, quotes and is_current: runs of one value, in the order of ``time``.

    A run is valid until the next one begins; the last one is current and has no end.
    Nulls in the key are a value of their own; quotes without a time or value are left out.
    """
    return _islands(_quoted(quotes, key, time, tie, value), key, value)


def current(found: DataFrame, key: list[str], value: str) -> DataFrame:
    """The current value of each key, since when it holds and when it was last seen."""
    return found.where("is_current").select(*key, value, "valid_from", "last_seen")


def merged(found: DataFrame, history: DataFrame, new: DataFrame, key: list[str], time: str, tie: str, value: str) -> DataFrame:
    """``found``, the intervals of ``history``, brought up to date with the quotes of ``new``.

    Keys without new quotes pass through. Where all new quotes are later than what was
    seen, only the current interval is touched: it goes on, or ends where the price
    changes. Only keys with a quote that comes late are made anew, from their history.
    """
    fresh = _quoted(new, key, time, tie, value)
    seen = found.groupBy(*key).agg(F.max("last_seen").alias("_last"))
    begun = fresh.groupBy(*key).agg(F.min("_from").alias("_first"))
    state = join_null_safe(begun, seen, key, "left")
    late = state.where(F.col("_first") <= F.col("_last")).select(*key)
    later = join_null_safe(state.select(*key), late, key, "left_anti")
    touched = state.select(*key)
    still = join_null_safe(found, touched, key, "left_anti")
    own = join_null_safe(found, later, key, "left_semi")
    open_ends = own.where("is_current").select(*key, F.col("valid_from").alias("_from"), F.col("last_seen").alias("_seen"), F.col(value).alias("_v"), F.col("quotes").alias("_n"))
    grown = _islands(open_ends.unionByName(join_null_safe(fresh, later, key, "left_semi")), key, value)
    columns = [*key, time, tie, value]
    again = intervals(join_null_safe(history.select(*columns).unionByName(new.select(*columns)), late, key, "left_semi"), key, time, tie, value)
    return still.unionByName(own.where("NOT is_current")).unionByName(grown).unionByName(again)
