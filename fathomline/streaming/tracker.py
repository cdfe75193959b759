"""A tracker of signals as a stream with state: what came first stays, what came last holds, results settle, silence expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What events bring: ``kind`` is signal, closing or result. ``odds`` for the first two, ``stake`` for signals, ``result`` (win, loss, void) for results.
EVENT = "signal_id string, event_id long, ts timestamp, kind string, odds double, stake double, result string"
#: A tracked signal. ``change`` says what brought the row about.
TRACKED = "signal_id string, first_seen timestamp, last_seen timestamp, first_odds double, latest_odds double, stake double, closing_odds double, result string, clv_pct double, profit double, status string, change string"
#: First and last signal, closing odds and result, each with the time and event that it is from.
_STATE = ("f_ts long, f_id long, first_odds double, stake double, l_ts long, l_id long, latest_odds double, "
          "c_ts long, c_id long, closing_odds double, r_ts long, r_id long, result string, expired boolean")
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def _absent(v) -> bool:
    return v is None or v != v


def merged(state: dict, event) -> dict:
    """The state with an event: the order in which events come, and how often, makes no difference."""
    at = (int(event.ts.value // 1000), int(event.event_id))

    def later(mark: str) -> bool:
        return _absent(state[f"{mark}_ts"]) or at > (int(state[f"{mark}_ts"]), int(state[f"{mark}_id"]))

    state = dict(state)
    if event.kind == "signal":
        if _absent(state["f_ts"]) or at < (int(state["f_ts"]), int(state["f_id"])):
            state |= {"f_ts": at[0], "f_id": at[1], "first_odds": event.odds, "stake": 0.0 if _absent(event.stake) else event.stake}
        if later("l"):
            state |= {"l_ts": at[0], "l_id": at[1], "latest_odds": event.odds}
    elif event.kind == "closing" and later("c"):
        state |= {"c_ts": at[0], "c_id": at[1], "closing_odds": event.odds}
    elif event.kind == "result" and later("r"):
        state |= {"r_ts": at[0], "r_id": at[1], "result": event.result}
    return state


def _settled(first_odds, stake, result):
    if result == "win":
        return round((first_odds - 1) * stake, 3)
    return round(-stake, 3) if result == "loss" else 0.0 if result == "void" else None


class Tracker(StatefulProcessor):
    """One row of state a signal; a timer runs out ``expire_ms`` after its last signal if no result came."""

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("signal", _STATE)

    def _row(self, key, state: dict, change: str) -> pd.DataFrame:
        at = lambda v: None if _absent(v) else pd.Timestamp(int(v), unit="us")
        none = lambda v: None if _absent(v) else v
        first, closing, result = none(state["first_odds"]), none(state["closing_odds"]), none(state["result"])
        clv = round((first / closing - 1) * 100, 3) if first and closing else None
        status = "settled" if result else "expired" if state["expired"] else "open"
        row = (key[0], at(state["f_ts"]), at(state["l_ts"]), first, none(state["latest_odds"]), none(state["stake"]), closing, result, clv, None if first is None else _settled(first, state["stake"], result), status, change)
        frame = pd.DataFrame([row], columns=[c.split()[0] for c in TRACKED.split(", ")])
        return frame.astype({c: "float64" for c in ("first_odds", "latest_odds", "stake", "closing_odds", "clv_pct", "profit")} | {c: "datetime64[us]" for c in ("first_seen", "last_seen")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.exists()
        before = dict(zip(_FIELDS, self.state.get(), strict=True)) if known else dict.fromkeys(_FIELDS)
        if not known:
            before["expired"] = False
        after = before
        for frame in rows:
            for event in frame.itertuples(index=False):
                after = merged(after, event)
        if after == before and known:
            return
        moved = after["l_ts"] != before["l_ts"]
        if moved:
            after["expired"] = False
        self.state.update(tuple(after[f] for f in _FIELDS))
        if moved:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(int(after["l_ts"]) // 1000 + self.expire_ms)
        if not _absent(after["f_ts"]):  # a result alone waits for its signal
            yield self._row(key, after, "insert" if _absent(before["f_ts"]) else "settle" if after["r_ts"] != before["r_ts"] else "update")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = dict(zip(_FIELDS, self.state.get(), strict=True))
        if _absent(state["result"]) and not state["expired"]:
            state["expired"] = True
            self.state.update(tuple(state[f] for f in _FIELDS))
            yield self._row(key, state, "expire")

    def close(self) -> None:
        pass


def track(events: DataFrame, expire_hours: int = 72, late: str = "1 day") -> DataFrame:
    """The changes of tracked signals (see ``TRACKED``) on a stream of events (see ``EVENT``).

    The first signal's time, odds and stake are kept, the last one's time and odds hold,
    and so do the last closing odds and result. Repeated events and events out of order
    change nothing that the right order wouldn't have given; only events further than
    ``late`` behind the latest one seen are dropped. A signal without a result
    that isn't seen for ``expire_hours`` of event time expires, and a result or a new
    signal brings it back. Needs the RocksDB state store.
    """
    named = events.selectExpr(*[f"CAST({f.split()[0]} AS {f.split()[1]}) AS {f.split()[0]}" for f in EVENT.split(", ")]).where("signal_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL")
    return named.withWatermark("ts", late).groupBy("signal_id").transformWithStateInPandas(
        statefulProcessor=Tracker(expire_hours * 3_600_000), outputStructType=TRACKED, outputMode="Update", timeMode="EventTime")


def replayed(events: DataFrame, expire_hours: int = 72, now: Column | None = None, digits: int | None = 3) -> DataFrame:
    """The same tracker over a whole table of events, as aggregates; ``now`` (the latest event's time) decides what has expired.

    Closing value and profit have ``digits``, or are exact (None) for callers that round them themselves: rounding twice isn't rounding once.
    """
    known = events.where("signal_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.struct("ts", "event_id")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    agg = known.groupBy("signal_id").agg(
        F.min(of("signal", F.col("ts"))).alias("first_seen"), F.max(of("signal", F.col("ts"))).alias("last_seen"), F.min_by("odds", of("signal", at)).alias("first_odds"), F.max_by("odds", of("signal", at)).alias("latest_odds"),
        F.coalesce(F.min_by("stake", of("signal", at)), F.lit(0.0)).alias("stake"), F.max_by("odds", of("closing", at)).alias("closing_odds"), F.max_by("result", of("result", at)).alias("result"), F.max("ts").alias("_ts"))
    agg = agg.where(F.col("first_seen").isNotNull())
    latest = known.agg(F.max("ts").alias("_now"))
    agg = agg.crossJoin(F.broadcast(latest)) if now is None else agg.withColumn("_now", now)  # one row
    cut = lambda v: v if digits is None else F.round(v, digits)
    profit = F.when(F.col("result") == "win", cut((F.col("first_odds") - 1) * F.col("stake"))).when(F.col("result") == "loss", cut(-F.col("stake"))).when(F.col("result") == "void", 0.0)
    status = F.when(F.col("result").isNotNull(), "settled").when(F.col("last_seen") + F.make_interval(hours=F.lit(expire_hours)) < F.col("_now"), "expired").otherwise("open")
    return agg.select("signal_id", "first_seen", "last_seen", "first_odds", "latest_odds", "stake", "closing_odds", "result", F.when(F.col("closing_odds") != 0, cut((F.col("first_odds") / F.col("closing_odds") - 1) * 100)).alias("clv_pct"), profit.alias("profit"), status.alias("status"))


def log_changes(changes: DataFrame, path: str, checkpoint: str):
    """A writer of a change stream: each micro-batch is a folder of its own rows, so nothing written before is read or written again, and a repeated batch replaces itself."""
    def apply(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return changes.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint)


def latest_changes(log: DataFrame, key: str) -> DataFrame:
    """The table that a change log (with the column ``batch`` of its folders) stands for: each key's last row."""
    rest = [c for c in log.columns if c not in (key, "batch")]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")
