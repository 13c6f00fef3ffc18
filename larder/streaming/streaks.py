"""Streaks of users, by day: a fold over a table, and the same as a keyed stream with timers.

Both take rows of user_id, ts, event_id and action (count, grace or freeze) in the order of ts and event_id, and return one
row for each: what became of it, and the streak after it. The fold reads a user's rows one batch at a time, whatever their
number, and keeps one status per day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.streak_rules import Streak

OUT = "user_id long, event_id long, day date, action string, outcome string, current int, longest int, tokens int, milestone int"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _rows(user: int, streak: Streak, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for ts, key, action in zip(rows["ts"], rows["event_id"], rows["action"]):
        day = ts.date()
        outcome, milestone = streak.take(action, day)
        out.append((user, key, day, action, outcome, streak.current, streak.longest, streak.tokens, milestone))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"milestone": "Int32"})


def folded(actions: DataFrame) -> DataFrame:
    """One row per action of a table. Rows without a user or time take no part."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, streak = None, Streak()
        for batch in batches:
            out = []
            for key, own in batch.groupby("user_id", sort=False):
                if key != user:
                    user, streak = key, Streak()
                out += _rows(user, streak, own)
            yield _frame(out)

    rows = actions.filter("user_id is not null and ts is not null").select("user_id", "ts", "event_id", "action")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(fold, OUT)


class _Keeper(StatefulProcessor):
    """A user's streak in value and map state, and a timer for the day on which it has lapsed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "current int, longest int, tokens int, grace_week date, last date, reached array<int>")
        self.days = handle.getMapState("days", "day date", "status string")

    def _load(self) -> Streak:
        s = self.streak.get() if self.streak.exists() else (0, 0, 0, None, None, [])
        return Streak(s[0], s[1], s[2], s[3], s[4], tuple(s[5]), {k[0]: v[0] for k, v in self.days.iterator()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        s = self._load()
        before, last = dict(s.days), s.last
        out = _rows(key[0], s, own)
        self.streak.update((s.current, s.longest, s.tokens, s.grace_week, s.last, list(s.reached)))
        for day, status in s.days.items():
            if before.get(day) != status:
                self.days.updateValue((day,), (status,))
        if s.last != last:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(_ends(s.last))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if s.last is not None and expiredTimerInfo.getExpiryTimeInMs() == _ends(s.last):
            yield _frame([(key[0], None, s.last, "timer", "lapsed", 0, s.longest, s.tokens, None)])

    def close(self) -> None:
        pass


def _ends(last: dt.date) -> int:
    """Milliseconds at which a streak whose last day this is has lapsed: the end of the next day, UTC."""
    return int(dt.datetime(last.year, last.month, last.day, tzinfo=dt.UTC).timestamp() + 2 * 86_400) * 1000


def kept(actions: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream of the fold's rows; where the watermark passes the day after a user's last counted one, one more row says
    that the streak has lapsed. Rows later than `late` are left out. Needs the session's time zone to be UTC and the
    RocksDB state store, which this sets."""
    spark = actions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = actions.filter("user_id is not null and ts is not null").select("user_id", "ts", "event_id", "action").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_Keeper(), OUT, "Append", "EventTime")


def as_actions(events: DataFrame) -> DataFrame:
    """Actions of the driver's events: views, clicks and purchases count, sign-ups ask for grace, errors for a freeze."""
    action = F.when(F.col("event_type") == "signup", "grace").when(F.col("event_type") == "error", "freeze").otherwise("count")
    return events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"))
