"""The rules of streaks as one step on a user's state; the batch fold and the stream both take it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

#: Counts that are milestones, and days of a streak that earn a freeze token.
MILESTONES = (7, 21, 45, 90)
TOKEN_DAYS = 7


@dataclass
class Streak:
    """A user's streak. `days` holds the status of each day, `reached` the milestones so far."""

    current: int = 0
    longest: int = 0
    tokens: int = 0
    grace_week: dt.date | None = None
    last: dt.date | None = None
    reached: tuple[int, ...] = ()
    days: dict[dt.date, str] = field(default_factory=dict)

    def take(self, action: str, day: dt.date) -> tuple[str, int | None]:
        """Outcome and, when one is reached for the first time, milestone of an action (count, grace or freeze) for a day.

        A day counts once; it continues the streak up to the day after the last one, else a new one starts. Each multiple of
        seven that a count passes earns a token. Grace is given once a week from Monday, and not for a counted day; a freeze
        takes a token. Neither moves the streak."""
        if action == "count":
            if self.days.get(day) == "counted":
                return "already_counted", None
            before = self.current
            kept = before if self.last is not None and (day - self.last).days <= 1 else 0
            self.current = kept + 1
            self.longest = max(self.longest, self.current)
            self.tokens += max(0, self.current // TOKEN_DAYS - before // TOKEN_DAYS)
            self.last = day
            self.days[day] = "counted"
            if self.current in MILESTONES and self.current not in self.reached:
                self.reached += (self.current,)
                return "counted", self.current
            return "counted", None
        if action == "grace":
            week = day - dt.timedelta(days=day.weekday())
            if self.grace_week == week:
                return "grace_already_used", None
            if self.days.get(day) == "counted":
                return "day_already_counted", None
            self.days[day], self.grace_week = "grace", week
            return "grace_applied", None
        if action == "freeze":
            if self.tokens <= 0:
                return "no_tokens", None
            self.days[day] = "frozen"
            self.tokens -= 1
            return "freeze_used", None
        raise ValueError(f"unknown action {action!r}")
