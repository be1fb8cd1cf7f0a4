"""Recurring times in a time zone, and readings of local times.

A local time that a clock change skips stands for the first minute after the jump; one that comes twice for its first occurrence.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame

HORIZON_DAYS = 800


def instant_of(local: datetime, zone: str) -> datetime:
    z = ZoneInfo(zone)
    aware = local.replace(tzinfo=z, fold=0)
    back = aware.astimezone(UTC).astimezone(z).replace(tzinfo=None)
    if back == local:
        return aware.astimezone(UTC)
    # skipped: the jump lies between the offsets before and after; its instant is where the later offset begins
    low, high = (aware - timedelta(hours=26)).astimezone(UTC), (aware + timedelta(hours=26)).astimezone(UTC)
    before = low.astimezone(z).utcoffset()
    while high - low > timedelta(minutes=1):
        mid = low + (high - low) / 2
        mid = mid.replace(second=0, microsecond=0)
        if mid <= low:
            break
        if mid.astimezone(z).utcoffset() == before:
            low = mid
        else:
            high = mid
    return high


def problems(rule: dict) -> list[str]:
    out = []
    every = rule.get("every")
    if every not in ("once", "daily", "weekly", "monthly"):
        out.append("every")
    hh, _, mm = str(rule.get("at", "")).partition(":")
    if not (hh.isdigit() and mm.isdigit() and int(hh) < 24 and int(mm) < 60):
        out.append("at")
    if every == "weekly" and not (rule.get("days") and all(d in range(1, 8) for d in rule["days"])):
        out.append("days")
    if every == "monthly" and not (rule.get("day") == "last" or rule.get("day") in range(1, 32)):
        out.append("day")
    if every == "once" and not rule.get("on"):
        out.append("on")
    return out


def _falls_on(rule: dict, day: date) -> bool:
    if rule["every"] == "once":
        return day.isoformat() == rule["on"]
    if rule["every"] == "weekly":
        return day.isoweekday() in rule["days"]
    if rule["every"] == "monthly":
        last = calendar.monthrange(day.year, day.month)[1]
        return day.day == (last if rule["day"] == "last" else min(rule["day"], last))
    return True


def runs(rule: dict, after: datetime, zone: str, most: int | None = 1, until: datetime | None = None) -> list[datetime]:
    """The next instants strictly after ``after``, at most ``most`` of them; none for a rule with problems, beyond ``until`` or, without that, beyond
    the horizon."""
    if problems(rule):
        return []
    days = HORIZON_DAYS + 2 if until is None else max(0, (until - after).days) + 4
    hh, mm = map(int, rule["at"].split(":"))
    day, out = after.astimezone(ZoneInfo(zone)).date() - timedelta(days=1), []
    for _ in range(days):
        if _falls_on(rule, day):
            t = instant_of(datetime(day.year, day.month, day.day, hh, mm), zone)
            if until is not None and t > until:
                break
            if t > after:
                out.append(t)
                if len(out) == most:
                    break
        day += timedelta(days=1)
    return out


def upcoming(rules: DataFrame, after: datetime, until: datetime) -> DataFrame:
    """(id, at) of all occurrences of rules (id, every, at_time, days, day, on, zone) in (after, until]."""
    after, until = (t.replace(tzinfo=UTC) if t.tzinfo is None else t for t in (after, until))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                day = r["day"]
                rule = {"every": r["every"], "at": r["at_time"], "days": None if r["days"] is None else [int(x) for x in r["days"]], "day": "last" if day == "last" else int(day) if day else None, "on": r["on"]}
                out += [(r["id"], t.replace(tzinfo=None)) for t in runs(rule, after, r["zone"], None, until)]
            yield pd.DataFrame(out, columns=["id", "at"]).astype({"at": "datetime64[us]"})

    return rules.mapInPandas(run, f"id {rules.schema['id'].dataType.simpleString()}, at timestamp_ntz")
