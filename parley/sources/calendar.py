"""iCalendar feeds: parsing, time zones, recurrence (SRC-6, SN-11, SN-12)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weekday codes, and occurrences looked at for one rule.
DAYS, MOST = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"], 5000
EVENT = "uid string, title string, start_ms bigint, end_ms bigint, attendees array<string>"


def unfold(text: str) -> list[str]:
    """Content lines; a line that starts with a space or a tab continues the one before."""
    return re.sub(r"\r?\n[ \t]", "", text).splitlines()


def property_of(line: str) -> tuple[str, dict[str, str], str]:
    """Name, parameters and value of a content line."""
    head, _, value = line.partition(":")
    name, *params = head.split(";")
    return name.upper(), dict(p.split("=", 1) for p in params if "=" in p), value


def instant(value: str, params: dict[str, str]) -> datetime | None:
    """The instant of a date-time: UTC with Z, else in its TZID, an unknown zone as UTC. None for a date."""
    m = re.match(r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(Z?)$", value.strip())
    if not m or params.get("VALUE") == "DATE":
        return None
    zone = timezone.utc
    if not m[7] and "TZID" in params:
        try:
            zone = ZoneInfo(params["TZID"])
        except (KeyError, ValueError, OSError):
            zone = timezone.utc
    return datetime(*(int(m[i]) for i in range(1, 7)), tzinfo=zone)


def to_epoch(wall: Column, zone: Column) -> Column:
    """Epoch ms of a wall-clock time (yyyyMMddTHHmmss) in a zone; a zone that nobody knows counts as UTC (SN-11)."""

    @F.pandas_udf("long")
    def run(walls: pd.Series, zones: pd.Series) -> pd.Series:
        found = [instant(w or "", {"TZID": z} if z else {}) for w, z in zip(walls, zones)]
        return pd.Series([int(t.timestamp() * 1000) if t else None for t in found], dtype="Int64")

    return run(wall, zone)


def occurrences(start: datetime, rule: str, until: datetime):
    """Starts of a DAILY, WEEKLY (with BYDAY) or MONTHLY rule up to `until`; wall-clock time is kept."""
    r = dict(p.split("=", 1) for p in rule.split(";") if "=" in p)
    step, count = max(1, int(r.get("INTERVAL", "1"))), int(r["COUNT"]) if "COUNT" in r else None
    limit = instant(r.get("UNTIL", ""), {}) or until  # a date-only UNTIL falls back to the window's end
    days = sorted(DAYS.index(d[-2:]) for d in r.get("BYDAY", "").split(",") if d[-2:] in DAYS) or [start.weekday()]
    made = 0
    for i in range(MOST):
        if r.get("FREQ") == "DAILY":
            found = [start + timedelta(days=i * step)]
        elif r.get("FREQ") == "WEEKLY":
            monday = start - timedelta(days=start.weekday())
            found = [t for d in days if (t := monday + timedelta(days=7 * i * step + d)) >= start]
        elif r.get("FREQ") == "MONTHLY":
            # A day that the month lacks runs over into the next one.
            month = start.month - 1 + i * step
            found = [start.replace(year=start.year + month // 12, month=month % 12 + 1, day=1) + timedelta(days=start.day - 1)]
        else:
            found = [start] if i == 0 else []
        if i and not found and r.get("FREQ") not in ("WEEKLY",):
            return
        for t in found:
            if count is not None and made >= count or t > limit or t > until:
                return
            made += 1
            yield t


def parse(text: str, from_ms: int, to_ms: int) -> list[tuple]:
    """Events of a feed that start in a window: no all-day ones, no cancelled ones, rules expanded, EXDATEs left out."""
    out = []
    end_of_window = datetime.fromtimestamp(to_ms / 1000, timezone.utc)
    event: dict | None = None
    for line in unfold(text):
        name, params, value = property_of(line)
        if name == "BEGIN" and value == "VEVENT":
            event = {"attendees": [], "except": set()}
        elif name == "END" and value == "VEVENT" and event is not None:
            start = event.get("start")
            if start and event.get("status") != "CANCELLED":
                length = (event["end"] - start) if event.get("end") else timedelta(0)
                for t in occurrences(start, event["rule"], end_of_window) if "rule" in event else [start]:
                    ms = int(t.timestamp() * 1000)
                    if from_ms <= ms <= to_ms and ms not in event["except"]:
                        out.append((event.get("uid"), event.get("title", ""), ms, ms + int(length.total_seconds() * 1000), event["attendees"]))
            event = None
        elif event is not None:
            if name in ("DTSTART", "DTEND"):
                event["start" if name == "DTSTART" else "end"] = instant(value, params)
            elif name == "EXDATE":
                event["except"] |= {int(t.timestamp() * 1000) for v in value.split(",") if (t := instant(v, params))}
            elif name == "RRULE":
                event["rule"] = value
            elif name == "ATTENDEE":
                event["attendees"].append(params.get("CN") or re.sub("(?i)^mailto:", "", value))
            elif name in ("UID", "SUMMARY", "STATUS"):
                event[{"UID": "uid", "SUMMARY": "title", "STATUS": "status"}[name]] = re.sub(r"\\([,;\\])", r"\1", value) if name == "SUMMARY" else value
    return sorted(out, key=lambda e: (e[2], e[1]))


def events(feeds: DataFrame, from_ms: int, to_ms: int, text_col: str = "value") -> DataFrame:
    """Events of feeds (a whole calendar a row, as from a wholetext read)."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([e for t in f[text_col] for e in parse(t or "", from_ms, to_ms)], columns=["uid", "title", "start_ms", "end_ms", "attendees"])

    return feeds.select(text_col).mapInPandas(run, EVENT)
