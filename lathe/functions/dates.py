"""The relative date language: today-week, now|day, 2month+3day; dates as unix seconds, durations as months and seconds."""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

UTC = timezone.utc
# Seconds of the units. A month counts 28 days, a quarter 13 weeks and a year 52 weeks where no calendar applies.
SECONDS = {
    "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 28 * 86400, "quarter": 13 * 7 * 86400,
    "year": 52 * 7 * 86400, "nanosecond": 1e-9, "microsecond": 1e-6, "millisecond": 1e-3,
}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
ALIASES = {"s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "y": "year"}
FORMATS = (
    "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f%z",
    "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d", "%d-%b-%Y", "%d %b %Y",
    "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%a, %d %b %Y %H:%M:%S %Z", "%a, %d %b %Y %H:%M:%S %z", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S", "%Y%m%d", "%Y-%m",
)
TERM = re.compile(r"\s*([+\-|]?)\s*(\d+(?:\.\d+)?)?\s*([a-zA-Z]+)\s*")


@dataclass(frozen=True)
class Duration:
    """Calendar months, and seconds besides."""

    months: float = 0
    rest: float = 0.0

    @property
    def seconds(self) -> float:
        return self.months * SECONDS["month"] + self.rest if self.months % 12 else self.months / 12 * SECONDS["year"] + self.rest

    def __add__(self, other: Duration) -> Duration:
        return Duration(self.months + other.months, self.rest + other.rest)

    def __mul__(self, k: float) -> Duration:
        return Duration(self.months * k, self.rest * k)

    __rmul__ = __mul__

    def __neg__(self) -> Duration:
        return self * -1

    def __sub__(self, other: Duration) -> Duration:
        return self + -other

    def __truediv__(self, other: Duration | float) -> Duration | float:
        if isinstance(other, Duration):
            return self.months / other.months if self.months and other.months and not self.rest and not other.rest else self.seconds / other.seconds
        return self * (1 / other)

    def floor(self, unit: Duration) -> Duration:
        if unit.months:
            return Duration(int(self.months // unit.months * unit.months))
        return Duration(0, self.seconds // unit.seconds * unit.seconds)

    def round(self, unit: Duration, decimal: int = 0) -> float:
        return round(self.seconds / unit.seconds, decimal)

    def __str__(self) -> str:
        out, left = [], self.rest
        if self.months:
            out.append(f"{self.months:g}month")
        for name in ("week", "day", "hour", "minute", "second"):
            n = left // SECONDS[name] if name != "second" else left
            if n:
                out.append(f"{n:g}{name}")
                left -= n * SECONDS[name]
        return "+".join(out) or "zero"


def unit(name: str) -> Duration:
    name = name.lower()
    name = ALIASES.get(name, name.removesuffix("s") if name not in SECONDS else name)
    if name not in SECONDS:
        raise ValueError(f"not a unit of time: {name}")
    return Duration(MONTHS[name]) if name in MONTHS else Duration(0, float(SECONDS[name]))


def parse_duration(value) -> Duration:
    """Seconds, a unit, or a sum such as 2day+3hour."""
    if isinstance(value, Duration):
        return value
    if isinstance(value, timedelta):
        return Duration(0, value.total_seconds())
    if isinstance(value, (int, float)):
        return Duration(0, float(value))
    if isinstance(value, dict) and set(value) == {"duration"}:
        return parse_duration(value["duration"])
    text = value.strip()
    if text == "zero":
        return Duration()
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return Duration(0, float(text))
    total, at = Duration(), 0
    while at < len(text):
        m = TERM.match(text, at)
        if not m or not m[0]:
            raise ValueError(f"not a duration: {value!r}")
        sign, count, name = m.groups()
        if sign == "|":
            total = total.floor(unit(name))
        else:
            total = total + unit(name) * (float(count or 1) * (-1 if sign == "-" else 1))
        at = m.end()
    return total


def as_datetime(seconds: float) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)


def add(seconds: float, step: Duration) -> float:
    """Months by the calendar (the day of month is kept where the month has it), then seconds."""
    if step.months:
        d = as_datetime(seconds)
        whole = int(step.months)
        month = d.year * 12 + d.month - 1 + whole
        year, month = divmod(month, 12)
        d = d.replace(year=year, month=month + 1, day=min(d.day, monthrange(year, month + 1)[1]))
        seconds = d.timestamp() + (step.months - whole) * SECONDS["month"]
    return seconds + step.rest


def floor(seconds: float, step: Duration = Duration(0, 86400.0)) -> float:
    """To whole steps since the epoch; weeks begin on Sunday; months, quarters and years by the calendar."""
    if step.months:
        d = as_datetime(seconds)
        month = (d.year * 12 + d.month - 1) // int(step.months) * int(step.months)
        return datetime(month // 12, month % 12 + 1, 1, tzinfo=UTC).timestamp()
    offset = 4 * 86400 if step.rest % SECONDS["week"] == 0 else 0  # the epoch was a Thursday
    return (seconds + offset) // step.rest * step.rest - offset


def ceiling(seconds: float, step: Duration) -> float:
    low = floor(seconds, step)
    return low if low == seconds else add(low, step)


def parse_date(value, now: float | None = None) -> float:
    """Unix seconds of a date: a number (milliseconds if over 9,999,999,999), a date, a formatted text, or an expression of now,
    today, tomorrow, eod with +, - and | (floor)."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"not a date: {value!r}")
    if isinstance(value, (int, float)):
        return value / 1000.0 if value > 9_999_999_999 else float(value)
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=UTC)).timestamp()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day, tzinfo=UTC).timestamp()
    if isinstance(value, dict) and set(value) == {"date"}:
        return parse_date(value["date"], now)
    text = value.strip()
    if re.fullmatch(r"\d{9,10}(\.\d+)?|\d{12,13}(\.\d+)?", text):
        return parse_date(float(text))
    now = datetime.now(UTC).timestamp() if now is None else now
    m = re.match(r"(now|today|tomorrow|eod)\b", text)
    if m:
        today = floor(now)
        at = {"now": now, "today": today, "tomorrow": today + 86400, "eod": today + 86400}[m[1]]
        pos = m.end()
        while pos < len(text):
            t = TERM.match(text, pos)
            if not t or not t[1]:
                raise ValueError(f"not a date: {value!r}")
            sign, count, name = t.groups()
            step = unit(name) * float(count or 1)
            at = floor(at, step) if sign == "|" else add(at, step if sign == "+" else -step)
            pos = t.end()
        return at
    tidy = text.replace("Z", "+0000") if text.endswith("Z") else text
    for f in FORMATS:
        try:
            d = datetime.strptime(tidy, f)
        except ValueError:
            continue
        return (d if d.tzinfo else d.replace(tzinfo=UTC)).timestamp()
    raise ValueError(f"not a date: {value!r}")


def date_range(low: float, high: float, step: Duration) -> list[float]:
    out = []
    while low < high:
        out.append(low)
        low = add(low, step)
    return out


def strftime(seconds: float, pattern: str = "%Y-%m-%d %H:%M:%S") -> str:
    return as_datetime(seconds).strftime(pattern)
