"""Sizes, durations and intervals as policies write them; parsed once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes in each unit.
UNITS = {"": 1, "b": 1, "k": 1 << 10, "kib": 1 << 10, "kb": 10**3, "m": 1 << 20, "mib": 1 << 20, "mb": 10**6, "g": 1 << 30, "gib": 1 << 30, "gb": 10**9, "t": 1 << 40, "tib": 1 << 40, "tb": 10**12}
#: Seconds in each unit; a bare number counts seconds.
SECONDS = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
MOST = (1 << 63) - 1


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return min(MOST, int(float(m[1]) * UNITS[m[2].lower()] + 0.5))


def parse_duration(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * SECONDS[m[2]]


@dataclass(frozen=True)
class Interval:
    """Numbers between two ends, each open, closed or missing."""

    low: int | None = None
    high: int | None = None
    low_in: bool = True
    high_in: bool = True
    text: str = ""

    @classmethod
    def parse(cls, text: str, unit=parse_size) -> Interval:
        t = text.strip()
        for sign, build in ((">=", lambda n: (n, None, True, True)), ("<=", lambda n: (None, n, True, True)), (">", lambda n: (n, None, False, True)), ("<", lambda n: (None, n, True, False)), ("=", lambda n: (n, n, True, True))):
            if t.startswith(sign):
                return cls(*build(unit(t[len(sign) :])), t)
        low, dots, high = t.partition("..") if ".." in t else t.partition("-")
        if not dots:
            n = unit(t)
            return cls(n, n, True, True, t)
        a, b = unit(low), unit(high)
        if a > b:
            raise ValueError(f"backwards range: {text!r}")
        return cls(a, b, True, True, t)

    def holds(self, value: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & ((value >= self.low) if self.low_in else (value > self.low))
        if self.high is not None:
            out = out & ((value <= self.high) if self.high_in else (value < self.high))
        return F.coalesce(out & value.isNotNull(), F.lit(False))

    def contains(self, n: int) -> bool:
        return (self.low is None or n > self.low or self.low_in and n == self.low) and (self.high is None or n < self.high or self.high_in and n == self.high)

    def subsumes(self, other: Interval) -> bool:
        """Whether everything in ``other`` is in this one."""
        low = self.low is None or other.low is not None and (other.low > self.low or other.low == self.low and (self.low_in or not other.low_in))
        high = self.high is None or other.high is not None and (other.high < self.high or other.high == self.high and (self.high_in or not other.high_in))
        return low and high

    def label(self) -> str:
        """A directory's name for the interval."""
        t = re.sub(r"^(>=|<=|>|<|=)", "", self.text).strip()
        if self.low is not None and self.high is not None:
            return f"exactly-{t}" if self.low == self.high and "-" not in t and ".." not in t else t.replace("..", "-")
        if self.low is None:
            return ("up-to-" if self.high_in else "under-") + t
        return ("from-" if self.low_in else "over-") + t


def human_bytes(n: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """A size in the largest of ``units`` that it fills, with one digit behind the point and no separators."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit in units:
        size = UNITS[unit.lower()]
        out = F.when(n >= size, F.concat(F.call_function("format_number", n / size, F.lit("0.0")), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_age(seconds: Column, units: tuple[str, ...] = ("m", "h", "d", "w")) -> Column:
    """An age in the largest of ``units`` that it fills, else in seconds."""
    out = F.concat(seconds.cast("string"), F.lit("s"))
    for unit in units:
        out = F.when(seconds >= SECONDS[unit], F.concat(F.floor(seconds / SECONDS[unit]).cast("string"), F.lit(unit))).otherwise(out)
    return out


def age(now: Column, mtime: Column) -> Column:
    """Whole seconds since a file changed, none below zero."""
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(now) - F.unix_timestamp(mtime))


def cooling(now: Column, mtime: Column, seconds: int) -> Column:
    """Seconds left, rounded up, before a file has been quiet long enough; null if it has, its time is unknown, or none is asked for, whatever its time."""
    if not seconds:
        return F.lit(None).cast("long")
    left = F.lit(seconds * 1000) - (F.unix_millis(now) - F.unix_millis(mtime))
    return F.when(left > 0, F.ceil(left / 1000).cast("long"))


def wall(instant: Column, zone: str = "UTC") -> Column:
    """The wall-clock time of an instant in a zone, whatever the session's own zone is."""
    return F.convert_timezone(None, F.lit(zone), instant.cast("timestamp_ntz"))


def instant(clock: Column) -> Column:
    """The instant of a wall-clock time in UTC, whatever the session's own zone is."""
    return F.to_timestamp(F.concat(clock.cast("string"), F.lit("Z")))
