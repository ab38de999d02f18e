"""Calendar expressions resolved on the driver to UTC instants of millisecond precision."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, date, datetime, timedelta
from typing import Any
from zoneinfo import ZoneInfo

from gristmill import catalog
from gristmill.options import EngineOptions
from gristmill.rules import RuleError

MS = timedelta(milliseconds=1)
_ZONED = re.compile(r"(?:[zZ]|T.*[+-]\d{2}:?\d{2})$")
_MONTHS = {"years": 12, "quarters": 3, "months": 1}


def instant(value: Any, zone: str) -> datetime:
    """A date text, epoch milliseconds or datetime. Without a zone of its own it is anchored in `zone`."""
    if isinstance(value, bool) or value is None:
        raise RuleError(f"not a date: {value!r}")
    if isinstance(value, (int, float)):
        return datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=int(value))
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip().replace("Z", "+00:00") if _ZONED.search(value.strip()) else value.strip())
        except ValueError:
            raise RuleError(f"not a date: {value!r}") from None
    elif isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        value = value.replace(tzinfo=ZoneInfo(zone))
    value = value.astimezone(UTC)
    return value.replace(microsecond=value.microsecond // 1000 * 1000)


def is_expression(value: Any) -> bool:
    return isinstance(value, dict) and len(value) == 1 and next(iter(value)) in ("ago", "ahead", "this", "last", "next", "start", "end")


def _now(options: EngineOptions) -> datetime:
    if options.now is None:
        raise RuleError("a relative date needs the option now; no clock is read")
    return instant(options.now, options.time_zone).astimezone(ZoneInfo(options.time_zone))


def _local(moment: datetime, **parts: int) -> datetime:
    """Wall-clock arithmetic keeps the zone and lets its offset follow."""
    return moment.replace(**parts)


def _months(moment: datetime, n: int) -> datetime:
    month = moment.month - 1 + n
    year, month = moment.year + month // 12, month % 12 + 1
    return _local(moment, year=year, month=month, day=min(moment.day, calendar.monthrange(year, month)[1]))


def step(moment: datetime, unit: str, n: int) -> datetime:
    if unit in _MONTHS:
        return _months(moment, n * _MONTHS[unit])
    if unit in ("weeks", "days"):
        days = n * (7 if unit == "weeks" else 1)
        return (moment.replace(tzinfo=None) + timedelta(days=days)).replace(tzinfo=moment.tzinfo)
    if unit in ("hours", "minutes", "seconds"):
        return (moment.astimezone(UTC) + timedelta(**{unit: n})).astimezone(moment.tzinfo)
    raise RuleError(f"unknown unit {unit}")


def start_of(moment: datetime, period: str, week_start: int = 1) -> datetime:
    zero = {"hour": 0, "minute": 0, "second": 0, "microsecond": 0}
    match period:
        case "year":
            return _local(moment, month=1, day=1, **zero)
        case "quarter":
            return _local(moment, month=(moment.month - 1) // 3 * 3 + 1, day=1, **zero)
        case "month":
            return _local(moment, day=1, **zero)
        case "week" | "isoWeek":
            first = 1 if period == "isoWeek" else week_start
            return step(_local(moment, **zero), "days", -((moment.isoweekday() - first) % 7))
        case "day":
            return _local(moment, **zero)
        case "hour":
            return _local(moment, minute=0, second=0, microsecond=0)
        case "minute":
            return _local(moment, second=0, microsecond=0)
        case "second":
            return _local(moment, microsecond=0)
    raise RuleError(f"unknown period {period}")


def period(expression: dict, options: EngineOptions) -> tuple[datetime, datetime]:
    """First and last millisecond of this, last or next period."""
    key, name = next(iter(expression.items()))
    if name not in catalog.PERIODS:
        raise RuleError(f"unknown period {name}")
    unit = "weeks" if name == "isoWeek" else f"{name}s"
    moved = step(_now(options), unit, {"this": 0, "last": -1, "next": 1}[key])
    first = start_of(moved, name, options.week_start)
    after = step(first, unit, 1)
    return first.astimezone(UTC), after.astimezone(UTC) - MS


def rolling(expression: dict, options: EngineOptions) -> datetime:
    key, units = next(iter(expression.items()))
    if not isinstance(units, dict) or not units:
        raise RuleError("a rolling date takes units")
    moment = _now(options)
    for unit, n in units.items():
        if not isinstance(n, (int, float)) or isinstance(n, bool) or n < 0:
            raise RuleError(f"{unit} takes a count")
        moment = step(moment, unit, int(n) if key == "ahead" else -int(n))
    return moment.astimezone(UTC)


def resolve(value: Any, options: EngineOptions, edge: str = "start") -> datetime:
    """One instant. A bare period gives its first or last millisecond by `edge`."""
    if not is_expression(value):
        return instant(value, options.time_zone)
    key, inner = next(iter(value.items()))
    if key in ("ago", "ahead"):
        return rolling(value, options)
    if key in ("start", "end"):
        if not is_expression(inner) or next(iter(inner)) not in ("this", "last", "next"):
            raise RuleError(f"{key} takes a period")
        return period(inner, options)[key == "end"]
    return period(value, options)[edge == "end"]


def span(value: Any, options: EngineOptions) -> tuple[datetime, datetime]:
    """The range of `within`: a period, or from a rolling moment to now (or now to it)."""
    if not is_expression(value) or next(iter(value)) in ("start", "end"):
        raise RuleError("within takes a period or a rolling date")
    if next(iter(value)) in ("this", "last", "next"):
        return period(value, options)
    a, b = sorted((rolling(value, options), _now(options).astimezone(UTC)))
    return a, b


def weekdays(names: Any) -> list[int]:
    """Spark's dayofweek numbers (Sunday 1). Unknown names match nothing."""
    if not isinstance(names, list):
        raise RuleError("a list of day names is needed")
    return [catalog.DAYS.index(n.lower()) + 1 for n in names if isinstance(n, str) and n.lower() in catalog.DAYS]
