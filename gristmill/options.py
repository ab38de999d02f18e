"""Engine options, with a scoped default. Plans capture them when compiled; executors never read them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any


@dataclass(frozen=True)
class EngineOptions:
    """profile: 'record' (absent is a value, two-valued) or 'sql' (three-valued). on_data_error: 'fail', 'null' or 'raise'."""

    now: datetime | str | None = None
    time_zone: str = "UTC"
    week_start: int = 1  # Monday; Sunday is 0
    case_insensitive: bool = False
    fuzzy: Any = None
    profile: str = "record"
    on_data_error: str = "fail"
    fanout: bool = False


_DEFAULT: ContextVar[EngineOptions] = ContextVar("gristmill_options", default=EngineOptions())


def get_options() -> EngineOptions:
    return _DEFAULT.get()


def set_options(**changes: Any) -> EngineOptions:
    _DEFAULT.set(replace(_DEFAULT.get(), **changes))
    return _DEFAULT.get()


def reset_options() -> None:
    _DEFAULT.set(EngineOptions())


@contextmanager
def scope(**changes: Any) -> Iterator[EngineOptions]:
    """Options for the statements inside; nested scopes merge."""
    token = _DEFAULT.set(replace(_DEFAULT.get(), **changes))
    try:
        yield _DEFAULT.get()
    finally:
        _DEFAULT.reset(token)
