"""Dates, times, UUIDs and registered types in parsed trees.

A string value is replaced if it is exactly a date, time, date-time (RFC 3339) or UUID that exists; anything else stays.
A member whose name is registered becomes a member of the Enum or an instance of the dataclass, where its value fits.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import enum
import re
import uuid
from typing import Any

_CLOCK = r"([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?([Zz]|[+-][0-9]{2}:[0-9]{2})?"
_DAY = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
DATE, TIME, DATETIME = re.compile(_DAY), re.compile(_CLOCK), re.compile(f"{_DAY}[Tt]{_CLOCK}")
UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def _zone(text: str | None) -> dt.timezone | None:
    if text is None:
        return None
    if text in "Zz":
        return dt.timezone.utc
    hours, minutes = int(text[1:3]), int(text[4:])
    if hours > 23 or minutes > 59:
        raise ValueError
    delta = dt.timedelta(hours=hours, minutes=minutes)
    return dt.timezone.utc if not delta else dt.timezone(-delta if text[0] == "-" else delta)


def _clock(hour: str, minute: str, second: str, fraction: str | None, zone: str | None) -> tuple:
    return int(hour), int(minute), int(second), int((fraction or "").ljust(6, "0")), _zone(zone)


def recognized(text: str) -> Any:
    """What the string stands for, or itself."""
    if not 8 <= len(text) <= 36 or type(text) is not str:
        return text
    try:
        if text[2] == ":":
            m = TIME.fullmatch(text)
            return dt.time(*_clock(*m.groups())) if m else text
        if len(text) == 10:
            m = DATE.fullmatch(text)
            return dt.date(*map(int, m.groups())) if m else text
        if len(text) == 36 and UUID.fullmatch(text):
            return uuid.UUID(text)
        m = DATETIME.fullmatch(text)
        return dt.datetime(*map(int, m.groups()[:3]), *_clock(*m.groups()[3:])) if m else text
    except ValueError:
        return text


def checked_registry(option: Any) -> dict[str, type]:
    """The registry of a parse_types option that is not False."""
    if option is True:
        return {}
    if not isinstance(option, dict):
        raise TypeError(f"parse_types must be a bool or a dict, not {type(option).__name__}")
    for name, kind in option.items():
        if not isinstance(name, str):
            raise TypeError(f"parse_types keys must be str, not {type(name).__name__}")
        if not (isinstance(kind, type) and (issubclass(kind, enum.Enum) or dataclasses.is_dataclass(kind))):
            raise TypeError(f"parse_types values must be Enum subclasses or dataclass types, not {kind!r}")
    return dict(option)


def converted(value: Any, kind: type) -> Any:
    if issubclass(kind, enum.Enum):
        try:
            return kind(value)
        except ValueError:
            return value
    if not isinstance(value, dict):
        return value
    own = {f.name: f for f in dataclasses.fields(kind) if f.init}
    needed = {n for n, f in own.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
    return kind(**value) if needed <= value.keys() <= own.keys() else value


def revived(tree: Any, registry: dict[str, type]) -> Any:
    """The tree, changed in place: contents before what holds them, at any depth."""
    if isinstance(tree, str):
        return recognized(tree)
    # containers in an order where each stands after what holds it; with the type registered for a list's elements
    order: list[tuple[Any, type | None]] = [(tree, None)] if isinstance(tree, (dict, list)) else []
    for x, _ in order:
        for name, v in x.items() if isinstance(x, dict) else ((None, v) for v in x):
            if isinstance(v, (dict, list)):
                order.append((v, registry.get(name) if isinstance(v, list) and name is not None else None))
    for x, kind in reversed(order):
        for at, v in list(x.items()) if isinstance(x, dict) else enumerate(x):
            own = registry.get(at) if isinstance(x, dict) else kind
            if own is not None:
                new = v if isinstance(x, dict) and isinstance(v, list) else converted(v, own)
            else:
                new = recognized(v) if isinstance(v, str) else v
            if new is not v:
                x[at] = new
    return tree
