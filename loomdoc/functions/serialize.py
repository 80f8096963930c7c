"""Python trees to compact JSON text: members in their order, raw UTF-8, floats as their shortest repr, NaN and infinities null.

`tree_text` is for trees that were parsed here; `Writer` takes any object, with an explicit stack, the cycle policy, the
native types and a hook for what has no JSON form.
"""

from __future__ import annotations

import json
import math
import re
import sys
import warnings
from collections.abc import Callable, Iterator
from decimal import Decimal
from json.encoder import encode_basestring as quoted
from typing import Any

CYCLES = ("warn", "error", "ignore")
JSON_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
MISSING = object()
_compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), allow_nan=False, check_circular=False).encode


def float_text(x: float) -> str:
    return float.__repr__(x) if math.isfinite(x) else "null"


def int_text(x: int) -> str:
    return int.__repr__(x) if x.bit_length() < 13_000 else format(Decimal(int(x)), "f")


def offset_text(delta: Any) -> str:
    if delta is None:
        return ""
    seconds = delta.days * 86400 + delta.seconds
    minutes = (abs(seconds) + 30) // 60
    return f"{'-' if seconds < 0 else '+'}{minutes // 60:02}:{minutes % 60:02}"


def clock_text(t: Any, offset: Any) -> str:
    return f"{t.hour:02}:{t.minute:02}:{t.second:02}" + (f".{t.microsecond:06}" if t.microsecond else "") + offset_text(offset)


def date_text(d: Any) -> str:
    return f"{d.year:04}-{d.month:02}-{d.day:02}"


def loaded(module: str, name: str) -> Any:
    """A type of a module that is already imported; a type without instances if it is not."""
    return getattr(sys.modules.get(module), name, _Nothing)


class _Nothing:
    pass


class Writer:
    """Serialises one object. default is called once for each object without a JSON form, never on its own result."""

    def __init__(self, *, native: bool = False, default: Callable[[Any], Any] | None = None, cycles: str = "warn"):
        self.native, self.default, self.cycles = native, default, cycles
        self.out: list[str] = []
        self.stack: list[tuple[Iterator, str, int]] = []
        self.open: set[int] = set()

    def text(self, root: Any) -> str:
        out, stack = self.out, self.stack
        self.value(root)
        first = True
        depth = len(stack)
        while stack:
            items, close, own = stack[-1]
            if len(stack) > depth:
                first = True
            depth = len(stack)
            item = next(items, MISSING)
            if item is MISSING:
                out.append(close)
                stack.pop()
                self.open.discard(own)
                depth, first = len(stack), False
                continue
            if not first:
                out.append(",")
            first = False
            if close == "}":
                key, item = item
                if not isinstance(key, str):
                    raise TypeError(f"keys must be str, not {type(key).__name__}")
                out.append(quoted(key) + ":")
            self.value(item)
        whole = "".join(out)
        whole.encode()
        return whole

    def value(self, x: Any) -> None:
        out = self.out
        if isinstance(x, str):
            out.append(quoted(x))
        elif x is None:
            out.append("null")
        elif isinstance(x, bool):
            out.append("true" if x else "false")
        elif isinstance(x, float):
            out.append(float_text(x))
        elif isinstance(x, int):
            out.append(int_text(x))
        elif isinstance(x, dict):
            # a small object is written as it is on entry, a larger one as it is when its members are reached
            self.opened(x, "{", iter(list(x.items()) if len(x) <= 24 else x.items()), "}")
        elif isinstance(x, (list, tuple)):
            self.opened(x, "[", iter(x), "]")
        elif not (self.native and self.native_value(x)):
            self.unsupported(x)

    def opened(self, x: Any, opening: str, items: Iterator, close: str) -> None:
        if id(x) in self.open:
            self.circular()
        elif len(self.stack) >= sys.getrecursionlimit():
            raise ValueError("Maximum serialization depth exceeded")
        else:
            self.out.append(opening)
            self.open.add(id(x))
            self.stack.append((items, close, id(x)))
            self.kept = x

    def circular(self) -> None:
        if self.cycles == "error":
            raise ValueError("Circular reference detected")
        if self.cycles == "warn":
            warnings.warn("Circular reference detected", RuntimeWarning, stacklevel=2)
        self.out.append("null")

    def unsupported(self, x: Any) -> None:
        if self.default is None:
            raise TypeError(f"Object of type {type(x).__name__} is not JSON serializable")
        hook, got = self.default, self.default(x)
        self.default = None
        try:
            self.value(got)
        except TypeError as e:
            if str(e) == f"Object of type {type(got).__name__} is not JSON serializable":
                raise TypeError(f"default() returned an object of type {type(got).__name__} that is not JSON serializable") from None
            raise
        finally:
            self.default = hook

    def native_value(self, x: Any) -> bool:
        out, kind = self.out, type(x)
        if kind is loaded("datetime", "datetime"):
            out.append(f'"{date_text(x)}T{clock_text(x, x.utcoffset())}"')
        elif kind is loaded("datetime", "date"):
            out.append(f'"{date_text(x)}"')
        elif kind is loaded("datetime", "time"):
            out.append(f'"{clock_text(x, x.utcoffset())}"')
        elif isinstance(x, loaded("uuid", "UUID")):
            if not isinstance(x.int, int):
                raise TypeError(f"UUID.int must be an int, not {type(x.int).__name__}")
            if not 0 <= x.int < 1 << 128:
                raise ValueError("UUID.int is out of range (need a 128-bit value)")
            h = f"{x.int:032x}"
            out.append(f'"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"')
        elif isinstance(x, Decimal):
            text = str(x)
            if not x.is_finite():
                text = "null"
            elif not JSON_NUMBER.fullmatch(text):
                raise ValueError("str() of a Decimal returned text that is not a JSON number")
            out.append(text)
        elif isinstance(x, loaded("enum", "Enum")):
            self.enum_value(x)
        elif hasattr(kind, "__dataclass_fields__"):
            import dataclasses

            self.opened(x, "{", ((f.name, getattr(x, f.name)) for f in dataclasses.fields(x)), "}")
        elif isinstance(x, (set, frozenset)):
            self.opened(x, "[", iter(x), "]")
        elif isinstance(x, loaded("numpy", "generic")) and x.dtype.kind in "biuf":
            plain = x.item()
            if type(plain) is kind:
                return False
            self.value(plain)
        elif isinstance(x, loaded("numpy", "ndarray")) and x.dtype.kind in "biuf":
            plain = x.tolist()
            if isinstance(plain, loaded("numpy", "generic")):
                return False
            self.value(plain)
        else:
            return False
        return True

    def enum_value(self, member: Any) -> None:
        enum, seen = loaded("enum", "Enum"), set()
        while isinstance(member, enum) and not isinstance(member, (str, int, float, dict, list, tuple)):
            if id(member) in seen or id(member) in self.open:
                return self.circular()
            if len(seen) >= sys.getrecursionlimit():
                raise ValueError("Maximum serialization depth exceeded")
            seen.add(id(member))
            member = member.value
        return self.value(member)


def tree_text(tree: Any) -> str:
    """The text of a tree that was parsed here."""
    try:
        text = _compact(tree)
    except (ValueError, RecursionError):
        return deep_text(tree)
    return text


def deep_text(tree: Any) -> str:
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, 2000))  # the parser allows 1024 containers
        return Writer().text(tree)
    finally:
        sys.setrecursionlimit(limit)
