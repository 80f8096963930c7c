"""A cursor: one value inside a parsed document, with typed access. Numbers are doubles here."""

from __future__ import annotations

import math
from typing import Any

from loomdoc.functions.evaluate import evaluated

INT64 = range(-(1 << 63), 1 << 63)


def as_double(x: Any) -> float | None:
    """A number as the document model holds it: integers beyond the range are infinite."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return None
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


class JsonCursor:
    __slots__ = ("_value",)

    def __init__(self, value: Any):
        self._value = value

    def is_null(self) -> bool:
        return self._value is None

    def is_bool(self) -> bool:
        return isinstance(self._value, bool)

    def is_number(self) -> bool:
        return as_double(self._value) is not None

    def is_string(self) -> bool:
        return isinstance(self._value, str)

    def is_array(self) -> bool:
        return isinstance(self._value, list)

    def is_object(self) -> bool:
        return isinstance(self._value, dict)

    def _needs(self, right: bool, what: str) -> Any:
        if not right:
            raise RuntimeError(f"value is not {what}")
        return self._value

    def get_bool(self) -> bool:
        return self._needs(self.is_bool(), "a bool")

    def get_str(self) -> str:
        return self._needs(self.is_string(), "a string")

    def get_float(self) -> float:
        self._needs(self.is_number(), "a number")
        return as_double(self._value)

    def get_int(self) -> int:
        x = self.get_float()
        if not math.isfinite(x) or x != int(x) or int(x) not in INT64:
            raise RuntimeError("value is not a number")
        return int(x)

    def field(self, key: str) -> JsonCursor:
        found = self._needs(self.is_object(), "an object")
        if key not in found:
            raise RuntimeError("field not found")
        return JsonCursor(found[key])

    def at(self, index: int) -> JsonCursor:
        found = self._needs(self.is_array(), "an array")
        if not -len(found) <= index < len(found):
            raise RuntimeError("index out of range")
        return JsonCursor(found[index])

    def array_size(self) -> int:
        return len(self._needs(self.is_array(), "an array"))

    def object_size(self) -> int:
        return len(self._needs(self.is_object(), "an object"))

    def object_keys(self) -> list[str]:
        return list(self._needs(self.is_object(), "an object"))

    def execute(self, steps: tuple) -> list[JsonCursor]:
        return [JsonCursor(x) for x in evaluated(self._value, steps, as_double)]
