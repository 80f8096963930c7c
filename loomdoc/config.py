"""Settings: what repeated names and cycles do. Plans take them as literals when they are made."""

from __future__ import annotations

import builtins

from loomdoc.functions.parse import POLICIES
from loomdoc.functions.serialize import CYCLES

ALLOWED = {"duplicate_key_policy": POLICIES, "cycle_policy": CYCLES}
_state = {"duplicate_key_policy": "first", "cycle_policy": "warn"}


def set(key: str, value: str) -> None:  # noqa: A001
    if key not in ALLOWED:
        raise KeyError(f"unknown config key: {key}")
    if not isinstance(value, str):
        raise TypeError(f"{key} must be a string")
    if value not in ALLOWED[key]:
        raise ValueError(f"{key} must be {'|'.join(ALLOWED[key])}")
    _state[key] = value


def get(key: str) -> str | None:
    return _state.get(key)


def list() -> dict[str, str]:  # noqa: A001
    return builtins.dict(_state)
