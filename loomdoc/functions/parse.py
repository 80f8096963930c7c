"""Strict JSON text to Python trees, with the policies for repeated names.

The standard library's parser does the work; what it lets pass is refused around it: NaN and infinities, unpaired
surrogates, bytes that are not UTF-8, more than 1024 open containers. Integers are exact at any size.
"""

from __future__ import annotations

import json
import re
import warnings
from decimal import Decimal
from typing import Any

DEPTH = 1024
INVALID, TOO_DEEP = "Invalid JSON", "Maximum nesting depth exceeded"
POLICIES = ("first", "last", "error", "warn")
SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
TEXT = re.compile(r'"(?:[^"\\]|\\.)*"?', re.DOTALL)
BRACKETS = re.compile(r"[\[\]{}]")


class InvalidJson(ValueError):
    """Text that is no JSON document; the message says whether it was refused for its depth."""


def _constant(_: str) -> Any:
    raise InvalidJson(INVALID)


def _big(digits: str) -> int:
    return int(Decimal(digits)) if len(digits) > 4000 else int(digits)


def _kept(pairs: list) -> dict:
    out: dict = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


def _error(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise InvalidJson(INVALID)
    return out


def _warn(pairs: list) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            warnings.warn(f"Duplicate key encountered: {k}", RuntimeWarning, stacklevel=2)
        else:
            out[k] = v
    return out


def _first(pairs: list) -> dict:
    out = dict(pairs)
    return out if len(out) == len(pairs) else _kept(pairs)


HOOKS = {"first": _first, "last": None, "error": _error, "warn": _warn}


def _encodable(x: Any) -> None:
    """Raises if a string in x, or in lists in x, has no UTF-8 form; dicts were looked at when they were made."""
    stack = [x]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            x.encode()
        elif isinstance(x, list):
            stack += x


def _guarded(hook):
    def run(pairs: list) -> dict:
        for k, v in pairs:
            k.encode()
            _encodable(v)
        return dict(pairs) if hook is None else hook(pairs)

    return run


def _too_deep(text: str) -> int | None:
    """Where a container opens inside DEPTH others."""
    if text.count("[") + text.count("{") <= DEPTH:
        return None
    depth, at = 0, 0
    while at < len(text):
        b, s = BRACKETS.search(text, at), text.find('"', at)
        if b is None:
            return None
        if 0 <= s < b.start():
            at = TEXT.match(text, s).end()
            continue
        depth += 1 if b[0] in "[{" else -1
        if depth > DEPTH:
            return b.start()
        at = b.end()
    return None


def parse_json(source: str | bytes, policy: str = "first") -> Any:
    """The document's tree; InvalidJson if it is not one."""
    try:
        text = source.decode("utf-8") if isinstance(source, bytes) else source
    except UnicodeDecodeError:
        raise InvalidJson(INVALID) from None
    deep = _too_deep(text)
    if deep is not None:
        try:
            json.loads(text[: deep + 1], parse_constant=_constant)
        except json.JSONDecodeError as e:
            raise InvalidJson(TOO_DEEP if e.pos > deep else INVALID) from None
        except ValueError:
            pass
        raise InvalidJson(TOO_DEEP)
    hook = HOOKS[policy]
    options: dict[str, Any] = {"parse_constant": _constant, "object_pairs_hook": hook}
    try:
        if SURROGATE.search(text) or not isinstance(source, bytes) and not text.isascii():
            options["object_pairs_hook"] = _guarded(hook)
        try:
            out = json.loads(text, **options)
        except json.JSONDecodeError:
            raise
        except InvalidJson:
            raise
        except UnicodeEncodeError:
            raise
        except ValueError:  # an integer of more digits than int() takes
            out = json.loads(text, parse_int=_big, **options)
        if options["object_pairs_hook"] is not hook:
            _encodable(out)
        return out
    except (json.JSONDecodeError, UnicodeEncodeError):
        raise InvalidJson(INVALID) from None


def status_of(source: str | bytes) -> str:
    """ok, invalid or too deep."""
    try:
        parse_json(source, "last")
    except InvalidJson as e:
        return "invalid" if str(e) == INVALID else "too deep"
    return "ok"


def records_of(text: bytes) -> list[tuple[int, bytes]]:
    """(line number from 1, line without blanks around it) of newline-delimited text; blank lines are counted but left out."""
    out = []
    for n, line in enumerate(text.split(b"\n"), 1):
        line = line.strip(b"\r \t")
        if line:
            out.append((n, line))
    return out
