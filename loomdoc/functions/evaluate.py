"""Paths over Python trees: every step maps each match, in document order, to its matches."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from typing import Any

from loomdoc.functions.paths import Step

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
LISTS = (list, tuple)


def _members(x: Any) -> Iterator[Any]:
    return iter(x.values()) if isinstance(x, dict) else iter(x) if isinstance(x, LISTS) else iter(())


def descended(root: Any, name: str) -> Iterator[Any]:
    """Members of that name below root: outermost first, and inside what matched as well. An explicit stack: any depth."""

    def below(x: Any) -> Iterator[tuple[Any, bool]]:
        if isinstance(x, dict):
            return ((v, k == name) for k, v in x.items())
        return ((v, False) for v in x) if isinstance(x, LISTS) else iter(())

    stack = [below(root)]
    while stack:
        for value, hit in stack[-1]:
            if hit:
                yield value
            stack.append(below(value))
            break
        else:
            stack.pop()


def as_number(x: Any) -> float | None:
    """A number as double; booleans are none, nor are integers beyond the range."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return None
    try:
        return float(x)
    except OverflowError:
        return None


def passes(element: Any, name: str, op: str, literal: float | str, number: Callable = as_number) -> bool:
    if not isinstance(element, dict) or name not in element:
        return False
    value = element[name]
    if isinstance(literal, str):
        return isinstance(value, str) and COMPARE[op](value, literal)
    value = number(value)
    return value is not None and COMPARE[op](value, literal)


def sliced(x: Any, start: int | None, end: int | None, by: int) -> Any:
    """A negative step selects nothing; a bound below zero counts from the end."""
    if by < 0:
        return ()
    n = len(x)
    lo = 0 if start is None else max(0, start + n) if start < 0 else start
    hi = n if end is None else max(0, end + n) if end < 0 else min(end, n)
    return x[lo:hi:by]


def stepped(matches: list, step: Step, number: Callable = as_number) -> list:
    if step.kind == "field":
        name = step.args[0]
        return [x[name] for x in matches if isinstance(x, dict) and name in x]
    if step.kind == "wildcard":
        return [m for x in matches for m in _members(x)]
    if step.kind == "descend":
        return [m for x in matches for m in descended(x, step.args[0])]
    lists = [x for x in matches if isinstance(x, LISTS)]
    if step.kind == "index":
        n = step.args[0]
        return [x[n] for x in lists if -len(x) <= n < len(x)]
    if step.kind == "slice":
        return [m for x in lists for m in sliced(x, *step.args)]
    return [m for x in lists for m in x if passes(m, *step.args, number)]


def evaluated(root: Any, steps: tuple[Step, ...], number: Callable = as_number) -> list:
    found = [root]
    for step in steps:
        found = stepped(found, step, number)
        if not found:
            break
    return found
