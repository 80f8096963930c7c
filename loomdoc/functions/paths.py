"""Path expressions: text to an immutable list of steps. Anything outside the grammar is refused."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

ERROR = "Invalid JSONPath expression"
INT64 = range(-(1 << 63), 1 << 63)
BLANKS = " \t"
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}
#: A token is tried where the last one ended; blanks are tokens that some places allow and others do not.
NAME = re.compile(r"[A-Za-z0-9_]+")
INTEGER = re.compile(r"-?[0-9]+")
NUMBER = re.compile(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
AFTER_NUMBER = re.compile(r"[0-9.eE+-]")
COMPARISON = re.compile(r"==|!=|<=|>=|<|>")
STRING = re.compile(r"""'((?:[^'\\]|\\[ntr\\"'])*)'|"((?:[^"\\]|\\[ntr\\"'])*)\"""")


@dataclass(frozen=True)
class Step:
    kind: str  # field, wildcard, index, slice, descend, filter
    args: tuple[Any, ...] = ()


class Refused(Exception):
    pass


class _Reader:
    """The text and how far it is read."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blanks(self) -> None:
        while self.text[self.at : self.at + 1] and self.text[self.at] in BLANKS:
            self.at += 1

    def sees(self, token: str) -> bool:
        return self.text.startswith(token, self.at)

    def takes(self, token: str) -> bool:
        found = self.sees(token)
        self.at += len(token) * found
        return found

    def needs(self, token: str) -> None:
        if not self.takes(token):
            raise Refused

    def match(self, pattern: re.Pattern) -> re.Match | None:
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
        return m

    def name(self) -> str:
        if m := self.match(NAME):
            return m[0]
        raise Refused

    def string(self) -> str:
        m = self.match(STRING)
        if m is None:
            raise Refused
        return re.sub(r"\\(.)", lambda e: ESCAPES[e[1]], m[1] if m[2] is None else m[2], flags=re.DOTALL)

    def integer(self) -> int | None:
        m = self.match(INTEGER)
        if m and int(m[0]) not in INT64:
            raise Refused
        return int(m[0]) if m else None

    def number(self) -> float:
        m = self.match(NUMBER)
        if m is None or AFTER_NUMBER.match(self.text, self.at) or math.isinf(float(m[0])):
            raise Refused
        return float(m[0])

    def step(self) -> Step:
        if self.takes(".."):
            return Step("descend", (self.name(),))
        if self.takes("."):
            return Step("wildcard") if self.takes("*") else Step("field", (self.name(),))
        self.needs("[")
        self.blanks()
        step = self.bracketed()
        self.blanks()
        self.needs("]")
        return step

    def bracketed(self) -> Step:
        if self.takes("*"):
            return Step("wildcard")
        if self.takes("?"):
            return self.filter()
        if self.sees("'") or self.sees('"'):
            return Step("field", (self.string(),))
        start = self.integer()
        self.blanks()
        if not self.takes(":"):
            if start is None:
                raise Refused
            return Step("index", (start,))
        self.blanks()
        end, by = self.integer(), None
        self.blanks()
        if self.takes(":"):
            self.blanks()
            by = self.integer()
        if by == 0:
            raise Refused
        return Step("slice", (start, end, 1 if by is None else by))

    def filter(self) -> Step:
        self.blanks()
        self.needs("(")
        self.blanks()
        self.needs("@")
        if self.takes("."):
            name = self.name()
        else:
            self.needs("[")
            self.blanks()
            name = self.string()
            self.blanks()
            self.needs("]")
        self.blanks()
        op = self.match(COMPARISON)
        if op is None:
            raise Refused
        self.blanks()
        literal: float | str
        if self.sees("'") or self.sees('"'):
            literal = self.string()
            if op[0] not in ("==", "!="):
                raise Refused
        else:
            literal = self.number()
        self.blanks()
        self.needs(")")
        return Step("filter", (name, op[0], literal))


def parse(expression: str) -> tuple[Step, ...]:
    reader, steps = _Reader(expression), []
    try:
        reader.blanks()
        reader.needs("$")
        reader.blanks()
        while reader.at < len(expression):
            steps.append(reader.step())
            reader.blanks()
    except Refused:
        raise ValueError(ERROR) from None
    return tuple(steps)


@dataclass(frozen=True, repr=False)
class CompiledPath:
    """A parsed expression, accepted wherever an expression is; hashable and picklable."""

    expression: str
    steps: tuple[Step, ...]

    def __repr__(self) -> str:
        return f"CompiledPath({self.expression!r})"

    def execute(self, cursor: Any) -> list:
        """Cursors of all matches below a cursor."""
        from loomdoc.cursor import JsonCursor

        if not isinstance(cursor, JsonCursor):
            raise TypeError("execute() expects a JsonCursor")
        return cursor.execute(self.steps)


def compiled(expression: str | CompiledPath) -> CompiledPath:
    if isinstance(expression, CompiledPath):
        return expression
    if not isinstance(expression, str):
        raise TypeError(f"expression must be str or CompiledPath, not {type(expression).__name__}")
    return CompiledPath(expression, parse(expression))
